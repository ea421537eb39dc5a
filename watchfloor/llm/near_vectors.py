"""Embedding near-duplicates: all pairs of vectors with a cosine of at least a threshold, by dual traversal of cover trees.

On the unit sphere cosine >= t is distance <= sqrt(2 - 2t). Vectors equal in every component are collapsed first. A nested
net of pivots, picked farthest first from a bounded sample (so every beginning of the list is a net with a smaller radius),
cuts the space into cells; a cell with more vectors than a task should hold is cut into chunks. Every vector goes to its own
chunk and visits the later chunks that the triangle inequality does not rule out: its distance to their pivot is at
most their covering radius plus the threshold.

Inside a task the chunk and each block of visitors become cover trees, nested levels with halving radii. Pairs of nodes are
walked from the top: those further apart than their radii and the threshold allow are dropped, those wholly within the
threshold are taken without looking at their vectors, and leaves are multiplied out in double precision. A product within
1e-9 of the threshold is computed again from the vectors as given. Only link counts and a spanning forest leave the task, never
pairs, so a dense group of thousands costs as many rows as it has members.

Exactness has its price where the triangle inequality has nothing to say: for vectors without structure in many dimensions
every chunk visits every other, in blocks of bounded memory.

Defined results: null, zero or non-finite vectors and vectors with null components link with nothing; vectors of different
lengths never link. Repeated rows are vectors of their own and link with each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfloor.llm.common import checkpointed, map_batches, partitions
from watchfloor.llm.components import components

COSINE = 0.95
SAMPLE = 4096  # vectors among which pivots are picked
MOST_CELLS = 1024
CHUNK_ROWS = 4096  # vectors of a chunk
BLOCK_ROWS = 2048  # visitors taken at once
LEAF, FANOUT = 128, 64
SLACK = 1e-9


class Node:
    """A node of a cover tree: members (positions in the tree's order), center, covering radius and children."""

    __slots__ = ("members", "center", "radius", "children")

    def __init__(self, x: np.ndarray, members: np.ndarray, level: float):
        self.members, self.center = members, x[members[0]]
        away = distances(x[members], self.center)
        self.radius, self.children = float(away.max()), []
        if len(members) <= LEAF or self.radius == 0:
            return
        while level / 2 >= self.radius:
            level /= 2
        level /= 2
        left, loose = members, []
        for _ in range(FANOUT):
            inside = distances(x[left], x[left[0]]) <= level
            (loose.append if inside.sum() < 4 else lambda part: self.children.append(Node(x, part, level)))(left[inside])
            left = left[~inside]
            if not len(left):
                break
        rest = np.concatenate([*loose, left])
        if not self.children and len(rest) == len(members):
            parts = np.array_split(rest, -(-len(rest) // (4 * LEAF)))
            self.children = [Node.leaf(x, p) for p in parts] if len(parts) > 1 else []
        elif len(rest):
            self.children += [Node.leaf(x, p) for p in np.array_split(rest, -(-len(rest) // (4 * LEAF)))]

    @classmethod
    def leaf(cls, x: np.ndarray, members: np.ndarray) -> Node:
        node = cls.__new__(cls)
        node.members, node.children, node.center = members, [], x[members].mean(0)
        node.radius = float(distances(x[members], node.center).max())
        return node


def distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - center) ** 2).sum(1))


class Links:
    """Link counts and a spanning forest over the vectors of a chunk and of one block of visitors after the other."""

    def __init__(self, raw: np.ndarray, copies: np.ndarray, cosine: float):
        self.cosine, self.reach = cosine, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        self.raw, self.x, self.copies = raw, raw / np.linalg.norm(raw, axis=1, keepdims=True), copies
        self.count, self.root = np.zeros(len(raw), np.int64), np.arange(len(raw))

    def extended(self, raw: np.ndarray, copies: np.ndarray) -> Links:
        more = Links(raw, copies, self.cosine)
        both = Links.__new__(Links)
        both.cosine, both.reach = self.cosine, self.reach
        for name in ("raw", "x", "copies", "count"):
            setattr(both, name, np.concatenate([getattr(self, name), getattr(more, name)]))
        both.root = np.concatenate([self.root, more.root + len(self.root)])
        return both

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the trees of a[i] and b[i]; the smallest position is the root."""
        while True:
            one, two = self.find(a), self.find(b)
            apart = one != two
            if not apart.any():
                return
            low, high = np.minimum(one, two)[apart], np.maximum(one, two)[apart]
            np.minimum.at(self.root, high, low)

    def find(self, a: np.ndarray) -> np.ndarray:
        roots = self.root[a]
        while True:
            up = self.root[roots]
            if (up == roots).all():
                self.root[a] = roots
                return roots
            roots = up

    def multiplied(self, p: np.ndarray, q: np.ndarray, same: bool) -> None:
        product = self.x[p] @ self.x[q].T
        near = product >= self.cosine
        for i, j in zip(*np.nonzero(np.abs(product - self.cosine) < SLACK), strict=True):
            a, b = self.raw[p[i]], self.raw[q[j]]
            near[i, j] = a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= self.cosine
        if same:
            np.fill_diagonal(near, False)
        if near.any():
            self.count[p] += near @ self.copies[q]
            if not same:
                self.count[q] += self.copies[p] @ near
            i, j = np.nonzero(near)
            self.join(p[i], q[j])

    def all_linked(self, p: np.ndarray, q: np.ndarray, same: bool) -> None:
        self.count[p] += self.copies[q].sum() - (self.copies[p] if same else 0)
        if not same:
            self.count[q] += self.copies[p].sum()
        first = np.full(len(p) + len(q), p[0])
        self.join(first, np.concatenate([p, q]))

    def walk(self, p: Node, q: Node) -> None:
        """All links between two trees, or (p is q) inside one."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            same = p is q
            gap = 0.0 if same else float(np.sqrt(((p.center - q.center) ** 2).sum()))
            if gap - p.radius - q.radius > self.reach + SLACK:
                continue
            if gap + p.radius + q.radius <= self.reach - SLACK:
                self.all_linked(p.members, q.members, same)
            elif not p.children and not q.children:
                self.multiplied(p.members, q.members, same)
            elif same:
                todo += [(c, d) for i, c in enumerate(p.children) for d in p.children[i:]]
            elif not q.children or (p.children and p.radius >= q.radius):
                todo += [(c, q) for c in p.children]
            else:
                todo += [(p, d) for d in q.children]


def pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first order of unit vectors: each beginning of it is a net of the sample."""
    chosen, away = [0], distances(sample, sample[0])
    while len(chosen) < min(most, len(sample)):
        nxt = int(away.argmax())
        if away[nxt] <= 0:
            break
        chosen.append(nxt)
        away = np.minimum(away, distances(sample, sample[nxt]))
    return sample[chosen]


def to_pivots(unit: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(unit @ centers.T, -1, 1)))


def unpacked(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, raw, size) of (vec_id, embedding): the components as doubles and a digest of them."""

    def run(batches):
        for batch in batches:
            rows = [np.array(v, np.float64) + 0.0 for v in batch.column("embedding").to_pylist()]
            raw = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([hashlib.md5(r).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary()), pa.array([len(r) for r in rows], pa.int32())],
                ["vec_id", "node", "raw", "size"],
            )

    return map_batches(vectors, run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, node binary, raw binary, size int")


def links_of_size(nodes: DataFrame, size: int, cosine: float, chunk_rows: int) -> DataFrame:
    """(node, n, other): links counted at a node, and the node of its tree that it hangs on (null: none), of vectors of one
    length. To the driver come the bounded sample and one row for each cell."""
    spark = nodes.sparkSession
    n = nodes.count()
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    sample = [np.frombuffer(bytes(r.raw), np.float64) for r in nodes.orderBy("node").limit(SAMPLE).select("raw").collect()]
    sample = np.stack(sample) if sample else np.ones((1, size))
    centers = spark.sparkContext.broadcast(pivots(sample / np.linalg.norm(sample, axis=1, keepdims=True), max(1, min(MOST_CELLS, -(-n // chunk_rows)))))

    def home(batches):
        for batch in batches:
            raw = unpacked(batch.column("raw"), size)
            away = to_pivots(raw / np.linalg.norm(raw, axis=1, keepdims=True), centers.value) if len(raw) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("raw"), batch.column("copies"), pa.array(away.argmin(1).astype(np.int32)), pa.array(away.min(1, initial=9.0))], ["node", "raw", "copies", "cell", "away"]
            )

    cells = checkpointed(map_batches(nodes.select("node", "raw", "copies"), home, "node binary, raw binary, copies long, cell int, away double"))
    sizes = {r.cell: (r["count"], r.radius) for r in cells.groupBy("cell").agg(F.count("*").alias("count"), F.max("away").alias("radius")).collect()}
    chunks = np.array([-(-sizes.get(c, (0, 0))[0] // chunk_rows) for c in range(len(centers.value))])
    first = np.concatenate([[0], np.cumsum(chunks)])
    radius = np.array([sizes.get(c, (0, -9.0))[1] for c in range(len(centers.value))])

    def visits(batches):
        for batch in batches:
            raw, cell = unpacked(batch.column("raw"), size), batch.column("cell").to_numpy()
            nodes_, copies = batch.column("node").to_pylist(), batch.column("copies").to_numpy()
            if not len(raw):
                continue
            away = to_pivots(raw / np.linalg.norm(raw, axis=1, keepdims=True), centers.value)
            wanted = (away <= radius + reach + 1e-6) & (np.arange(len(radius)) > cell[:, None])
            own = np.array([int.from_bytes(x[:6], "big") for x in nodes_]) % chunks[cell] + first[cell]
            rows, units = [np.arange(len(raw))], [own]
            for i in range(len(raw)):
                later = np.concatenate([np.arange(own[i] + 1, first[cell[i] + 1]), *[np.arange(first[c], first[c + 1]) for c in np.flatnonzero(wanted[i])]])
                rows.append(np.full(len(later), i))
                units.append(later)
            at, unit = np.concatenate(rows), np.concatenate(units).astype(np.int64)
            for s in range(0, len(at), 8192):
                part = at[s : s + 8192]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit[s : s + 8192]), pa.array(unit[s : s + 8192] != own[part]), batch.column("node").take(pa.array(part)), batch.column("raw").take(pa.array(part)), pa.array(copies[part])],
                    ["unit", "visitor", "node", "raw", "copies"],
                )

    def join(batches):
        def tree(x, start=0):
            return Node(x, np.arange(start, len(x)), 2.0)

        def told(names, count, other):
            keep = [i for i in range(len(names)) if count[i] or other[i] is not None]
            return pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in keep], pa.binary()), pa.array([int(count[i]) for i in keep], pa.int64()), pa.array([other[i] for i in keep], pa.binary())], ["node", "n", "other"]
            )

        def hung(names, root, start=0):
            return [None if r == i else names[r] for i, r in enumerate(root[start:].tolist(), start)]

        unit, names, links, top = None, [], None, None
        held = {False: ([], [], []), True: ([], [], [])}

        def settle():
            """The chunk is complete: its own links."""
            nonlocal links, top, names
            if links is None and held[False][0]:
                names = held[False][0]
                links = Links(np.stack(held[False][1]), np.array(held[False][2]), cosine)
                top = tree(links.x)
                links.walk(top, top)

        def visit():
            """Links of the visitors held; their rows."""
            settle()
            guests, raw, copies = held[True]
            held[True] = ([], [], [])
            if links is None or not guests:
                return None
            both = links.extended(np.stack(raw), np.array(copies))
            both.walk(top, tree(both.x, len(names)))
            both.find(np.arange(len(both.root)))
            links.count, links.root = both.count[: len(names)], both.root[: len(names)]
            return told(guests, both.count[len(names) :], hung(names + guests, both.root, len(names)))

        def finished():
            out = [visit()]
            settle()
            if links is not None:
                links.find(np.arange(len(names)))
                out.append(told(names, links.count, hung(names, links.root)))
            return [o for o in out if o is not None]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("unit", "visitor", "node", "raw", "copies")]
            for u, visitor, node, raw, copies in zip(*columns, strict=True):
                if u != unit:
                    yield from finished()
                    unit, names, links, top = u, [], None, None
                    held = {False: ([], [], []), True: ([], [], [])}
                for to, value in zip(held[visitor], (node, np.frombuffer(raw, np.float64), copies), strict=True):
                    to.append(value)
                if visitor and len(held[True][0]) >= BLOCK_ROWS and (out := visit()) is not None:
                    yield out
        yield from finished()

    routed = map_batches(cells, visits, "unit long, visitor boolean, node binary, raw binary, copies long")
    tasks = max(1, min(int(first[-1]), 4 * partitions(spark)))
    dealt = routed.repartitionById(tasks, F.pmod("unit", F.lit(tasks)).cast("int")).sortWithinPartitions("unit", "visitor", "node")
    return map_batches(dealt, join, "node binary, n long, other binary")


def near_vector_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = checkpointed(packed(rows.filter(usable)))
    nodes = checkpointed(good.groupBy("node").agg(F.first("raw").alias("raw"), F.first("size").alias("size"), F.count("*").alias("copies")))
    sizes = [r.size_ for r in nodes.select(F.col("size").alias("size_")).distinct().collect()]
    found = None
    for size in sizes:
        part = links_of_size(nodes.filter(F.col("size") == size), size, cosine, chunk_rows)
        found = part if found is None else found.union(part)
    bad = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return bad
    found = checkpointed(found)
    groups = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy(F.col("node").alias("x")).agg(F.sum("n").alias("n"))
    groups = groups.select(F.col("node").alias("y"), "component")
    joined = nodes.select("node", "copies").join(counted, F.col("node") == F.col("x"), "left").join(groups, F.col("node") == F.col("y"), "left")
    placed = joined.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    placed = good.select("vec_id", "node").join(placed.withColumnRenamed("node", "z"), F.col("node") == F.col("z")).select("vec_id", "n_links", "component")
    placed = checkpointed(placed)
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    good_rows = placed.join(least, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return good_rows.union(bad)
