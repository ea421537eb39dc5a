"""Near-duplicate documents by weighted minwise hashing (BagMinHash), banding and exact verification.

A document is the multiset of its shingles (five lower-case words; a shorter text is one shingle). Weights are whole
numbers. The weight axis is cut into blocks (0,1], (1,2], (2,4], (4,8] ...; for each shingle and block a Poisson process of
one point per unit of weight runs in time, its points derived from hashes of shingle, block and count. A point also carries a
register and a place inside the block. A document takes the points whose place lies below its own weight: whole blocks as
they are, the last block thinned. Each register keeps the earliest point. Two documents agree in a register with
exactly the probability of their weighted Jaccard similarity, sum of minima over sum of maxima. A process is followed
only until it is later than every register, so a signature takes about n + m log m points.

Signatures are cut into bands; documents that share a band are candidates, and the similarity of candidates is
computed exactly on their whole texts. Equal multisets are collapsed first. Inside a band's bucket every member meets the
bucket's smallest member, its leader, and linked members become groups. Buckets that then still hold several groups are
open. Documents that share open buckets form clusters, and inside a cluster all are compared, block by block: the sums of
minima of two blocks of documents are one matrix product, and only a spanning forest of the links leaves the task. While
clusters are so large that this would send each document to more than four tasks (twice as many each turn), open buckets get
further leaders, drawn by hash, so that a dense group falls together at linear cost first. No pair that shares a bucket
is skipped unless its two documents are connected already.

Defaults: 32 bands of 6 of 192 registers miss a pair of similarity 0.8 in one bucket-sharing test out of 16,000, rarer above.

Defined results: null texts count as empty; texts without a word are copies of each other. Null ids are compared like
others; a group of null ids only has a null class. Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfloor.llm.common import GOLDEN, Powers, checkpointed, finish, map_batches, partitions, shingle_hashes
from watchfloor.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
CHEAP = 4  # copies of each open document that may be sent around instead of another turn of leaders
BLOCK, COLUMNS = 1024, 1024  # documents, and columns of shingles, that are multiplied out at once
GROUP = 512  # comparisons with one leader that a task takes on; a leader with more is sent to several


def unit(values: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((values >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def processes(hashes: np.ndarray, counts: np.ndarray, owner: np.ndarray):
    """(owner, key, size of block, how much of the block counts) of each shingle's blocks."""
    out = []
    start, size, block = 0, 1, 0
    while len(hashes):
        keys = finish(hashes + np.uint64((block + 1) * GOLDEN & (1 << 64) - 1))
        out.append((owner, keys, np.full(len(keys), size, np.float64), np.minimum(counts - start, size).astype(np.float64)))
        start, size, block = start + size, max(1, start + size), block + 1
        more = counts > start
        hashes, counts, owner = hashes[more], counts[more], owner[more]
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """One row of m registers (times of the earliest points) for each bag of (hashes, counts); infinite for empty bags."""
    registers = np.full((len(bags), m), np.inf)
    if not any(len(h) for h, _ in bags):
        return registers
    owner = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    owner, key, size, part = processes(np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags]), owner)
    flat, latest = registers.reshape(-1), np.full(len(bags), np.inf)
    time, point = np.zeros(len(key)), 0
    while len(key):
        point += 1
        draw = finish(key + np.uint64(point * GOLDEN & (1 << 64) - 1))
        time = time - np.log(unit(draw)) / size
        alive = time < latest[owner]
        owner, key, size, part, time, draw = (x[alive] for x in (owner, key, size, part, time, draw))
        draw = finish(draw ^ np.uint64(GOLDEN))
        place = (draw >> np.uint64(32)).astype(np.float64) * 2.0**-32 * size
        taken = place < part
        slot = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
        np.minimum.at(flat, (owner * m + slot.astype(np.int64))[taken], time[taken])
        latest = registers.max(1)
    return registers


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = registers.view(np.uint64).reshape(len(registers), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(registers), bands)).copy()
    for k in range(rows):
        key = finish(key * np.uint64(GOLDEN) + bits[:, :, k])
    return key


def bag(text: str, powers: Powers, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(text, width, powers), return_counts=True)


def likeness(a, b) -> float:
    """Weighted Jaccard similarity of two bags; two empty ones are equal."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - shared
    return shared / union if union else 1.0


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, node (digest of the bag), n (size of the bag) and bands of (doc_id, text); no shuffle."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            bags = [bag(t, powers, width) for t in batch.column("text").to_pylist()]
            keys = band_keys(signatures(bags, bands * rows), bands, rows).view(np.int64)
            lists = [k.tolist() if len(b[0]) else [] for k, b in zip(keys, bags, strict=True)]
            nodes = [hashlib.md5(h.tobytes() + c.astype(np.int64).tobytes()).digest() for h, c in bags]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.binary()), pa.array([int(c.sum()) for _, c in bags], pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "node", "n", "bands"],
            )

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, node binary, n long, bands array<long>")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, node, n, leader) of the members of buckets with more than one node."""
    members = nodes.select(F.explode("bands").alias("key"), "node", "n")
    leaders = members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return members.join(leaders, "key")


def compared(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs of nodes that are alike. Each b meets its a's in one task, or in several if there are many."""
    many = pairs.groupBy("b").count().filter(F.col("count") > GROUP).select(F.col("b").alias("hub"), F.ceil(F.col("count") / GROUP).alias("tasks"))
    part = F.pmod(F.xxhash64("a"), F.coalesce("tasks", F.lit(1)))
    dealt = checkpointed(pairs.join(many, F.col("b") == F.col("hub"), "left").select("a", "b", part.alias("part")))
    whole = dealt.join(texts, F.col("a") == F.col("node")).select("b", "part", "a", "text")
    hubs = dealt.select("b", "part").distinct().join(texts, F.col("b") == F.col("node")).select("b", "part", F.lit(None).cast("binary").alias("a"), "text")
    rows = whole.union(hubs).repartition(partitions(pairs.sparkSession), "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches):
        powers, hub = Powers(), None
        for batch in batches:
            out = []
            for b, a, text in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "text")), strict=True):
                if a is None:
                    hub = bag(text, powers, width)
                elif likeness(bag(text, powers, width), hub) >= similarity:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["a", "b"])

    return checkpointed(map_batches(rows, run, "a binary, b binary"))


def unresolved(members: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """The members of buckets that still hold several groups, with their group (``mine``) and, for this turn, another leader
    for each bucket and its group (``theirs``)."""
    placed = members.join(groups.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("key", "node", "n", F.coalesce("component", "node").alias("mine"))
    drawn = F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("draw"), "node", "mine")).alias("drawn")
    mixed = placed.groupBy("key").agg(drawn, F.min("mine").alias("low"), F.max("mine").alias("high")).filter("low <> high")
    mixed = mixed.select(F.col("key").alias("k"), F.col("drawn.node").alias("leader"), F.col("drawn.mine").alias("theirs"))
    return placed.join(mixed, F.col("key") == F.col("k")).drop("k")


def clusters(members: DataFrame) -> DataFrame:
    """(node, cluster, blocks): nodes that share an open bucket lie in one cluster; a cluster has blocks of about BLOCK nodes."""
    parts = components(members.select(F.col("node").alias("a"), F.col("leader").alias("b"))).withColumnRenamed("component", "cluster")
    sizes = parts.groupBy(F.col("cluster").alias("x")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return parts.join(sizes, F.col("cluster") == F.col("x")).select("node", "cluster", "blocks")


def shared_weights(bags: list, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum of minima of each bag of ``left`` with each of ``right``: products of 0/1 columns, one for each shingle and
    multiplicity that two bags have, some columns at a time."""
    owner = np.repeat(np.arange(len(bags)), [int(c.sum()) for _, c in bags])
    nth = np.concatenate([np.arange(int(k)) for _, c in bags for k in c] or [np.zeros(0, np.int64)]).astype(np.uint64)
    units = np.concatenate([np.repeat(h, c) for h, c in bags] or [np.zeros(0, np.uint64)])
    _, column, count = np.unique(finish(units + nth * np.uint64(GOLDEN)), return_inverse=True, return_counts=True)
    common = count[column] > 1
    owner, column = owner[common], column[common]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        grid = np.zeros((len(bags), COLUMNS), np.float32)
        grid[owner[a:b], column[a:b] - start] = 1
        total += grid[left] @ grid[right].T
    return total


def block_links(parts: DataFrame, groups: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b): links that connect the groups inside each cluster. Every node meets every other of its cluster, two blocks at a
    time; only a spanning forest of the links leaves a task."""
    placed = parts.join(groups.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("node", "cluster", "blocks", F.coalesce("component", "node").alias("mine"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(texts.withColumnRenamed("node", "x"), F.col("node") == F.col("x"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = placed.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "mine", "text")
    rows = rows.repartition(partitions(rows.sparkSession), "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "node")

    def settle(held):
        (low, high), nodes = held[0][0][1:], [h[2] for h in held]
        own = np.array([h[1] for h in held])
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        bags = [h[4] for h in held]
        size = np.array([int(c.sum()) for _, c in bags])
        shared = shared_weights(bags, left, right)
        alike = shared >= similarity * (size[left][:, None] + size[right][None, :] - shared)
        up = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        out = []
        for i, j in zip(*np.nonzero(alike), strict=True):
            a, b = left[i], right[j]
            one, two = find(held[a][3]), find(held[b][3])
            if one != two:
                up[max(one, two)] = min(one, two)
                out.append((nodes[a], nodes[b]))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["a", "b"])

    def run(batches):
        powers, held = Powers(), []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("cluster", "low", "high", "own", "node", "mine", "text"))
            for cluster, low, high, own, node, mine, text in zip(*columns, strict=True):
                if held and held[0][0] != (cluster, low, high):
                    yield settle(held)
                    held = []
                held.append(((cluster, low, high), own, node, mine, bag(text, powers, width)))
        if held:
            yield settle(held)

    return map_batches(rows, run, "a binary, b binary")


def near_copy_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, text_hash, class_id, kept: the class is the smallest id of the group, and its document is the one to keep (of
    rows that share the id, the one with the smallest text hash)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketches = checkpointed(sketched(source, bands, rows, width))
    nodes = sketches.groupBy("node").agg(F.first("bands").alias("bands"), F.first("n").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("one"))
    members = checkpointed(bucket_members(nodes))
    first = members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    needed = members.select("node").distinct().join(nodes.select(F.col("node").alias("x"), "one"), F.col("node") == F.col("x")).select("node", "one.*")
    same = source["doc_id"].eqNullSafe(needed["doc_id"]) & (source["text_hash"] == needed["text_hash"])
    texts = checkpointed(source.join(needed, same).select("node", "text").dropDuplicates(["node"]))
    links = compared(first, texts, width, similarity)
    groups = checkpointed(components(links))
    turn = 0
    while True:
        members = checkpointed(unresolved(members, groups, turn))
        if members.isEmpty():
            break
        parts = checkpointed(clusters(members))
        nodes, copies = parts.agg(F.count("*"), F.sum("blocks")).first()
        last = copies <= CHEAP * nodes << turn
        if last:
            links = block_links(parts, groups, texts, similarity, width)
        else:
            pairs = members.filter("mine <> theirs").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
            links = compared(pairs, texts, width, similarity)
        groups = checkpointed(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(checkpointed(links))))
        if last:
            break
        members, turn = members.select("key", "node", "n"), turn + 1
    grouped = sketches.join(groups.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("group"))
    best = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best"))
    joined = grouped.join(best, "group")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return joined.select("doc_id", "text_hash", F.col("best.doc_id").alias("class_id"), kept.alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, with all its columns; of rows that repeat it one stays."""
    kept = near_copy_groups(docs, id_col, text_col, **options).filter("kept")
    kept = checkpointed(kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")))
    once = kept.distinct()
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    mine = F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), id_.alias("id"), mine.alias("hash"))
    rows = rows.join(once, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    rows = rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
    if kept.count() > once.count():
        rows = rows.dropDuplicates([id_col, text_col])
    return rows
