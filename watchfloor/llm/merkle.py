"""Merkle manifest of a data set: digests of rows, trees over them, proofs and their verification.

Rows are leaves; each tree (a source) orders its own. While a tree has several nodes, every ``fanout`` neighbours become
their parent. Siblings meet by equality: for each slot behind the first, nodes are joined to the index of their family's
first node, which is computed from their own (index XOR 1 for pairs, index minus slot otherwise). The rows of slot zero then
hold the whole family and emit the parent. The roots of the trees, in order of the trees' names, are leaves of one more tree.

Places in a tree come from ranges of the whole order, so a tree may hold all rows. Levels shrink by ``fanout``; all joins
together move about 1.5 times the leaves. Proofs go back down the same families: a parent hands its path to its children,
each of which puts its siblings in front. A family of leaves carries the rows' own columns, so the longest paths are never
joined or shuffled. Levels are written
as tables and read again, because a checkpoint keeps the size that the planner guessed for a chain of joins, a number that doubles
its digits with each level. Digests are kept as 32 bytes and hashed as hexadecimal text.

Defined results: the digest of a null is that of ``-``, of any other value its length in bytes, ``:`` and its text, so an
empty text and a null differ. A null tree is a tree of its own, first in order. Null ids come first; ties are ordered by
digest, and rows alike in all columns are neighbours with a place each. Extra columns are not read. An empty table has no
leaves, and no root: no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.llm.common import checkpointed, numbered, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ONE = "all"  # the tree of the trees' roots


def digest(*texts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*texts).cast("binary"), 256))


def as_text(node: Column) -> Column:
    """Digests, one behind the other, as lower-case hexadecimal text."""
    return F.lower(F.hex(node))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*map(field, values))


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", tree_col: str = "source", seen: dict[str, Column] | None = None) -> DataFrame:
    """tree, doc_id, h, seen, idx, n: each row's digest, the digest of what is seen of it now (``seen``: other contents of
    some columns), its place in its tree and the tree's size."""
    now = {c: F.col(f"`{c}`") for c in columns} | (seen or {})
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    rows = docs.select(
        tree.alias("tree"),
        F.col(f"`{id_col}`").alias("doc_id"),
        leaf([F.col(f"`{c}`") for c in columns]).alias("h"),
        leaf([now[c] for c in columns]).alias("seen"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stored(numbered(checkpointed(rows), "tree", "doc_id", "h", "row").drop("row"), "merkle-leaves")


def families(nodes: DataFrame, fanout: int, carried: tuple[str, ...]) -> DataFrame:
    """tree, idx, n, h of the parents of ``nodes``, and their children: h and the ``carried`` columns."""
    slot, one = F.col("idx") % fanout, F.struct("h", *carried)
    first = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if fanout == 2 else F.col("idx") - slot
    joined = nodes.filter(slot == 0).select("tree", "idx", "n", one.alias("child0"))
    for k in range(1, fanout):
        joined = joined.join(nodes.filter(slot == k).select("tree", first.alias("idx"), one.alias(f"child{k}")), ["tree", "idx"], "left")
    children = F.filter(F.array(*[F.col(f"child{k}") for k in range(fanout)]), lambda c: c.isNotNull())
    return joined.select(
        "tree",
        F.floor(F.col("idx") / fanout).alias("idx"),
        F.ceil(F.col("n") / fanout).alias("n"),
        digest(*[F.coalesce(as_text(F.col(f"child{k}.h")), F.lit("")) for k in range(fanout)]).alias("h"),
        children.alias("children"),
    )


class Forest:
    """Trees over ``nodes`` (tree, idx, n, h and ``carried`` columns): the families of each level and the top of each tree."""

    def __init__(self, nodes: DataFrame, fanout: int, carried: tuple[str, ...] = ()):
        self.nodes, self.fanout, self.carried, self.levels = nodes, fanout, carried, []
        most = nodes.agg(F.max("n")).first()[0] or 0
        level, tops = nodes, []
        while True:
            tops.append(level.filter("n = 1").select("tree", "h", F.lit(len(tops)).alias("height"), *(carried if not self.levels else ())))
            if most <= 1:
                break
            parents = stored(families(level.filter("n > 1"), fanout, () if self.levels else carried), "merkle-level")
            self.levels.append(parents)
            level, most = parents.select("tree", "idx", "n", "h"), -(-most // fanout)
        self.lone = tops[0]
        self.tops = reduce(DataFrame.union, [t.select("tree", "h", "height") for t in tops])

    def manifest(self) -> DataFrame:
        """tree, level, idx, digest of every node."""
        below = self.nodes.select("tree", F.lit(0).alias("level"), "idx", "h")
        above = [rows.select("tree", F.lit(k + 1).alias("level"), "idx", "h") for k, rows in enumerate(self.levels)]
        return reduce(DataFrame.union, above, below).withColumn("digest", as_text(F.col("h"))).drop("h")

    def paths(self, tops: DataFrame) -> DataFrame:
        """tree, idx, h, the carried columns, path and the other columns of ``tops`` (tree, height, path, ...) for each
        leaf: its siblings (left and right of it) level by level, then the path of its tree's top."""
        kept = [c for c in tops.columns if c not in ("tree", "height", "path")]
        known = None
        for k in reversed(range(len(self.levels))):
            here = tops.filter(F.col("height") == k + 1).select("tree", F.lit(0).cast("long").alias("idx"), "path", *kept)
            known = here if known is None else known.select(here.columns).union(here)
            rows = self.levels[k].select("tree", "idx", "children").join(known, ["tree", "idx"])
            rows = rows.select("tree", "idx", "children", "path", *kept, F.posexplode("children").alias("slot", "child"))
            hashes = F.transform("children", lambda c: c["h"])
            slot = F.col("slot")
            left = F.array_join(F.transform(F.slice(hashes, F.lit(1), slot), as_text), "")
            right = F.array_join(F.transform(F.slice(hashes, slot + 2, F.lit(self.fanout)), as_text), "")
            step = F.struct(F.unhex(left).alias("left"), F.unhex(right).alias("right"))
            carried = [F.col(f"child.{c}").alias(c) for c in self.carried] if not k else []
            known = rows.select("tree", (F.col("idx") * self.fanout + slot).alias("idx"), F.col("child.h").alias("h"), *carried, F.concat(F.array(step), "path").alias("path"), *kept)
            if k:  # one level of joins, and of what they broadcast, at a time
                known = stored(known, "merkle-paths")
        lone = self.lone.join(tops.filter("height = 0").select("tree", "path", *kept), "tree").withColumn("idx", F.lit(0).cast("long"))
        return lone if known is None else known.unionByName(lone.drop("height"))


def proved(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", tree_col: str = "source", fanout: int = 3, seen: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, h, seen, subroot, root, path for each row of ``docs``; digests as bytes."""
    trees = Forest(leaves(docs, columns, id_col, tree_col, seen), fanout, ("doc_id", "seen"))
    tops = stored(numbered(checkpointed(trees.tops.withColumn("all", F.lit(ONE))), "all", "tree"), "merkle-roots")
    roots = tops.select(F.col("all").alias("tree"), "idx", "n", "h", F.col("tree").alias("of"), F.col("height").alias("levels"))
    above = Forest(roots, fanout, ("of", "levels"))
    no_path = F.expr("CAST(array() AS array<struct<left: binary, right: binary>>)")
    to_root = above.paths(above.tops.select("tree", "height", no_path.alias("path"), F.col("h").alias("root")))
    to_root = stored(to_root.select(F.col("of").alias("tree"), F.col("levels").alias("height"), "path", F.col("h").alias("subroot"), "root"), "merkle-roots")
    return trees.paths(to_root).select("doc_id", "h", "seen", "subroot", "root", "path")


def proof_text(path: Column) -> Column:
    """All siblings of a path as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(as_text(s["left"]), as_text(s["right"]))), "")


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` (hexadecimal text) leads to."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(as_text(s["left"]), node, as_text(s["right"])).cast("binary"), 256))


def verified(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", tree_col: str = "source", fanout: int = 3, seen: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (array of left and right siblings), folded_root and verified for each row: does what
    is seen of it now still lead to the root? All digests but those of ``proof`` are lower-case hexadecimal text."""
    rows = proved(docs, columns, id_col, tree_col, fanout, seen)
    hexes = rows.select("doc_id", *[as_text(F.col(c)).alias(n) for c, n in (("h", "leaf"), ("subroot", "subroot"), ("root", "root"))], F.col("path").alias("proof"), folded(as_text(F.col("seen")), F.col("path")).alias("folded_root"))
    return hexes.withColumn("verified", F.col("folded_root") == F.col("root"))
