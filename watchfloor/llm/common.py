"""Helpers shared by the operators: Arrow batches of bounded size, shared folders, hashing of words and bytes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchfloor.session import cut_lineage, shared_folder

# Rows handed to Python at once. Documents may be long, so the number is small.
BATCH_ROWS = 256

# 2**64 divided by the golden ratio, and the multipliers of the splitmix64 finaliser: fixed values of that public generator.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for long documents."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def in_bulk(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together until they hold ``size`` bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, held_bytes = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Memory(dict):
    """What was computed for texts. A full generation becomes the older one; what is used of it moves on, the rest goes."""

    def __init__(self, kept: int):
        self.kept, self.older = kept, {}

    def __missing__(self, text):
        value = self[text] = self.older[text]
        return value

    def new(self, texts) -> list:
        """Those of ``texts`` that are not known; they must be put in before they are asked for."""
        if len(self) > self.kept:
            self.older = dict(self)
            self.clear()
        return [t for t in texts if t not in self and t not in self.older]


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names."""
    return df.select(*[F.col(f"`{name}`").alias(new) for new, name in columns.items()])


# Spark's own setting: shuffle files go when the action that wrote them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, what an action shuffles goes when it ends."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder. What was shuffled on the way there is not needed again, so its
    files go at once instead of piling up over the rounds of an iterative operator."""
    with shuffles_dropped(df.sparkSession):
        return cut_lineage(df.select("*"))


def rewritten(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet below the shared checkpoint folder and read again."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``rewritten``, in a denser file; what was shuffled on the way goes at once."""
    folder = new_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(rows: DataFrame, group: str, *order: str, place: str = "idx", total: str = "n") -> DataFrame:
    """``rows`` with their place in their group (from 0, by ``order``) and the size of the group. Rows are dealt into ranges of
    (group, order), places are counted inside a range and moved on by the sizes of the ranges before it, so a group may hold
    all rows. ``group`` has no nulls; ``order`` must tell rows apart for the ranges to be even."""
    spark = rows.sparkSession
    dealt = checkpointed(rows.repartitionByRange(partitions(spark), group, *order).withColumn("part", F.spark_partition_id()))
    by_part = W.partitionBy(group).orderBy("part")
    parts = dealt.groupBy(group, "part").agg(F.count("*").alias("size"))
    parts = parts.select(
        F.col(group).alias("part_group"),
        F.col("part").alias("part_number"),
        F.coalesce(F.sum("size").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("size").over(W.partitionBy(group)).alias(total),
    )
    inside = F.row_number().over(W.partitionBy(group, "part").orderBy(*order)) - 1
    both = dealt.withColumn("inside", inside).join(parts, (F.col(group) == F.col("part_group")) & (F.col("part") == F.col("part_number")))
    return both.select(*rows.columns, (F.col("before") + F.col("inside")).alias(place), total)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder, as a URI or path; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def smallest_hashes(rows: DataFrame, key: str, hash_col: str, most: int) -> DataFrame:
    """Of each key the ``most`` rows with the smallest hash. Keys are few (classes, languages). A cut that leaves half as many
    again as wanted is made first, by counts alone, so that no task ranks more than that."""
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    if not counts:
        return rows
    cuts = {k: min((1 << 63) - 1, int((1 << 64) * 1.5 * (most + 30) / n) - (1 << 63)) for k, n in counts.items()}
    cut = F.element_at(F.create_map(*[F.lit(v) for pair in sorted(cuts.items()) for v in pair]), F.col(key))
    rank = F.row_number().over(W.partitionBy(key).orderBy(hash_col))
    return rows.filter(F.col(hash_col) <= cut).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def finish(values: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (splitmix64 finaliser)."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, for hashes of substrings from one running sum."""

    def __init__(self, base: int = GOLDEN | 1, length: int = 1 << 16):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)
        self.grow(length)

    def grow(self, length: int) -> None:
        if length > len(self.up):
            length = max(length, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(length, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Running sums of code * base**position, with a leading zero."""
        self.grow(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each codes[start:end], whatever its place."""
        return finish((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def shingle_hashes(text: str, width: int, powers: Powers) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` lower-case words, in order; a shorter text is one shingle, none if it has
    no word."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    words = powers.between(powers.sums(data), start, end)
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = out * np.uint64(MIX_2) + words[k : k + n]
    return finish(out)
