"""Large JSON documents read by many tasks: the objects of an array, found from any byte on.

A byte in the middle of a document says little: whether it is inside a string depends on all quotes before it. So ranges of
a file are read twice. First each range counts, for either answer, its quotes and how much deeper or higher its brackets
lead; sums over the ranges before it then give every range its state and depth. With these each range finds the objects
that begin in it, and reads on past its end for the last one. Where an array is named, its opening is looked for first. No task holds more than a range and one object.

Files are opened inside tasks, so their folder must be one that every executor reaches (local, HDFS or object store paths).
Compressed files cannot be entered in the middle; read them with Spark's ``multiLine``. Elements that are no objects are left
out. Text behind a syntax error is read as its brackets and quotes suggest. An empty file has no records.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 8 << 20
COMPRESSED = r"(?i)\.(gz|bz2|zst|zstd|snappy|lz4|deflate)$"
QUOTE, BACKSLASH = 34, 92
OPENING, CLOSING = (91, 123), (93, 125)  # [ {  ] }


def open_file(uri: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def backslashes_before(file, at: int) -> int:
    """Length of the run of backslashes that ends just before a byte."""
    run, step = 0, 64
    while at:
        step = min(step, at)
        file.seek(at - step)
        data = file.read(step)
        held = len(data) - len(data.rstrip(b"\\"))
        run += held
        if held < step:
            break
        at, step = at - step, step * 2
    return run


def marks(data: np.ndarray, backslashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes that are not escaped; places of brackets; and the number of those quotes before each bracket."""
    slash = np.flatnonzero(data == BACKSLASH)
    first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
    length = np.diff(np.append(first, len(slash)))
    after = slash[first] + length
    if backslashes and len(slash) and slash[0] == 0:
        length[0] += backslashes
    elif backslashes % 2:
        after, length = np.append(0, after), np.append(1, length)
    quotes = np.setdiff1d(np.flatnonzero(data == QUOTE), after[length % 2 == 1], assume_unique=True)
    brackets = np.flatnonzero(np.isin(data, (*OPENING, *CLOSING)))
    return quotes, brackets, np.searchsorted(quotes, brackets)


def steps(data: np.ndarray, brackets: np.ndarray) -> np.ndarray:
    return np.where(np.isin(data[brackets], OPENING), 1, -1)


def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per range: are its quotes odd, and how deep does it lead if it begins outside or inside a string?"""
    for batch in batches:
        out = []
        for path, start, end in zip(batch["path"], batch["start"], batch["end"], strict=True):
            with open_file(path) as file:
                backslashes = backslashes_before(file, start)
                file.seek(start)
                data = np.frombuffer(file.read(end - start), np.uint8)
            quotes, brackets, before = marks(data, backslashes)
            step, inside = steps(data, brackets), before % 2 == 1
            out.append((path, start, end, len(quotes) % 2, int(step[~inside].sum()), int(step[inside].sum())))
        yield pd.DataFrame(out, columns=["path", "start", "end", "odd", "outside", "inside"])


def key_before(file, at: int) -> str | None:
    """The member name in front of the value that begins at a byte."""
    import json
    import re

    file.seek(max(0, at - 4096))
    found = re.search(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', file.read(min(at, 4096)), re.S)
    return json.loads(found.group(1)) if found else None


def rest_of(file, at: int, depth: int, level: int) -> bytes:
    """From a byte outside strings on, up to the bracket that leads back to ``level``."""
    parts, in_string, backslashes = [], 0, 0
    file.seek(at)
    while data := file.read(RANGE_BYTES):
        codes = np.frombuffer(data, np.uint8)
        quotes, brackets, before = marks(codes, backslashes)
        outside = (before + in_string) % 2 == 0
        depths = depth + np.cumsum(steps(codes, brackets[outside]))
        end = np.flatnonzero(depths == level)
        if len(end):
            parts.append(data[: brackets[outside][end[0]] + 1])
            return b"".join(parts)
        parts.append(data)
        depth = int(depths[-1]) if len(depths) else depth
        in_string = (in_string + len(quotes)) % 2
        backslashes = len(data) - len(data.rstrip(b"\\"))
    return b"".join(parts)


def outside_brackets(file, start: int, end: int, in_string: int, depth: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a range, its brackets outside strings, where each leads and how deep it is behind each."""
    backslashes = backslashes_before(file, start)
    file.seek(start)
    raw = file.read(end - start)
    data = np.frombuffer(raw, np.uint8)
    _, brackets, before = marks(data, backslashes)
    brackets = brackets[(before + in_string) % 2 == 0]
    step = steps(data, brackets)
    return raw, brackets, step, depth + np.cumsum(step)


def arrays_at(level: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, start, end, in_string, depth in zip(*(batch[c] for c in ("path", "start", "end", "in_string", "depth")), strict=True):
                with open_file(path) as file:
                    raw, brackets, step, depths = outside_brackets(file, start, end, in_string, depth)
                    opens = brackets[(step > 0) & (depths == level)].tolist()
                    out += [(path, start + at, key_before(file, start + at)) for at in opens if raw[at] == OPENING[0]]
            yield pd.DataFrame(out, columns=["path", "start", "key"])

    return find


def extractor(level: int, key: str | None):
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, end, in_string, depth, open_key in zip(*(batch[c] for c in ("path", "start", "end", "in_string", "depth", "open_key")), strict=True):
                out = []
                with open_file(path) as file:
                    raw, brackets, step, depths = outside_brackets(file, start, end, in_string, depth)
                    closes = np.flatnonzero((step < 0) & (depths == level))
                    wanted = key is None or open_key == key
                    for i in np.flatnonzero((step > 0) & ((depths == level) | (depths == level + 1))).tolist():
                        at = int(brackets[i])
                        if depths[i] == level:
                            wanted = key is None or (raw[at] == OPENING[0] and key_before(file, start + at) == key)
                        elif wanted and raw[at] == OPENING[1]:
                            close = np.searchsorted(closes, i)
                            text = raw[at : int(brackets[closes[close]]) + 1] if close < len(closes) else rest_of(file, start + at, level, level)
                            out.append((path, start + at, text.decode("utf-8", "replace")))
                yield pd.DataFrame(out, columns=["path", "start", "record"])

    return extract


def read_json_records(spark: SparkSession, path: str, key: str | None = None, level: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, record): the text of each object in the array named ``key`` of the top-level object, or in the top-level
    array if ``key`` is None, in files below ``path``; ``start`` is the byte at which it begins. ``level`` is for arrays that lie
    deeper: the number of brackets around an object."""
    level = level or (1 if key is None else 2)
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = files.select("path", "length", starts.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ranges.repartition(parts, "path", "start").mapInPandas(summaries, "path string, start bigint, end bigint, odd int, outside bigint, inside bigint")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    known = found.withColumn("in_string", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    deeper = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    known = known.withColumn("depth", F.coalesce(F.sum(deeper).over(before), F.lit(0)).cast("bigint")).select("path", "start", "end", "in_string", "depth")
    if key is None:
        known = known.withColumn("open_key", F.lit(None).cast("string"))
    else:
        # The array that a range begins in is the last that opened before it; a top-level object has as many as members.
        opened = known.repartition(parts, "path", "start").mapInPandas(arrays_at(level), "path string, start bigint, key string")
        opened = opened.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "key"))).alias("arrays"))
        before_it = F.filter("arrays", lambda a: a["start"] < F.col("start"))
        known = known.join(opened, "path", "left").withColumn("open_key", F.try_element_at(before_it, F.lit(-1))["key"]).drop("arrays")
    return known.repartition(parts, "path", "start").mapInPandas(extractor(level, key), "path string, start bigint, record string")


def documents(spark: SparkSession, path: str, key: str, record: DataType | str) -> DataFrame:
    """One row ``e`` for each object of the array ``key``, parsed by the schema ``record``. Compressed files are read whole."""
    if spark.read.format("binaryFile").load(path).select("path").filter(F.col("path").rlike(COMPRESSED)).isEmpty():
        return read_json_records(spark, path, key).select(F.from_json("record", record).alias("e"))
    kind = record if isinstance(record, str) else record.simpleString()
    kind = kind if kind.lower().startswith("struct<") else f"STRUCT<{kind}>"
    return spark.read.schema(f"`{key}` ARRAY<{kind}>").option("multiLine", True).json(path).select(F.explode(key).alias("e"))
