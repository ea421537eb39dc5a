"""Telemetry in and out: JSON lines, audit text, and the daily-partitioned store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfloor.functions.audit import event_time
from watchfloor.operators.matching import since
from watchfloor.schemas import EVENT_FIELDS

SKETCH_BITS = 14  # 2**14 registers a sketch, 8 KB
TIME_KEYS = ("timestamp", "@timestamp")
NUMBER_FIELDS = {"serial": "bigint", "returncode": "int"}


def events_from_json(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines -> telemetry rows, for batch and streaming input.

    Each line is parsed once, as a map: promoted keys become columns, all others stay in ``attrs``. Blank and
    malformed lines are skipped, by way of an empty array: a filter would be pushed below and parse every line twice.
    """
    objects = F.array_compact(F.array(F.from_json(line, "MAP<STRING, STRING>")))
    parsed = lines.select(F.explode(objects).alias("f"))

    def field(name: str) -> Column:
        return F.try_element_at("f", F.lit(name))

    promoted = (*EVENT_FIELDS, *NUMBER_FIELDS, *TIME_KEYS)
    return parsed.select(
        event_time(F.coalesce(*[F.nullif(field(k), F.lit("")) for k in TIME_KEYS])).alias("timestamp"),
        *[field(name).alias(name) for name in EVENT_FIELDS],
        *[field(name).try_cast(kind).alias(name) for name, kind in NUMBER_FIELDS.items()],
        F.map_filter("f", lambda k, v: ~k.isin(*promoted)).alias("attrs"),
    )


def read_events(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    """Telemetry from JSON-lines files, optionally from ``start`` on; events without a readable time are kept."""
    return since(events_from_json(spark.read.text(path)), start)


def rejected_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The non-blank lines ``events_from_json`` skips."""
    return lines.filter((F.trim(line) != "") & F.from_json(line, "MAP<STRING, STRING>").isNull())


def with_event_date(events: DataFrame, time: str = "timestamp") -> DataFrame:
    return events.withColumn("event_date", F.to_date(time))


def write_store(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write one folder per day.

    The rebalance hint lets AQE split a day that holds far more than the others and merge small ones, so that
    neither one huge nor thousands of tiny files appear.
    """
    with_event_date(events).hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def read_store(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Read the store; day bounds prune whole folders before any file is opened."""
    events = spark.read.parquet(path)
    if first_day:
        events = events.filter(F.col("event_date") >= F.to_date(F.lit(first_day)))
    if last_day:
        events = events.filter(F.col("event_date") <= F.to_date(F.lit(last_day)))
    return events


def with_position(rows: DataFrame, name: str = "position") -> DataFrame:
    """Rows as read from files (before any other step), with where each stands: file, block and row. Sorting by it gives the
    order of the files whatever tasks read them, and however rows are dealt later."""
    hidden = F.col("_metadata")
    in_file = hidden["row_index"] if _has_row_index(rows) else F.monotonically_increasing_id()  # counts up inside a block
    return rows.select("*", F.struct(hidden["file_path"].alias("file"), hidden["file_block_start"].alias("block"), in_file.alias("row")).alias(name))


def _has_row_index(rows: DataFrame) -> bool:
    return "row_index" in rows.select("_metadata").schema["_metadata"].dataType.names


def store_counts(events: DataFrame) -> DataFrame:
    """Documents per day, the statistics of the store."""
    return events.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


def store_sketches(events: DataFrame, *columns: str) -> DataFrame:
    """A row per day: events, and of each column a sketch of its distinct values, to be kept beside the store. Sketches of any
    days unite (``distinct_values``), where exact counts do not add up."""
    return events.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n"), *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)).alias(c) for c in columns]
    )


def distinct_values(sketches: DataFrame, *columns: str, by: Sequence[str] = (), first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Estimated distinct values of each column over a range of days, per ``by``; about 1 % off (two standard errors: 1.6 %)."""
    rows = sketches
    if first_day:
        rows = rows.filter(F.col("event_date") >= F.to_date(F.lit(first_day)))
    if last_day:
        rows = rows.filter(F.col("event_date") <= F.to_date(F.lit(last_day)))
    united = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns]
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *united)
