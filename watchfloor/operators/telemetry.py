"""Projections and small reports over telemetry tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.functions.audit import (
    event_time, record_fields, record_serial, record_time, record_type, syscall_name, technique_of_key,
)
from watchfloor.schemas import EVENT_FIELDS

# Container labels a shipper adds and the store must not keep.
SHIPPER_LABELS = ("label", "container_created_at", "container_id", "container_name", "image", "stream")
SHIPPER_FILE_FIELDS = ("message", "file", "source_type")


def parse_audit_lines(lines: DataFrame, host: str = "", vm: str = "", line: str = "value") -> DataFrame:
    """Audit text -> telemetry rows; blank lines are skipped. Works on batch and streaming input alike."""
    text = F.trim(line)
    parsed = lines.filter(text != "").select(
        record_time(text).alias("timestamp"),
        record_serial(text).alias("serial"),
        record_type(text).alias("type"),
        record_fields(text).alias("f"),
    )

    def field(name: str) -> Column:
        return F.try_element_at("f", F.lit(name))

    own = {
        "technique": technique_of_key(field("key")),
        "source": F.lit("auditd"),
        "host": F.lit(host),
        "vm": F.lit(vm),
        "type": F.coalesce(field("type"), F.col("type")),
        "syscall_name": syscall_name(field("syscall")),
    }
    columns = [own.get(name, field(name)).cast("string").alias(name) for name in EVENT_FIELDS]
    rest = F.map_filter("f", lambda k, v: ~k.isin(*EVENT_FIELDS))
    return parsed.select(
        "timestamp", *columns, "serial", field("returncode").try_cast("int").alias("returncode"), rest.alias("attrs")
    ).withColumn("event_date", F.to_date("timestamp"))


def merge_json(df: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """Merge a JSON object column over the row: a parsed field wins, the row's own value fills in.

    ``fields`` maps each field to its type. Text that is not JSON leaves the row as it was.
    """
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    parsed = df.withColumn("_parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    merged = {}
    for name in fields:
        value = F.col("_parsed")[name]
        merged[name] = F.coalesce(value, F.col(name)) if name in df.columns else value
    return parsed.withColumns(merged).drop("_parsed")


def normalise_shipped(df: DataFrame, fields: Mapping[str, str], drop: Sequence[str] = SHIPPER_LABELS) -> DataFrame:
    """Shipper normalisation: JSON in ``message`` merged over the event, labels dropped, time parsed."""
    out = merge_json(df, "message", fields).drop(*drop)
    kind = dict(out.dtypes).get("timestamp")
    if kind == "string":
        out = out.withColumn("timestamp", event_time(F.col("timestamp")))
    return out


def daily_counts(events: DataFrame, time: str = "timestamp") -> DataFrame:
    return events.groupBy(F.to_date(time).alias("event_date")).agg(F.count(F.lit(1)).alias("n"))


def recent_events(events: DataFrame, n: int, time: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """Latest ``n`` events; each task forwards only its own top ``n``."""
    return events.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change) between two snapshots: ``added``, ``removed`` or ``modified``; unchanged rows are dropped."""
    old = previous.select(key, F.col(version).alias("_old"), F.lit(True).alias("_in_old"))
    new = current.select(key, F.col(version).alias("_new"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    return old.join(new, key, "full").select(key, change.alias("change")).filter(F.col("change").isNotNull())
