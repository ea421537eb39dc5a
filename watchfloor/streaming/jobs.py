"""The continuous jobs.

The file source reads each file once and does not follow one that grows: it takes closed (rotated) segments moved
into its folder. ``tailed_audit_events`` follows files that grow and are rotated. Pass ``available_now=True`` to drain what is
there and stop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchfloor.operators import matching
from watchfloor.operators.predicates import Fields
from watchfloor.operators.telemetry import parse_audit_lines
from watchfloor.plans.match import Backend, match_corpus
from watchfloor.session import configured_folder
from watchfloor.sources.tail import tail
from watchfloor.sources.telemetry import events_from_json, with_event_date

FILES_PER_BATCH = 1_000


def segments(spark: SparkSession, folder: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def audit_events(spark: SparkSession, folder: str, host: str = "", vm: str = "") -> DataFrame:
    """Audit text segments -> telemetry rows."""
    return parse_audit_lines(segments(spark, folder), host, vm)


def tailed_audit_events(spark: SparkSession, folder: str, pattern: str = "*", host: str = "", vm: str = "") -> DataFrame:
    """Audit files that still grow -> telemetry rows, every line once."""
    return parse_audit_lines(tail(spark, folder, pattern).select("value"), host, vm)


def shipped_events(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines segments -> telemetry rows."""
    return with_event_date(events_from_json(segments(spark, folder)))


def append_store(events: DataFrame, path: str, name: str, available_now: bool = False,
                 every: str = "1 minute", checkpoint: str | None = None) -> StreamingQuery:
    """Append a telemetry stream to the daily-partitioned store."""
    writer = events.writeStream.format("parquet").partitionBy("event_date").option("path", path)
    return _start(writer, events.sparkSession, name, available_now, every, checkpoint)


def hourly_alerts(
    events: DataFrame, rule_technique: DataFrame, time: str = "timestamp", delay: str = "1 hour"
) -> DataFrame:
    """(hour_start, rule_id, n): rules that fired in an hour, emitted once the watermark passes its end.

    The watermark follows all events, not only those that hit a rule, so a quiet rule's last hour is still closed.
    Events later than ``delay`` are dropped, which the batch report does not do. The rules are a static table.
    """
    hits = matching.technique_hits(events.withWatermark(time, delay), rule_technique, keep=(time,))
    windowed = hits.groupBy(F.window(time, "1 hour").alias("w"), "rule_id").agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.col("w.start").alias("hour_start"), "rule_id", "n")


def append_alerts(alerts: DataFrame, path: str, name: str, available_now: bool = False,
                  every: str = "5 minutes", checkpoint: str | None = None) -> StreamingQuery:
    writer = alerts.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer, alerts.sparkSession, name, available_now, every, checkpoint)


def revalidate(
    events: DataFrame,
    load_rules: Callable[[], DataFrame],
    path: str,
    name: str,
    whole_words: bool = False,
    available_now: bool = False,
    every: str = "1 minute",
    checkpoint: str | None = None,
    fields: Fields | None = None,
    dispatch: str | None = None,
) -> StreamingQuery:
    """Match every micro-batch against the rules as they are at that moment.

    Hit counts are written per batch id, overwriting that batch's folder only, so a batch that is retried after a
    failure is not counted twice. Sum over batches for totals. ``revalidate_changed`` runs changed rules over what is
    already stored.
    """

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        own = fields or Fields.of(batch.schema)
        counts = matching.layer_counts(batch, matching.compile_rules(load_rules(), own, dispatch=dispatch), whole_words)
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = events.writeStream.foreachBatch(evaluate)
    return _start(writer, events.sparkSession, name, available_now, every, checkpoint)


def revalidate_changed(
    rules: DataFrame, seen: DataFrame | None, backend: Backend, name: str = "local", start: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(results, snapshot): the rules that are new or differ from ``seen`` matched against the telemetry there is.

    A rule is compared by a digest of what it is matched by. Keep the snapshot and pass it as ``seen`` next time.
    """
    state = F.sha2(F.to_json(F.struct("name", "techniques", "keywords", "detection"), {"ignoreNullFields": "false"}), 256)
    snapshot = rules.select("rule_id", state.alias("digest"))
    changed = rules if seen is None else rules.join(snapshot.join(seen, ["rule_id", "digest"], "left_anti"), "rule_id", "left_semi")
    return match_corpus(changed, backend, name, start), snapshot


def _start(writer, spark: SparkSession, name: str, available_now: bool, every: str, checkpoint: str | None) -> StreamingQuery:
    """Start a query. Its offsets live in ``checkpoint``, by default below the session's ``spark.checkpoint.dir``; a stream
    without either would forget them with the process, so it is not started."""
    if checkpoint is None:
        folder = configured_folder(spark)
        if not folder:
            raise ValueError("a stream needs a checkpoint folder: pass one or set spark.checkpoint.dir")
        checkpoint = f"{folder}/streams/{name}"
    writer = writer.option("checkpointLocation", checkpoint).queryName(name)
    trigger = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return trigger.start()
