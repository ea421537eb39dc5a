"""The ordered sequence of two events as a stream: state per entity, event-time timers.

Events wait in their entity's state until the watermark has passed them; from then on their order is final. They are taken in
order, and an event that matches the second condition directly after one that matches the first, close enough in time, is a
hit. What stays is the last event taken, and only while something may still follow it in time; then the entity is forgotten.
State is written to the checkpoint with the offsets, so a restarted stream neither loses nor doubles a hit.

Results equal ``shapes.adjacent_sequence`` over the same events, but for events later than the watermark, which are dropped.
An entity's events of one micro-batch and those not yet passed by the watermark are held by one task: with the delay and the
size of batches that is a bound of what a hot entity costs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep several variables per key, which the default state store cannot."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


class DirectlyFollowed(StatefulProcessor):
    """Emits (first, second) ids of neighbouring events; times are microseconds."""

    def __init__(self, by: str, id_kind: str, max_micros: int) -> None:
        self.by, self.id_kind, self.max_micros = by, id_kind, max_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = f"at bigint, id {self.id_kind}, is_first boolean, is_second boolean"
        self.handle = handle
        self.waiting = handle.getListState("waiting", kind)
        self.last = handle.getValueState("last", kind)

    def wake_at(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            events = [
                (int(at), id_, bool(is_first), bool(is_second))
                for at, id_, is_first, is_second in zip(batch["micros"], batch["id"].tolist(), batch["is_first"], batch["is_second"], strict=True)
            ]
            if events:
                self.waiting.appendList(events)
                first = min(e[0] for e in events)
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.wake_at(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        final = [e for e in waiting if e[0] <= now]
        later = waiting[len(final) :]
        last = tuple(self.last.get()) if self.last.exists() else None
        found = []
        for event in final:
            if last is not None and last[2] and event[3] and event[0] - last[0] <= self.max_micros:
                found.append((key[0], last[1], event[1]))
            last = event
        if later:
            self.waiting.put(later)
            self.wake_at(later[0][0])
        else:
            self.waiting.clear()
        if last is not None and last[2] and (later or last[0] + self.max_micros > now):
            self.last.update(last)
            if not later:  # forget it when nothing can follow it in time any more
                self.wake_at(last[0] + self.max_micros)
        elif last is not None and later:
            self.last.update(last)
        else:
            self.last.clear()
        if found:
            yield pd.DataFrame(found, columns=[self.by, "first_event", "second_event"])

    def close(self) -> None:
        pass


def adjacent_sequences(
    events: DataFrame, by: str, time: str, tie: str, first: Column, second: Column, max_seconds: int, delay: str = "1 hour"
) -> DataFrame:
    """(by, first_event, second_event) of a stream, as ``shapes.adjacent_sequence`` gives them of a table.

    Start it inside ``keyed_state`` and in append mode. Events without a time or an entity are left out; conditions that are
    null count as false.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.filter(F.col(by).isNotNull() & F.col(time).isNotNull()).select(
        F.col(by).alias("entity"), F.col(time).cast("timestamp").alias("time"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"),
        F.col(tie).alias("id"), F.coalesce(first, F.lit(False)).alias("is_first"), F.coalesce(second, F.lit(False)).alias("is_second"),
    )
    schema = f"`{by}` {kinds[by]}, first_event {kinds[tie]}, second_event {kinds[tie]}"
    processor = DirectlyFollowed(by, kinds[tie], max_seconds * 1_000_000)
    return rows.withWatermark("time", delay).groupBy("entity").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
