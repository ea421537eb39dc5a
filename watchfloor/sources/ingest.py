"""A rule corpus kept as a table: only files that changed are parsed again.

A run compares the digest of every file with the state the run before left. New and changed files are parsed and their records
written below the run's own folder; the next state says of each file which run holds its records, and of a file that is gone
that it is (a tombstone, kept so that the change can be reported). Readers join records to the latest state. Records are
only ever added and the state is written last, as a folder of its own, so a run that fails leaves what was there, and may be
repeated. ``compact`` writes what is current as one run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfloor.session import rewritten
from watchfloor.sources import rules

STATE = "path STRING, digest STRING, run STRING, error STRING, gone BOOLEAN"


@dataclass(frozen=True)
class Change:
    """What a run found: ``files`` is (path, change) with change one of added, changed, removed."""

    run: str
    files: DataFrame


class RuleStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        names = [s.getPath() for s in files.listStatus(place)]
        done = [p.getName() for p in names if files.exists(p.suffix("/_SUCCESS"))]
        return sorted(int(n.removeprefix("version=")) for n in done)

    def state(self) -> DataFrame:
        """(path, digest, run, error, gone) of every file ever seen, as the last finished run left it."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.path}/state/version={versions[-1]}")

    def _finish(self, state: DataFrame) -> None:
        state.write.parquet(f"{self.path}/state/version={max(self._versions(), default=0) + 1}")

    def ingest(self, folder: str, recursive: bool = True) -> Change:
        """Bring the store up to what ``folder`` holds now."""
        run = uuid.uuid4().hex
        files = rules.scan_files(self.spark, folder, recursive).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
        before = self.state()
        now = rewritten(files.select("path", "digest"), "rule-digests")
        known = before.filter("NOT gone").select("path", F.col("digest").alias("_digest"))
        both = now.join(known, "path", "full_outer")
        change = F.when(F.col("digest").isNull(), "removed").when(F.col("_digest").isNull(), "added").when(F.col("digest") != F.col("_digest"), "changed")
        changes = rewritten(both.select("path", "digest", change.alias("change")).filter("change IS NOT NULL"), "rule-changes")
        fresh = changes.filter("change <> 'removed'").select("path")
        loaded = rules.load(rules.route(files.drop("digest").join(fresh, "path", "left_semi")))
        loaded = rewritten(loaded, "rule-blocks")
        rules.normalise(loaded.filter("error IS NULL")).withColumn("_run", F.lit(run)).write.parquet(f"{self.path}/records/{run}")
        errors = loaded.filter("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"))
        parsed = changes.filter("change <> 'removed'").join(errors, "path", "left").select("path", "digest", F.lit(run).alias("run"), "error", F.lit(False).alias("gone"))
        removed = before.join(changes.filter("change = 'removed'").select("path"), "path", "left_semi").withColumn("gone", F.lit(True))
        kept = before.join(changes.select("path"), "path", "left_anti")
        self._finish(kept.unionByName(removed.select(kept.columns)).unionByName(parsed))
        return Change(run, changes.select("path", "change"))

    def records(self) -> DataFrame:
        """The canonical records of all files that are there."""
        if not self._versions():
            raise ValueError(f"{self.path} holds no finished run")
        current = self.state().filter("NOT gone").select("path", F.col("run").alias("_run"))
        return self.spark.read.parquet(f"{self.path}/records/*").join(current, ["path", "_run"]).drop("_run")

    def errors(self) -> DataFrame:
        """(path, error) of files that could not be read."""
        return self.state().filter("NOT gone AND error IS NOT NULL").select("path", "error")

    def compact(self) -> None:
        """Write what is current as one run, so that readers open no superseded records; older runs stay until they are deleted."""
        run, state = uuid.uuid4().hex, self.state()
        self.records().withColumn("_run", F.lit(run)).write.parquet(f"{self.path}/records/{run}")
        self._finish(state.filter("NOT gone").withColumn("run", F.lit(run)))
