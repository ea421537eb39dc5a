"""Continuous re-validation as running totals, with rules that change while the stream runs.

Every micro-batch is kept below its own id, with the hits of all rules in it. A rule is known by a digest of what it is matched
by, and its versions by the batch in which they first appear. When a rule changes, only that rule meets the earlier batches
again; hits of its older versions count no longer. All that a batch writes lies below its id and is overwritten when the batch
is retried, so nothing is counted twice, and totals are sums over what is there: equal to matching all events at once by the
rules as they are now. A rule that goes back to an older form is a new version, and one that is removed keeps its last total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from watchfloor.operators.layers import Broad, Conditions
from watchfloor.operators.predicates import Fields
from watchfloor.session import rewritten
from watchfloor.streaming.jobs import _start

HITS = "rule_id STRING, version BIGINT, field_hits BIGINT, broad_hits BIGINT"
VERSIONS = "rule_id STRING, digest STRING"


def digests(rules: DataFrame) -> DataFrame:
    """(rule_id, digest) of what each rule is matched by."""
    state = F.to_json(F.struct("techniques", "keywords", "detection"), {"ignoreNullFields": "false"})
    return rules.select(F.col("rule_id").cast("string").alias("rule_id"), F.sha2(state, 256).alias("digest"))


class RunningTotals:
    """What a stream's batches found so far, below ``path``. ``load_rules`` gives the rules as they are (``matchable`` columns)."""

    def __init__(self, path: str, load_rules: Callable[[], DataFrame], fields: Fields | None = None, whole_words: bool = False) -> None:
        self.path, self.load_rules, self.fields, self.whole_words = path.rstrip("/"), load_rules, fields, whole_words

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """All batches of a table; ``batch_id`` says which."""
        below = f"{self.path}/{name}"
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(below)
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return spark.createDataFrame([], f"{schema}, batch_id BIGINT")
        return spark.read.schema(f"{schema}, batch_id BIGINT").parquet(below)

    def _keep(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch_id}")

    def _hits(self, events: DataFrame, rules: DataFrame, versions: DataFrame) -> DataFrame:
        conditions = Conditions(rules, self.fields or Fields.of(events.schema))
        counts = conditions.counts(events).join(Broad.of(rules, self.whole_words).counts(events), "rule_id", "full_outer")
        zero = F.lit(0).cast("bigint")
        return counts.join(versions.select("rule_id", "version"), "rule_id").select(
            "rule_id", "version", F.coalesce("field_hits", zero).alias("field_hits"), F.coalesce("broad_hits", zero).alias("broad_hits")
        )

    def versions(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """(rule_id, version, digest): the latest version of each rule, or the latest before a batch."""
        rows = self._table(spark, "rules", VERSIONS)
        rows = rows if before is None else rows.filter(F.col("batch_id") < before)
        latest = F.row_number().over(W.partitionBy("rule_id").orderBy(F.desc("batch_id")))
        return rows.withColumn("_rn", latest).filter("_rn = 1").select("rule_id", F.col("batch_id").alias("version"), "digest")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one micro-batch; for ``foreachBatch``."""
        spark = batch.sparkSession
        self._keep(batch, "events", batch_id)
        everything = spark.read.schema(StructType([*batch.schema, StructField("batch_id", LongType())])).parquet(f"{self.path}/events")
        rules = rewritten(self.load_rules(), "rules-now")
        known = self.versions(spark, before=batch_id)
        changed = rewritten(digests(rules).join(known.select("rule_id", "digest"), ["rule_id", "digest"], "left_anti"), "rules-changed")
        self._keep(changed, "rules", batch_id)
        now = changed.select("rule_id", F.lit(batch_id).cast("bigint").alias("version")).union(
            known.join(changed, "rule_id", "left_anti").select("rule_id", "version")
        )
        self._keep(self._hits(everything.filter(F.col("batch_id") == batch_id).drop("batch_id"), rules, now), "hits", batch_id)
        if not changed.isEmpty():
            ids = changed.select(F.col("rule_id").alias("_rule"))
            again = rules.join(ids, F.col("rule_id").cast("string") == F.col("_rule"), "left_semi")
            earlier = everything.filter(F.col("batch_id") < batch_id).drop("batch_id")
            self._keep(self._hits(earlier, again, now), "rewound", batch_id)

    def totals(self, spark: SparkSession) -> DataFrame:
        """(rule_id, field_hits, broad_hits) of every rule's latest version over all batches."""
        found = self._table(spark, "hits", HITS).unionByName(self._table(spark, "rewound", HITS))
        return found.join(self.versions(spark), ["rule_id", "version"]).groupBy("rule_id").agg(
            F.sum("field_hits").alias("field_hits"), F.sum("broad_hits").alias("broad_hits")
        )

    def start(self, events: DataFrame, name: str, available_now: bool = False, every: str = "1 minute", checkpoint: str | None = None) -> StreamingQuery:
        return _start(events.writeStream.foreachBatch(self), events.sparkSession, name, available_now, every, checkpoint)
