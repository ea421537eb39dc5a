"""Query shapes that shipped rules contain, as parameterised DataFrame functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchfloor.operators.predicates import Fields, rule_predicate


def hour_of(time: str) -> Column:
    return F.date_trunc("hour", F.col(time)).cast("timestamp_ntz")


def threshold(events: DataFrame, by: Sequence[Column], condition: Column) -> DataFrame:
    """Count per key and time bucket, kept where ``condition`` on the count ``n`` holds."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(condition)


def hourly_alerts(hits: DataFrame, by: str, more_than: int, time: str = "timestamp") -> DataFrame:
    """Hits per hour and key above a limit: the batch twin of the streaming monitor."""
    return threshold(hits, [hour_of(time).alias("hour_start"), F.col(by)], F.col("n") > more_than)


def spray(events: DataFrame, by: Sequence[str], account: str, reason: str) -> DataFrame:
    """Failures, distinct accounts and distinct reasons per key.

    Counted from the distinct (key, account) and (key, reason) pairs, so no task ever holds one key's values.
    """
    tagged = events.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.lit("account").alias("kind"), F.col(account).cast("string").alias("value")),
                F.struct(F.lit("reason").alias("kind"), F.col(reason).cast("string").alias("value")),
            )
        ).alias("item"),
    )
    pairs = tagged.groupBy(*by, "item").agg(F.count(F.lit(1)).alias("n"))
    is_account = F.col("item.kind") == "account"
    return pairs.groupBy(*by).agg(
        F.sum(F.when(is_account, F.col("n")).otherwise(0)).alias("failures"),
        F.count_if(is_account & F.col("item.value").isNotNull()).alias("accounts"),
        F.count_if(~is_account & F.col("item.value").isNotNull()).alias("n_reasons"),
    )


def beacon(events: DataFrame, by: Sequence[Column], value: str) -> DataFrame:
    """Count and distinct values per key and bucket, by way of the distinct (key, bucket, value) rows."""
    names = [f"_k{i}" for i in range(len(by))]
    pairs = events.groupBy(*[c.alias(n) for c, n in zip(by, names)], F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return pairs.groupBy(*names).agg(F.sum("n").alias("n"), F.count("_v").alias("distinct_values"))


def members(events: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value): the set of values per key in rows of their own, which no task ever has to hold as a whole. Nulls are no
    members."""
    return events.filter(F.col(value).isNotNull()).select(*by, value).distinct()


def beacon_scores(events: DataFrame, by: Sequence[Column], value: str, amount: Column) -> DataFrame:
    """Count, distinct values, mean amount and score per key and bucket: regular traffic with few values and small amounts
    scores high. The score is null where the mean is zero or missing, or no value is known."""
    names = [f"_k{i}" for i in range(len(by))]
    pairs = events.groupBy(*[c.alias(n) for c, n in zip(by, names)], F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).alias("_sum"), F.count(amount).alias("_known")
    )
    sums = pairs.groupBy(*names).agg(
        F.sum("n").alias("n"), F.count("_v").alias("distinct_values"), F.sum("_sum").alias("_sum"), F.sum("_known").alias("_known")
    )
    mean = F.try_divide(F.col("_sum").cast("double"), F.col("_known").cast("double"))
    per_value = F.try_divide(F.col("n").cast("double"), F.col("distinct_values").cast("double"))
    scored = sums.withColumn("mean_amount", mean).withColumn("score", per_value * F.try_divide(F.lit(1.0), F.col("mean_amount")))
    return scored.drop("_sum", "_known")


def volume(events: DataFrame, by: Sequence[str], amount: Column) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))


def first_last_seen(events: DataFrame, by: Sequence[str], time: str = "timestamp") -> DataFrame:
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")
    )


def adjacent_sequence(
    events: DataFrame,
    by: str,
    time: str,
    tie: str,
    first: Column,
    second: Column,
    max_seconds: int,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """(by, first_event, second_event) where an event matching ``first`` is directly followed by one matching ``second``.

    One entity may own a third of all events, so rows are not windowed per entity. Each (entity, time bucket) finds
    its own neighbours. Only bucket edges are then windowed per entity: at most two rows per bucket, among which the
    row after a bucket's last event is the first event of the entity's next bucket.
    """
    at = F.col(time)
    bucket = F.expr(f"unix_seconds(cast(`{time}` AS TIMESTAMP)) div {int(bucket_seconds)}")
    row = F.struct(at.alias("at"), F.col(tie).alias("id"), second.alias("is_second"))
    marked = events.select(
        by, at.alias("at"), F.col(tie).alias("id"), bucket.alias("bucket"), first.alias("is_first"), row.alias("row")
    )
    within = W.partitionBy(by, "bucket").orderBy("at", "id")
    local = marked.withColumns({"next": F.lead("row").over(within), "is_head": F.lag("id").over(within).isNull()})
    is_edge = F.col("next").isNull() & F.col("is_first")
    edges = local.filter(F.col("is_head") | is_edge).withColumn("is_edge", is_edge)
    across = edges.withColumn("next", F.lead("row").over(W.partitionBy(by).orderBy("at", "id"))).filter("is_edge")
    columns = [by, "at", "id", "next"]
    follows = F.col("next.is_second") & (F.col("next.at") <= F.col("at") + F.expr(f"INTERVAL {int(max_seconds)} SECONDS"))
    return (
        local.filter("is_first").select(*columns).unionByName(across.select(*columns))
        .filter(follows)
        .select(by, F.col("id").alias("first_event"), F.col("next.id").alias("second_event"))
    )


def signature_matches(
    docs: DataFrame, text: str, strings: Mapping[str, str], condition: str, nocase: bool = True
) -> DataFrame:
    """Documents whose whole text satisfies a string-set signature.

    ``condition`` is a boolean expression over the names of ``strings``, which may carry the ``$`` of rule texts.
    """
    groups = {
        name.lstrip("$"): {"_text|contains": value.lower() if nocase else value} for name, value in strings.items()
    }
    sql = rule_predicate({**groups, "condition": condition.replace("$", "")}, Fields(["_text"], attrs=None))
    searched = docs.withColumn("_text", F.lower(text) if nocase else F.col(text))
    return searched.filter(F.expr(sql)).drop("_text")
