"""Queries over the telemetry view: scans, field predicates, monitors and query shapes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from watchfloor.operators import shapes
from watchfloor.operators.matching import since
from watchfloor.operators.predicates import Fields, predicate
from watchfloor.operators.telemetry import daily_counts, merge_json, recent_events, snapshot_diff
from watchfloor.session import lookup, shared_folder, tune
from watchfloor.sources.telemetry import distinct_values, read_store, store_counts, store_sketches, write_store
from workload.registry import query
from workload.views import KEY_TECHNIQUES

FIELDS = Fields(["key", "host", "host_no", "message", "value", "uid", "technique"], attrs=None)


def _rule(**groups):
    return predicate(groups, FIELDS)


@query("ev_time_filter", "SELECT event_id, \"key\", technique FROM telemetry WHERE ts >= TIMESTAMP '2024-01-15'")
def ev_time_filter(v):
    return since(v.telemetry, "2024-01-15 00:00:00", time="ts", null_ts="drop").select("event_id", "key", "technique")


@query(
    "props_json_merge",
    "SELECT event_id, \"key\", coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM telemetry",
)
def props_json_merge(v):
    base = v.telemetry.select("event_id", "key", "props", F.lit(0).alias("k"))
    return merge_json(base, "props", {"k": "INT"}).select("event_id", "key", "k")


@query("daily_event_counts", "SELECT CAST(ts AS DATE) AS event_date, count(*) AS n FROM telemetry GROUP BY 1")
def daily_event_counts(v):
    return daily_counts(v.telemetry, "ts")


@query("store_event_counts", "SELECT CAST(ts AS DATE) AS event_date, count(*) AS n FROM telemetry GROUP BY 1")
def store_event_counts(v):
    """The events written to the daily store below the shared folder and counted as they are read back."""
    tune(v.spark)
    path = f"{shared_folder(v.spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    write_store(v.telemetry.withColumnRenamed("ts", "timestamp"), path)
    return store_counts(read_store(v.spark, path))


@query(
    "event_key_to_technique",
    """SELECT e."key", m.technique, count(*) AS n FROM telemetry e
       LEFT JOIN (VALUES ('error','T1499'), ('signup','T1078'), ('purchase','T1190'), ('click','T1204.002'))
       AS m(k, technique) ON e."key" = m.k GROUP BY 1, 2""",
)
def event_key_to_technique(v):
    mapped = v.telemetry.select("key", lookup(KEY_TECHNIQUES, F.col("key")).alias("technique"))
    return mapped.groupBy("key", "technique").agg(F.count(F.lit(1)).alias("n"))


@query("sigma_exact", "SELECT event_id, \"key\" FROM telemetry WHERE \"key\" IN ('error', 'signup')")
def sigma_exact(v):
    return v.telemetry.filter(_rule(sel={"key": ["error", "signup"]}, condition="sel")).select("event_id", "key")


@query("sigma_contains", "SELECT event_id FROM telemetry WHERE contains(message, '\"k\": 6')")
def sigma_contains(v):
    return v.telemetry.filter(_rule(sel={"message|contains": '"k": 6'}, condition="sel")).select("event_id")


@query("sigma_startswith", "SELECT event_id FROM telemetry WHERE starts_with(message, 'pur')")
def sigma_startswith(v):
    return v.telemetry.filter(_rule(sel={"message|startswith": "pur"}, condition="sel")).select("event_id")


@query("sigma_endswith", "SELECT event_id FROM telemetry WHERE ends_with(message, '7}')")
def sigma_endswith(v):
    return v.telemetry.filter(_rule(sel={"message|endswith": "7}"}, condition="sel")).select("event_id")


@query(
    "sigma_regex", "SELECT event_id FROM telemetry WHERE regexp_full_match(message, 'click \\{\"k\": [0-9]\\}')"
)
def sigma_regex(v):
    return v.telemetry.filter(_rule(sel={"message|re": r'click \{"k": [0-9]\}'}, condition="sel")).select("event_id")


@query("sigma_gt_lt", "SELECT event_id, value FROM telemetry WHERE value > 100 AND value < 200")
def sigma_gt_lt(v):
    return v.telemetry.filter(_rule(sel={"value|gt": 100, "value|lt": 200}, condition="sel")).select(
        "event_id", "value"
    )


@query("sigma_group_and", "SELECT event_id FROM telemetry WHERE \"key\" = 'error' AND host = 'host-3'")
def sigma_group_and(v):
    return v.telemetry.filter(_rule(sel={"key": "error", "host": "host-3"}, condition="sel")).select("event_id")


@query(
    "sigma_selection_not_filter",
    "SELECT event_id, host FROM telemetry WHERE \"key\" = 'error' AND NOT host IN ('host-1', 'host-2')",
)
def sigma_selection_not_filter(v):
    rule = _rule(
        selection={"key": "error"}, filter={"host": ["host-1", "host-2"]}, condition="selection and not filter"
    )
    return v.telemetry.filter(rule).select("event_id", "host")


@query(
    "sigma_one_of",
    """SELECT event_id FROM telemetry
       WHERE ("key" = 'error' AND host = 'host-1') OR ("key" = 'click' AND host = 'host-2')""",
)
def sigma_one_of(v):
    rule = _rule(
        sel_a={"key": "error", "host": "host-1"}, sel_b={"key": "click", "host": "host-2"}, condition="1 of sel_*"
    )
    return v.telemetry.filter(rule).select("event_id")


@query("sigma_all_of", "SELECT event_id FROM telemetry WHERE \"key\" = 'view' AND value > 50 AND host_no < 5")
def sigma_all_of(v):
    rule = _rule(
        sel_key={"key": "view"}, sel_value={"value|gt": 50}, sel_host={"host_no|lt": 5}, condition="all of sel_*"
    )
    return v.telemetry.filter(rule).select("event_id")


@query("recent_events", "SELECT event_id, ts, \"key\" FROM telemetry ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent(v):
    return recent_events(v.telemetry.select("event_id", "ts", "key"), 25, time="ts")


@query(
    "hourly_alerts",
    """SELECT date_trunc('hour', ts) AS hour_start, technique, count(*) AS n FROM telemetry
       WHERE technique IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 3""",
)
def hourly_alerts(v):
    return shapes.hourly_alerts(v.telemetry.filter(F.col("technique").isNotNull()), "technique", 3, time="ts")


@query(
    "threshold_rule",
    """SELECT host, date_trunc('hour', ts) AS hour_start, count(*) AS n FROM telemetry
       WHERE "key" = 'error' GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def threshold_rule(v):
    errors = v.telemetry.filter(F.col("key") == "error")
    return shapes.threshold(errors, [F.col("host"), shapes.hour_of("ts").alias("hour_start")], F.col("n") >= 3)


@query(
    "spray_rule",
    """SELECT host, count(*) AS failures, count(DISTINCT uid) AS accounts, count(DISTINCT props) AS n_reasons
       FROM telemetry WHERE "key" = 'error' GROUP BY host HAVING count(*) > 200 AND count(DISTINCT uid) > 10""",
)
def spray_rule(v):
    errors = v.telemetry.filter(F.col("key") == "error")
    return shapes.spray(errors, ["host"], "uid", "props").filter((F.col("failures") > 200) & (F.col("accounts") > 10))


@query(
    "beacon_rule",
    """SELECT uid, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT props) AS distinct_props FROM telemetry
       GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT props) < count(*)""",
)
def beacon_rule(v):
    out = shapes.beacon(v.telemetry, [F.col("uid"), F.to_date("ts")], "props").toDF("uid", "day", "n", "distinct_props")
    return out.filter((F.col("n") >= 5) & (F.col("distinct_props") < F.col("n")))


@query(
    "spray_members",
    """SELECT DISTINCT host, props FROM telemetry WHERE "key" = 'error' AND props IS NOT NULL""",
)
def spray_members(v):
    return shapes.members(v.telemetry.filter(F.col("key") == "error"), ["host"], "props")


@query(
    "beacon_scores",
    """SELECT uid, day, n, distinct_values, mean_amount, (CAST(n AS DOUBLE) / CAST(distinct_values AS DOUBLE)) * (1.0 / mean_amount) AS score
       FROM (SELECT uid, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT props) AS distinct_values,
                    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_amount
             FROM telemetry GROUP BY 1, 2) s WHERE n >= 3 ORDER BY score DESC""",
)
def beacon_scores(v):
    cents = F.round(F.col("value") * 100).cast("bigint")
    out = shapes.beacon_scores(v.telemetry, [F.col("uid"), F.to_date("ts")], "props", cents)
    return out.withColumnsRenamed({"_k0": "uid", "_k1": "day"}).filter("n >= 3").orderBy(F.desc("score"))


@query(
    "sketched_users",
    """SELECT count(*) AS n, true AS close, count(DISTINCT CAST(ts AS DATE)) AS days FROM telemetry""",
)
def sketched_users(v):
    """Distinct users over all days from daily sketches, held against the exact count."""
    daily = store_sketches(v.telemetry.withColumn("event_date", F.to_date("ts")), "uid")
    exact = v.telemetry.select("uid").distinct().agg(F.count(F.lit(1)))
    days = daily.agg(F.count(F.lit(1)))
    total = distinct_values(daily, "uid")
    return total.select("n", (F.abs(F.col("uid") - exact.scalar()) <= 0.03 * exact.scalar()).alias("close"), days.scalar().alias("days"))


@query(
    "volume_rule",
    """SELECT host, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents
       FROM telemetry GROUP BY host
       HAVING count(*) > 900 OR sum(CAST(round(value * 100) AS BIGINT)) > 5000000""",
)
def volume_rule(v):
    out = shapes.volume(v.telemetry, ["host"], F.round(F.col("value") * 100).cast("bigint"))
    return out.withColumnRenamed("total", "total_cents").filter(
        (F.col("n") > 900) | (F.col("total_cents") > 5_000_000)
    )


@query(
    "sequence_rule",
    """SELECT uid, event_id AS first_event, next_id AS second_event FROM (
         SELECT uid, event_id, ts, "key", lead(event_id) OVER w AS next_id, lead("key") OVER w AS next_key,
                lead(ts) OVER w AS next_ts
         FROM telemetry WINDOW w AS (PARTITION BY uid ORDER BY ts, event_id)) s
       WHERE "key" = 'signup' AND next_key = 'error' AND next_ts <= ts + INTERVAL 6 HOURS""",
)
def sequence_rule(v):
    return shapes.adjacent_sequence(
        v.telemetry, "uid", "ts", "event_id", F.col("key") == "signup", F.col("key") == "error", 6 * 3600
    )


@query(
    "first_last_seen",
    """SELECT uid, "key", count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM telemetry GROUP BY 1, 2""",
)
def first_last_seen(v):
    return shapes.first_last_seen(v.telemetry, ["uid", "key"], "ts")


@query(
    "json_path_extract",
    """SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS bucket, count(*) AS n
       FROM telemetry GROUP BY 1""",
)
def json_path_extract(v):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return v.telemetry.groupBy((k % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "snapshot_diff",
    """SELECT change, count(*) AS n FROM (
         SELECT CASE WHEN p.event_id IS NULL THEN 'added' WHEN c.event_id IS NULL THEN 'removed'
                     WHEN p.version <> c.version THEN 'modified' END AS change
         FROM (SELECT event_id, value AS version FROM telemetry WHERE ts < TIMESTAMP '2024-01-25') p
         FULL JOIN (SELECT event_id, CASE WHEN "key" = 'error' THEN value + 1 ELSE value END AS version
                    FROM telemetry WHERE ts >= TIMESTAMP '2024-01-05') c ON p.event_id = c.event_id) d
       WHERE change IS NOT NULL GROUP BY change""",
)
def snapshot(v):
    ts = F.col("ts")
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    previous = v.telemetry.filter(ts < day("2024-01-25")).select("event_id", F.col("value").alias("version"))
    current = v.telemetry.filter(ts >= day("2024-01-05")).select(
        "event_id", F.when(F.col("key") == "error", F.col("value") + 1).otherwise(F.col("value")).alias("version")
    )
    return snapshot_diff(previous, current, "event_id", "version").groupBy("change").agg(F.count(F.lit(1)).alias("n"))
