"""Readers and text features at table scale: every row is first written out in the form a source would have."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfloor.functions import text
from watchfloor.functions.ids import cves_in_text, techniques_in_text
from watchfloor.operators import export, mapping
from watchfloor.operators.predicates import Fields, predicate
from watchfloor.operators.telemetry import normalise_shipped, parse_audit_lines
from watchfloor.sources.telemetry import events_from_json
from workload.registry import query

# The audit rule key each event type is written with.
AUDIT_KEY = (
    "CASE event_type WHEN 'error' THEN 'shell_exec' WHEN 'click' THEN 'exec' WHEN 'view' THEN 'network_connect' "
    "WHEN 'signup' THEN 'identity_check' ELSE 'file_delete' END"
)


@query(
    "audit_records",
    f"""SELECT event_id AS serial, epoch_us(ts) // 1000 AS at_ms, {AUDIT_KEY} AS "key", CAST(user_id AS VARCHAR(20)) AS uid,
               event_type AS proctitle, CASE WHEN user_id % 2 = 0 THEN 'execve' ELSE '9999' END AS syscall_name,
               CASE event_type WHEN 'error' THEN 'T1059.004' WHEN 'click' THEN 'T1059' WHEN 'view' THEN 'T1190'
                    WHEN 'signup' THEN 'T1033' ELSE 'T1070.004' END AS technique
        FROM events""",
)
def audit_records(v):
    millis = F.expr("unix_millis(cast(ts AS TIMESTAMP))")
    stamp = F.concat(F.expr("unix_millis(cast(ts AS TIMESTAMP)) div 1000").cast("string"), F.lit("."),
                     F.lpad((millis % 1000).cast("string"), 3, "0"))
    line = F.concat(
        F.lit("type=SYSCALL msg=audit("), stamp, F.lit(":"), F.col("event_id").cast("string"), F.lit("): syscall="),
        F.expr("CASE WHEN user_id % 2 = 0 THEN '59' ELSE '9999' END"), F.lit(" uid=0 uid="), F.col("user_id").cast("string"),
        F.lit(' key="'), F.expr(AUDIT_KEY), F.lit('" proctitle='), F.hex("event_type"),
    )
    parsed = parse_audit_lines(v.table("events").select(line.alias("value")))
    return parsed.select("serial", F.unix_millis("timestamp").alias("at_ms"), "key", "uid", "proctitle", "syscall_name",
                         "technique")


@query(
    "json_events",
    """SELECT epoch_us(ts) AS at_us, event_type AS "key", props AS message, CAST(user_id AS VARCHAR(20)) AS uid,
              value AS score FROM events""",
)
def json_events(v):
    line = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"), F.col("event_type").alias("key"),
            F.col("props").alias("message"), F.col("user_id").alias("uid"), F.col("value").alias("score"),
        )
    )
    events = events_from_json(v.table("events").select(line.alias("value")))
    return events.select(
        F.unix_micros("timestamp").alias("at_us"), "key", "message", "uid",
        F.try_element_at("attrs", F.lit("score")).cast("double").alias("score"),
    )


@query(
    "shipped_events",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'host-' || CAST(user_id AS VARCHAR(20)) ELSE 'edge' END AS host,
              CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
)
def shipped_events(v):
    own = F.expr("CASE WHEN user_id % 3 = 0 THEN concat('host-', cast(user_id AS STRING)) END")
    message = F.to_json(F.struct(own.alias("host"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    raw = v.table("events").select("event_id", message.alias("message"), F.lit("edge").alias("host"),
                                   F.lit("x").alias("container_name"))
    return normalise_shipped(raw, {"host": "STRING", "k": "INT"}).select("event_id", "host", "k")


@query(
    "ids_in_text",
    """SELECT o_orderkey, 'T' || CAST(1000 + epss_pct AS VARCHAR(20)) || '.' ||
              lpad(CAST(cvss_tenths AS VARCHAR(20)), 3, '0') || ',T' || CAST(2000 + epss_pct AS VARCHAR(20)) AS techniques,
              cve_id AS cves FROM cve""",
)
def ids_in_text(v):
    first = F.concat((F.lit(1000) + F.col("epss_pct")).cast("string"), F.lit("."),
                     F.lpad(F.col("cvss_tenths").cast("string"), 3, "0"))
    second = (F.lit(2000) + F.col("epss_pct")).cast("string")
    written = F.concat(
        F.lit("seen "), F.replace(F.lower("cve_id"), F.lit("-"), F.lit(".")), F.lit(" with attack.t"), first,
        F.lit(", TA0001, then T"), second, F.lit(" and t"), first, F.lit("; "), F.col("cve_id"),
    )
    return v.cve.select("o_orderkey", written.alias("t")).select(
        "o_orderkey", F.array_join(techniques_in_text(F.col("t")), ",").alias("techniques"),
        F.array_join(cves_in_text(F.col("t")), ",").alias("cves"),
    )


@query(
    "sigma_cidr",
    "SELECT event_id FROM events WHERE user_id // 50 = 1 OR (user_id // 50 = 0 AND user_id % 50 BETWEEN 8 AND 15)",
)
def sigma_cidr(v):
    ip = F.expr("concat_ws('.', '10', cast(user_id div 50 AS STRING), cast(user_id % 50 AS STRING), '7')")
    rule = predicate({"sel": {"ip|cidr": ["10.1.0.0/16", "10.0.8.0/21"]}, "condition": "sel"}, Fields(["ip"], None))
    return v.table("events").select("event_id", ip.alias("ip")).filter(rule).select("event_id")


@query("sigma_all_modifier", "SELECT event_id FROM telemetry WHERE contains(message, 'err') AND contains(message, '9}')")
def sigma_all_modifier(v):
    rule = predicate({"sel": {"message|contains|all": ["err", "9}"]}, "condition": "sel"}, Fields(["message"], None))
    return v.telemetry.filter(rule).select("event_id")


@query(
    "tag_split",
    """SELECT detection_id, 'T' || CAST(1000 + detection_id % 9000 AS VARCHAR(20)) AS techniques,
              'CVE-2020-' || lpad(CAST(detection_id AS VARCHAR(20)), 7, '0') AS cves, data_component AS cim,
              'attack.' || lower(severity) || ',team.' || validation_status AS others FROM detection""",
)
def tag_split(v):
    tags = F.array(
        F.concat(F.lit("attack."), F.lower("severity")),
        F.concat(F.lit("attack.t"), (F.lit(1000) + F.col("detection_id") % 9000).cast("string")),
        F.concat(F.lit("cve.2020."), F.lpad(F.col("detection_id").cast("string"), 7, "0")),
        F.concat(F.lit("cim."), F.col("data_component")),
        F.concat(F.lit("team."), F.col("validation_status")),
    )
    split = v.detection.select("detection_id", tags.alias("tags"))
    joined = {
        "techniques": techniques_in_text(F.array_join(text.sigma_technique_tags(F.col("tags")), " ")),
        "cves": cves_in_text(F.array_join(text.sigma_cve_tags(F.col("tags")), " ")),
        "cim": text.sigma_cim_tags(F.col("tags")),
        "others": text.sigma_other_tags(F.col("tags")),
    }
    return split.select("detection_id", *[F.array_join(c, ",").alias(n) for n, c in joined.items()])


@query(
    "spl_features",
    """SELECT detection_id, 'index=' || data_component AS product, severity AS service,
              'host,score,user' AS fields, 'maturity > ' || CAST(maturity AS VARCHAR(20)) AS clause FROM detection""",
)
def spl_features(v):
    spl = F.concat(
        F.lit("index="), F.col("data_component"), F.lit(" sourcetype="), F.col("severity"),
        F.lit("\n| where maturity > "), F.col("maturity").cast("string"),
        F.lit("\n| eval score = 1\n| stats count by host, user\n| fields host, score"),
    )
    written = v.detection.select("detection_id", spl.alias("q"))
    sources = text.spl_log_sources(F.col("q"))
    return written.select(
        "detection_id", F.get(sources, 0)["product"].alias("product"), F.get(sources, 1)["service"].alias("service"),
        F.array_join(text.spl_fields(F.col("q")), ",").alias("fields"),
        F.get(text.spl_conditions(F.col("q")), 1).alias("clause"),
    )


@query(
    "kql_features",
    """SELECT detection_id, CASE maturity % 3 WHEN 0 THEN 'SecurityEvent' WHEN 1 THEN 'SigninLogs' ELSE 'OwnTable' END
              AS tables, CASE maturity % 3 WHEN 0 THEN 'windows' WHEN 1 THEN 'cloud' ELSE '' END AS platforms,
              'EventID,Host,Score,User' AS fields
       FROM detection""",
)
def kql_features(v):
    table = F.expr("CASE maturity % 3 WHEN 0 THEN 'SecurityEvent' WHEN 1 THEN 'SigninLogs' ELSE 'OwnTable' END")
    query_text = F.concat(F.lit("// "), F.col("name"), F.lit("\n"), table,
                          F.lit("\n| where EventID == 1\n| extend Score = 2\n| project Host,\n  User"))
    written = v.detection.select("detection_id", query_text.alias("q"))
    read = written.select("detection_id", text.kql_tables(F.col("q")).alias("found"), text.kql_fields(F.col("q")).alias("named"))
    return read.select(
        "detection_id", F.array_join("found", ",").alias("tables"),
        F.array_join(text.kql_platforms(F.col("found")), ",").alias("platforms"),
        F.array_join("named", ",").alias("fields"),
    )


@query(
    "export_queries",
    """SELECT d.detection_id, '[' || d.name || ']' || chr(10) || 'search = index=tele (technique="' || k.technique_id
              || '") | eval detection="' || d.name || '" | table _time, technique, key, exe, uid, cmd_output' || chr(10)
              || 'alert.severity = ' || CASE d.severity WHEN 'info' THEN '1' WHEN 'low' THEN '2' WHEN 'med' THEN '3'
              WHEN 'high' THEN '4' ELSE '5' END || chr(10) || 'description = ' || d.name || chr(10) AS spl,
              '// ' || d.name || chr(10) || 'technique: "' || k.technique_id || '"' || chr(10) AS kql
       FROM (SELECT *, row_number() OVER (PARTITION BY detection_id ORDER BY conf_pct DESC, pos, s_suppkey) AS rn
             FROM binding) b JOIN kb k ON b.s_suppkey = k.s_suppkey JOIN detection d ON b.detection_id = d.detection_id
       WHERE b.rn = 1""",
)
def export_queries(v):
    best = mapping.best_binding(
        v.binding, ["detection_id"], "conf_pct", [F.col("pos"), F.col("s_suppkey")], {"s_suppkey": "s_suppkey"}
    )
    bound = best.join(v.kb.select("s_suppkey", "technique_id", "tactic"), "s_suppkey").join(
        v.detection.select("detection_id", "name", "severity"), "detection_id"
    )
    technique = F.struct(
        F.substring_index("technique_id", ".", 1).alias("technique_id"),
        F.when(F.contains("technique_id", F.lit(".")), F.col("technique_id")).alias("sub_technique_id"), "tactic",
    )
    records = bound.select(
        F.col("detection_id").alias("id"), "name", F.lit("").alias("description"), "severity",
        F.array(technique).alias("mitre_techniques"),
        F.array().cast("array<struct<cve_id:string>>").alias("cve_references"),
    )
    return export.target_queries(records, "tele").select(F.col("id").alias("detection_id"), "spl", "kql")
