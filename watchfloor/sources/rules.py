"""Rule corpora: scan, route, load and normalise to canonical records.

``read_rules`` is one Spark job: files are listed and read by Spark, routed by a CASE, loaded in ``mapInPandas``
and turned into records by native columns, every format in the same pass.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfloor.functions import labels, text
from watchfloor.functions.ids import cve_structs, cves_in_text, technique_structs, techniques_in_text
from watchfloor.sources.loaders import LOADED, Loader, detection_json, loader
from watchfloor.sources.lookups import GENERIC_DEFAULTS, GENERIC_FIELDS

# File types that are never rules, and the bytes a format is recognised by.
SKIPPED_SUFFIXES = (
    "md", "txt", "rst", "html", "pdf", "png", "jpg", "gif", "svg", "py", "go", "js", "ts", "sh", "bat", "ps1",
    "lock", "sum",
)
YARA_HEADER = r"(?m)^\s*(?:private\s+|global\s+)*rule\s+\w+(?:\s*:\s*[\w\s]+)?\s*\{"
UUID = r"(?i)^[0-9a-f-]{36}$"
YARA_PORTABILITY = 20.0


class RuleErrors(ValueError):
    """Raised in strict mode when any file could not be read."""


@dataclass(frozen=True)
class ExtraFormat:
    """A format added by the caller: how to recognise it, how to load it, and where its fields are."""

    matches: Column
    load: Loader
    fields: Mapping[str, str] = field(default_factory=lambda: dict(GENERIC_FIELDS))


# ---- scan and route -------------------------------------------------------------------------------------


def scan_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, modified, suffix, text) of every file that may be a rule. UTF-8, else Latin-1."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    name = F.substring_index("path", "/", -1)
    suffix = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    raw = F.col("content")
    decoded = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    return (
        reader.load(folder)
        .withColumn("suffix", suffix)
        .filter(~F.col("suffix").isin(*SKIPPED_SUFFIXES))
        .select("path", F.col("modificationTime").alias("modified"), "suffix", decoded.alias("text"))
    )


def route(files: DataFrame, extra: Mapping[str, ExtraFormat] | None = None, forced: str | None = None) -> DataFrame:
    """Add ``format``: the first format in priority order whose test holds; files no format claims are dropped."""
    if forced:
        return files.withColumn("format", F.lit(forced))
    head = F.col("text")

    def has(*markers: str) -> Column:
        found = F.lit(True)
        for marker in markers:
            found = found & F.contains(head, F.lit(marker))
        return found

    def suffix(*names: str) -> Column:
        return F.col("suffix").isin(*names)

    yaml = suffix("yml", "yaml")
    choice = (
        F.when(yaml & has("search:", "mitre_attack_id:"), "splunk_security_content")
        .when(yaml & has("detection:", "logsource:"), "sigma")
        .when(suffix("kql"), "kql_bare")
        .when(yaml & has("query:", "severity:"), "kql")
        .when(suffix("spl"), "spl")
        .when(suffix("conf") & has("search =", "["), "splunk")
        .when(suffix("toml") & (has("[rule]") | has("query =")), "elastic_eql")
        .when(suffix("json") & (has('"rule_id"') | has('"query"')), "elastic_eql")
        .when(suffix("yar", "yara") | head.rlike(YARA_HEADER), "yara")
    )
    for name, spec in (extra or {}).items():
        choice = choice.when(spec.matches, name)
    return files.withColumn("format", choice.when(yaml, "generic_yaml")).filter(F.col("format").isNotNull())


def load(files: DataFrame, extra: Mapping[str, ExtraFormat] | None = None) -> DataFrame:
    """One row per rule found in the routed files, or an error row."""
    loaders = {name: spec.load for name, spec in (extra or {}).items()}
    return files.select("path", "modified", "format", "text").mapInPandas(loader(loaders), LOADED)


# ---- documents to records -------------------------------------------------------------------------------


def _get(path: str) -> Column:
    return F.get_json_object("doc", "$." + path)


def _list(value: Column, split_text: bool = False) -> Column:
    """JSON text of a list or of one value -> array; null -> empty."""
    one = text.comma_list(value) if split_text else F.array(value)
    items = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "ARRAY<STRING>")).when(value.isNotNull(), one)
    return F.coalesce(items, F.array().cast("array<string>"))


def _authors(value: Column) -> Column:
    names = _list(value)
    split = F.flatten(F.transform(names, lambda a: F.transform(F.split(a, ","), text.strip)))
    named = F.filter(split, lambda a: a != "")
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("unknown")))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def _spaced(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def _first_conditions(body: Column) -> Column:
    return F.array_compact(F.array(text.first_line(body)))


@dataclass
class Shape:
    """Columns of one format; whatever a format does not set takes the default."""

    name: Column
    description: Column
    severity: Column
    source_format: str
    language: Column
    raw: Column
    fields: Column
    conditions: Column
    technique_ids: Column
    cve_ids: Column
    id: Column | None = None
    author: Column | None = None
    version: Column | None = None
    platforms: Column | None = None
    tags: Column | None = None
    log_sources: Column | None = None
    tactic: Column | None = None
    data_components: Column | None = None
    false_positives: Column | None = None
    cim_models: Column | None = None
    portability: float = 0.0
    ast: Column | None = None


def _sigma() -> Shape:
    tags = _list(_get("tags"))
    spoken = _spaced(_get("title"), _get("description"))
    category, product, service = (F.nullif(_get(f"logsource.{n}"), F.lit("")) for n in ("category", "product", "service"))
    source = F.struct(
        product.alias("product"), category.alias("category"), service.alias("service"),
        F.lit(None).cast("string").alias("definition"),
    )
    notes = F.filter(_list(_get("falsepositives")), lambda n: ~F.lower(F.trim(n)).isin("", "none"))
    return Shape(
        id=F.when(_get("id").rlike(UUID), _get("id")),
        name=F.coalesce(F.nullif(_get("title"), F.lit("")), F.nullif(_get("name"), F.lit(""))),
        description=_get("description"),
        author=_authors(_get("author")),
        version=_or(_get("version"), "1.0"),
        severity=labels.severity(_get("level"), labels.SIGMA_LEVELS),
        source_format="sigma",
        platforms=labels.platforms(F.array_compact(F.array(product)), labels.PRODUCT_PLATFORMS),
        tags=text.sigma_other_tags(tags),
        language=F.lit("sigma"),
        raw=F.col("body"),
        ast=_get("detection"),
        fields=_list(_get("_fields")),
        conditions=F.array_compact(F.array(F.nullif(_get("detection.condition"), F.lit("")))),
        technique_ids=F.concat(text.sigma_technique_tags(tags), techniques_in_text(spoken)),
        cve_ids=F.concat(text.sigma_cve_tags(tags), cves_in_text(spoken)),
        tactic=labels.tactic_from_tags(tags),
        log_sources=F.when(F.coalesce(product, category, service).isNotNull(), F.array(source)),
        data_components=F.array_compact(F.array(category)),
        false_positives=notes,
        cim_models=text.sigma_cim_tags(tags),
    )


def _spl_shape(name: Column, description: Column, severity: Column, **more) -> Shape:
    spl = F.col("body")
    spoken = _spaced(name, description, spl)
    return Shape(
        name=name, description=description, severity=severity, source_format="splunk-spl", language=F.lit("spl"),
        raw=_or(spl, "(empty)"), fields=text.spl_fields(spl), conditions=text.spl_conditions(spl),
        technique_ids=techniques_in_text(spoken), cve_ids=cves_in_text(spoken),
        log_sources=text.spl_log_sources(spl), cim_models=text.spl_cim_models(spl), **more,
    )


def _stanza() -> Shape:
    described = _or(_get("description"), "")
    number = F.trim(F.get_json_object("doc", "$['alert.severity']"))
    spoken = F.coalesce(F.nullif(described, F.lit("")), F.get_json_object("doc", "$['action.email.subject']"))
    return _spl_shape(
        F.coalesce(_get("_name"), F.col("_stem")), described,
        F.coalesce(labels.lookup(labels.SPLUNK_SEVERITIES, number), labels.severity(spoken)),
        author=_authors(F.get_json_object("doc", "$['action.email.to']")),
        version=F.lit("1.0"),
        platforms=F.when(F.col("doc").isNotNull(), F.array(F.lit("windows"))),
    )


def _bare_spl() -> Shape:
    return _spl_shape(F.col("_stem"), F.lit(""), F.lit("med"), version=F.lit("1.0"))


def _security_content() -> Shape:
    shape = _spl_shape(
        F.coalesce(_get("name"), F.col("_stem")), _get("description"),
        labels.severity(F.coalesce(F.nullif(_get("severity"), F.lit("")), _get("tags.severity")),
                        labels.ELASTIC_SEVERITIES),
    )
    required = _list(_get("tags.required_fields"))
    note = F.trim(_get("known_false_positives"))
    shape.id = _get("id")
    shape.author = _authors(_get("author"))
    shape.version = _or(_get("version"), "1")
    shape.platforms = F.when(F.startswith(_get("tags"), F.lit("{")), labels.domain_platforms(_get("tags.security_domain")))
    shape.tags = _list(_get("tags.analytic_story"))
    shape.fields = F.array_sort(F.array_distinct(F.concat(shape.fields, required)))
    shape.technique_ids = F.concat(_list(_get("tags.mitre_attack_id")), shape.technique_ids)
    shape.cve_ids = F.concat(_list(_get("tags.cve")), shape.cve_ids)
    shape.tactic = labels.slug(F.coalesce(F.get(_list(_get("tags.kill_chain_phases")), 0), F.lit("unknown")))
    shape.data_components = required
    shape.false_positives = F.when(~F.lower(note).isin("", "none"), F.array(note))
    return shape


def _kql_shape(name: Column, description: Column, severity: Column, named: Column, **more) -> Shape:
    query = F.col("body")
    tables = text.kql_tables(query)
    spoken = _spaced(named, description, query)
    return Shape(
        name=name, description=description, severity=severity, source_format="kql", language=F.lit("kql"), raw=query,
        fields=text.kql_fields(query), conditions=_first_conditions(query), technique_ids=techniques_in_text(spoken),
        cve_ids=cves_in_text(_spaced(description, query)), log_sources=text.kql_log_sources(tables), **more,
    )


def _sentinel() -> Shape:
    named = F.array_join(F.concat(_list(_get("relevantTechniques")), _list(_get("techniques"))), " ")
    tactic = F.get(_list(_get("tactics")), 0)
    platforms = text.kql_platforms(text.kql_tables(F.col("body")))
    connectors = F.from_json(_get("requiredDataConnectors"), "ARRAY<STRUCT<connectorId STRING>>")
    return _kql_shape(
        F.coalesce(_get("name"), F.col("_stem")), _get("description"),
        labels.severity(_get("severity"), labels.SENTINEL_SEVERITIES), named,
        id=_get("id"),
        author=_authors(F.coalesce(_get("author"), _get("metadata.author"))),
        version=_or(_get("version"), "1.0"),
        tactic=F.coalesce(labels.sentinel_tactic(tactic), F.lit("unknown")),
        platforms=F.when(F.size(platforms) > 0, platforms).otherwise(F.array(F.lit("cloud"))),
        data_components=F.transform(connectors, lambda c: F.coalesce(c["connectorId"], F.lit(""))),
    )


def _bare_kql() -> Shape:
    return _kql_shape(
        F.col("_stem"), F.lit(""), F.lit("med"), F.lit(""), version=F.lit("1.0"),
        platforms=text.kql_platforms(text.kql_tables(F.col("body"))),
    )


def _elastic() -> Shape:
    query = F.col("body")
    threats = F.from_json(
        _get("threat"),
        "ARRAY<STRUCT<tactic STRUCT<id STRING, name STRING>, "
        "technique ARRAY<STRUCT<id STRING, subtechnique ARRAY<STRUCT<id STRING>>>>>>",
    )
    techniques = F.flatten(F.transform(threats, lambda t: F.coalesce(t["technique"], F.array().cast(
        "array<struct<id:string,subtechnique:array<struct<id:string>>>>"))))
    ids = F.flatten(
        F.transform(
            techniques,
            lambda t: F.concat(
                F.array(t["id"]),
                F.coalesce(F.transform(t["subtechnique"], lambda s: s["id"]), F.array().cast("array<string>")),
            ),
        )
    )
    named = F.filter(F.transform(threats, lambda t: F.coalesce(t["tactic"]["name"], t["tactic"]["id"])),
                     lambda n: n.isNotNull() & (n != ""))
    spoken = _spaced(_get("description"), query)
    kind = _get("type")
    indices = _list(_get("index"))
    null = F.lit(None).cast("string")
    sources = F.transform(
        indices,
        lambda i: F.struct(null.alias("product"), null.alias("category"), i.alias("service"), null.alias("definition")),
    )
    return Shape(
        id=F.coalesce(F.nullif(_get("rule_id"), F.lit("")), _get("id")),
        name=F.coalesce(F.nullif(_get("name"), F.lit("")), F.col("_stem")),
        description=_get("description"),
        author=_authors(_get("author")),
        version=_or(_get("version"), "1"),
        severity=labels.severity(_get("severity"), labels.ELASTIC_SEVERITIES),
        source_format="elastic-eql",
        platforms=text.eql_platforms(query),
        tags=F.filter(_list(_get("tags")), lambda t: ~t.rlike(r"^T\d{4}")),
        language=F.when(kind.isin("eql", "esql", "kql", "lucene"), kind).otherwise("eql"),
        raw=query,
        fields=text.eql_fields(query),
        conditions=F.array_compact(F.array(F.when(text.eql_is_sequence(query), "sequence"), text.first_line(query))),
        technique_ids=F.concat(
            F.coalesce(F.filter(ids, lambda i: i.isNotNull()), F.array().cast("array<string>")),
            techniques_in_text(spoken),
        ),
        cve_ids=F.concat(cves_in_text(spoken), _list(_get("cve"))),
        tactic=F.coalesce(labels.slug(F.get(named, 0)), F.lit("unknown")),
        log_sources=sources,
        data_components=indices,
        false_positives=_list(_get("false_positives")),
    )


def _yara() -> Shape:
    rule = F.col("body")
    header = r"^\s*(?:private\s+|global\s+)*rule\s+(\w+)(?:\s*:\s*([\w\s]+))?\s*\{"
    meta = text.yara_meta(rule)

    def value(key: str) -> Column:
        return F.try_element_at(meta, F.lit(key))

    name = F.regexp_extract(rule, header, 1)
    hint = F.lower(_or(value("platform"), ""))
    platform = (
        F.when(F.contains(hint, F.lit("windows")), "windows").when(F.contains(hint, F.lit("linux")), "linux")
        .when(F.contains(hint, F.lit("mac")), "macos")
    )
    return Shape(
        id=F.nullif(value("id"), F.lit("")),
        name=name,
        description=value("description"),
        author=_authors(value("author")),
        version=_or(value("version"), "1.0"),
        severity=labels.severity(F.coalesce(F.nullif(value("severity"), F.lit("")), value("level"))),
        source_format="yara",
        platforms=F.array_compact(F.array(platform)),
        tags=F.filter(F.split(F.trim(F.regexp_extract(rule, header, 2)), r"\s+"), lambda t: t != ""),
        language=F.lit("yara"),
        raw=rule,
        fields=text.yara_string_names(rule),
        conditions=F.array_compact(F.array(F.nullif(text.yara_condition(rule), F.lit("")))),
        technique_ids=techniques_in_text(
            _spaced(value("technique"), value("mitre_technique"), value("tags"), name, value("description"))
        ),
        cve_ids=cves_in_text(_spaced(value("reference"), value("cve"), value("description"))),
        portability=YARA_PORTABILITY,
    )


def _generic(paths: Mapping[str, str], defaults: Mapping[str, str]) -> Shape:
    def value(name: str) -> Column:
        return F.nullif(_get(paths.get(name, name)), F.lit(""))

    query = _or(value("query"), "")
    named = _list(value("techniques"), split_text=True)
    cves = _list(F.coalesce(value("cves"), _get("cve")), split_text=True)
    spoken = _spaced(value("name"), value("description"), query, F.array_join(named, " "))
    severity = F.coalesce(value("severity"), F.lit(defaults.get("severity")).cast("string"))
    return Shape(
        id=value("id"),
        name=F.coalesce(value("name"), F.col("_stem")),
        description=value("description"),
        author=_authors(F.coalesce(value("author"), F.lit(defaults.get("author", "unknown")))),
        version=_or(value("version"), "1.0"),
        severity=labels.severity(severity),
        source_format=defaults.get("source_format", "custom"),
        platforms=labels.platforms(_list(value("platforms"), split_text=True)),
        tags=_list(value("tags"), split_text=True),
        language=F.lit(defaults.get("language", "unknown")),
        raw=F.when(query != "", query).otherwise(F.col("body")),
        fields=F.array().cast("array<string>"),
        conditions=_first_conditions(query),
        technique_ids=F.concat(named, techniques_in_text(spoken)),
        cve_ids=F.concat(cves, cves_in_text(spoken)),
        false_positives=_list(value("false_positives"), split_text=True),
    )


def normalise(
    loaded: DataFrame,
    extra: Mapping[str, ExtraFormat] | None = None,
    field_map: Mapping[str, str] | None = None,
    defaults: Mapping[str, str] | None = None,
) -> DataFrame:
    """Loaded documents -> canonical records; ``error`` rows must be filtered out before."""
    defaults = GENERIC_DEFAULTS if defaults is None else defaults
    shapes = {
        "splunk_security_content": _security_content(), "sigma": _sigma(), "kql": _sentinel(), "kql_bare": _bare_kql(),
        "splunk": _stanza(), "spl": _bare_spl(), "elastic_eql": _elastic(), "yara": _yara(),
        "generic_yaml": _generic(field_map or GENERIC_FIELDS, defaults),
    }
    for name, spec in (extra or {}).items():
        shapes[name] = _generic(spec.fields, defaults)
    strings = F.array().cast("array<string>")

    def pick(attribute: str, default: Column) -> Column:
        choice = None
        for name, shape in shapes.items():
            value = getattr(shape, attribute)
            if value is None:
                continue
            value = F.coalesce(value if isinstance(value, Column) else F.lit(value), default)
            test = F.col("format") == name
            choice = F.when(test, value) if choice is None else choice.when(test, value)
        return default if choice is None else choice.otherwise(default)

    no_text = F.lit("")
    no_source = F.array().cast("array<struct<product:string,category:string,service:string,definition:string>>")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    generated = F.sha2(F.concat_ws("#", "path", F.col("ordinal").cast("string")), 256)
    rows = loaded.withColumn("_stem", stem).withColumns(
        {
            "_techniques": F.array_distinct(pick("technique_ids", strings)),
            "_cves": F.array_distinct(pick("cve_ids", strings)),
            "_tactic": pick("tactic", F.lit("unknown")),
        }
    )
    logic = F.struct(
        pick("raw", no_text).alias("raw"),
        pick("language", F.lit("unknown")).alias("language"),
        pick("ast", F.lit(None).cast("string")).alias("ast"),
        pick("conditions", strings).alias("normalized_conditions"),
        F.array_sort(F.array_distinct(pick("fields", strings))).alias("field_references"),
    )
    return rows.select(
        F.coalesce(pick("id", F.lit(None).cast("string")), generated).alias("id"),
        F.coalesce(F.nullif(pick("name", F.col("_stem")), no_text), F.col("_stem")).alias("name"),
        pick("description", no_text).alias("description"),
        pick("author", F.array(F.lit("unknown"))).alias("author"),
        pick("version", F.lit("1.0")).alias("version"),
        F.col("modified").alias("created_at"),
        F.col("modified").alias("modified_at"),
        pick("severity", F.lit("med")).alias("severity"),
        pick("source_format", F.lit("custom")).alias("source_format"),
        F.array_distinct(pick("platforms", strings)).alias("platforms"),
        F.array_distinct(pick("tags", strings)).alias("tags"),
        logic.alias("detection_logic"),
        pick("log_sources", no_source).alias("log_sources"),
        technique_structs(F.col("_techniques"), F.col("_tactic")).alias("mitre_techniques"),
        cve_structs(F.col("_cves")).alias("cve_references"),
        pick("data_components", strings).alias("data_components"),
        pick("false_positives", strings).alias("false_positive_notes"),
        pick("cim_models", strings).alias("cim_models"),
        F.lit("untested").alias("validation_status"),
        F.lit(None).cast("timestamp").alias("last_validated"),
        F.lit(0).alias("detection_maturity_score"),
        pick("portability", F.lit(0.0)).alias("portability_score"),
        F.create_map().cast("map<string,string>").alias("siem_native"),
        F.array().cast(
            "array<struct<backend:string,deployed_at:timestamp,rule_version:string,status:string,deployed_by:string,"
            "commit_sha:string,backend_rule_id:string,notes:string>>"
        ).alias("deployment_history"),
        "path",
    )


def read_rules(
    spark: SparkSession,
    folder: str,
    recursive: bool = True,
    forced: str | None = None,
    strict: bool = False,
    extra: Mapping[str, ExtraFormat] | None = None,
    field_map: Mapping[str, str] | None = None,
    defaults: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(canonical records, errors) of every rule below ``folder``; strict mode raises on the first error."""
    loaded = load(route(scan_files(spark, folder, recursive), extra, forced), extra)
    errors = loaded.filter(F.col("error").isNotNull()).select("path", "format", "error")
    if strict and (first := errors.orderBy("path").first()):
        raise RuleErrors(f"{first.path}: {first.error}")
    return normalise(loaded.filter(F.col("error").isNull()), extra, field_map, defaults), errors


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified) of every file: the version table two corpus states are compared by."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"))


def with_ast(records: DataFrame) -> DataFrame:
    """Fill the parsed detection block of Sigma records that carry only its YAML text, as imported records do."""
    parse = F.pandas_udf(detection_json, "string")
    logic = F.col("detection_logic")
    missing = (logic["language"] == "sigma") & logic["ast"].isNull()
    whole = records.filter(~F.coalesce(missing, F.lit(False)))
    filled = records.filter(missing).withColumn(
        "detection_logic", logic.withField("ast", parse(F.col("detection_logic.raw")))
    )
    return whole.unionByName(filled)


def matchable(records: DataFrame) -> DataFrame:
    """(rule_id, name, techniques, keywords, detection) of canonical records, the input of ``compile_rules``."""
    block = F.when(F.col("detection_logic.language") == "sigma", F.col("detection_logic.ast"))
    keywords = F.get_json_object(block, "$.keywords")
    return records.select(
        F.col("id").alias("rule_id"),
        "name",
        F.transform("mitre_techniques", lambda t: F.coalesce(t["sub_technique_id"], t["technique_id"])).alias(
            "techniques"
        ),
        _list(keywords).alias("keywords"),
        block.alias("detection"),
    )
