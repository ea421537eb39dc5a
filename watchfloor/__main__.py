"""Jobs for spark-submit: ``spark-submit --py-files watchfloor.zip -m watchfloor COMMAND ...``.

Every command reads tables or files and writes tables; nothing is printed but the location.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfloor.functions.labels import tactic_name
from watchfloor.operators import coverage, export, quality
from watchfloor.operators import vulnerabilities as vuln
from watchfloor.operators.telemetry import snapshot_diff
from watchfloor.plans.match import Backend, match_corpus, updated_records
from watchfloor.plans.report import coverage_tables, cve_coverage, enrich_corpus, map_corpus
from watchfloor.session import tune
from watchfloor.sources import feeds, lookups, records, rules, telemetry
from watchfloor.sources.knowledge import load_bundle
from watchfloor.streaming import jobs


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _good_records(spark: SparkSession, path: str) -> DataFrame:
    return rules.with_ast(records.read_detections(spark, path)[0])


def _cves(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The feeds named on the command line, merged; columns no feed supplies are null."""
    tables = {}
    if args.nvd:
        tables["nvd"] = feeds.read_nvd(spark, args.nvd)
    if args.kev:
        tables["kev"] = feeds.read_kev(spark, args.kev).select("cve_id", "vendor", "product", "date_added")
    if args.ctid:
        read = feeds.read_mapping_json if args.ctid.endswith(".json") else feeds.read_mapping_csv
        tables["ctid"] = read(spark, args.ctid)
    if args.epss:
        tables["epss"] = feeds.read_epss(spark, args.epss)
    if not tables:
        raise SystemExit("name at least one of --nvd, --kev, --ctid, --epss")
    merged = vuln.merge_feeds(tables)
    kinds = {"cvss_score": "double", "epss": "double", "description": "string", "cwes": "array<string>",
             "techniques": "array<string>", "in_kev": "boolean"}
    missing = {name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in merged.columns}
    return merged.withColumns(missing) if missing else merged


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    paths, defaults = lookups.field_map(spark, args.field_map)
    found, errors = rules.read_rules(spark, args.rules, not args.flat, args.format, args.strict,
                                     field_map=paths, defaults=defaults)
    records.write_detections(found.drop("path"), f"{args.out}/records")
    _save(errors, f"{args.out}/errors")


def match(spark: SparkSession, args: argparse.Namespace) -> None:
    found = _good_records(spark, args.records)
    events = (telemetry.read_store(spark, args.events, args.start[:10] if args.start else None) if args.store
              else telemetry.read_events(spark, args.events))
    backend = Backend(events, args.kind, case_insensitive=args.ignore_case)
    results = match_corpus(rules.matchable(found), backend, args.name or args.kind, args.start, args.samples)
    records.write_results(results, f"{args.out}/results")
    if args.tested_at:
        written = records.read_results(spark, f"{args.out}/results")
        records.write_detections(updated_records(found, written, args.tested_at), f"{args.out}/records")


def map_rules(spark: SparkSession, args: argparse.Namespace) -> None:
    kb = load_bundle(spark, args.bundle)
    out = map_corpus(
        _good_records(spark, args.records), kb.techniques, kb.revoked_by, args.mode,
        lookups.keyword_hints(spark, args.keywords), lookups.source_hints(spark, args.hints),
        min_confidence=args.min_confidence,
    )
    records.write_detections(out.records, f"{args.out}/records")
    _save(out.bindings, f"{args.out}/bindings")
    _save(out.messages, f"{args.out}/messages")


def enrich(spark: SparkSession, args: argparse.Namespace) -> None:
    techniques = load_bundle(spark, args.bundle).techniques if args.bundle else None
    cves = _cves(spark, args) if any((args.nvd, args.kev, args.ctid, args.epss)) else None
    out, counts = enrich_corpus(_good_records(spark, args.records), techniques, cves)
    records.write_detections(out, f"{args.out}/records")
    _save(counts, f"{args.out}/counters")


def report_coverage(spark: SparkSession, args: argparse.Namespace) -> None:
    found = _good_records(spark, args.records)
    kb = load_bundle(spark, args.bundle)
    for name, table in coverage_tables(found, kb.techniques).items():
        _save(table, f"{args.out}/{name}")
    _save(quality.lint_records(found, kb.techniques), f"{args.out}/lint")


def report_cves(spark: SparkSession, args: argparse.Namespace) -> None:
    ranked, techniques = cve_coverage(_good_records(spark, args.records), _cves(spark, args), args.min_risk,
                                      args.granularity)
    _save(ranked, f"{args.out}/cves")
    _save(techniques, f"{args.out}/techniques")


def report_results(spark: SparkSession, args: argparse.Namespace) -> None:
    results = records.read_results(spark, args.results, args.array)
    bound = results.select("rule_id", "status", F.explode("techniques").alias("technique_id"))
    flags = bound.groupBy("technique_id").agg(F.max(F.col("status") == "pass").alias("covered"))
    _save(coverage.result_totals(results), f"{args.out}/totals")
    _save(coverage.tactic_coverage(flags, tactic_name(F.col("technique_id"))), f"{args.out}/tactics")
    _save(quality.findings(results), f"{args.out}/findings")


def export_queries(spark: SparkSession, args: argparse.Namespace) -> None:
    found = records.read_detections(spark, args.records)[0]
    _save(export.target_queries(found, args.index), f"{args.out}/queries")
    _save(export.monitor_payloads(found, args.index), f"{args.out}/monitors")
    _save(export.saved_searches(found, args.index), f"{args.out}/saved_searches")


def changes(spark: SparkSession, args: argparse.Namespace) -> None:
    """Compare the corpus with the snapshot of an earlier run, then store the new one beside it."""
    current = rules.snapshot(spark, args.rules)
    previous = spark.read.parquet(args.previous) if args.previous else current.limit(0)
    _save(snapshot_diff(previous, current, "path", "modified"), f"{args.out}/changes")
    current.write.mode("overwrite").parquet(f"{args.out}/snapshot")


def ship(spark: SparkSession, args: argparse.Namespace) -> None:
    source = jobs.audit_events if args.audit else jobs.shipped_events
    jobs.append_store(source(spark, args.folder), args.out, args.name, args.once).awaitTermination()


def watch(spark: SparkSession, args: argparse.Namespace) -> None:
    def current() -> DataFrame:
        return rules.matchable(rules.read_rules(spark, args.rules)[0])

    jobs.revalidate(jobs.shipped_events(spark, args.folder), current, args.out, args.name,
                    available_now=args.once).awaitTermination()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="watchfloor", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *positional):
        sub = commands.add_parser(name, help=run.__doc__)
        sub.set_defaults(run=run)
        for argument in positional:
            sub.add_argument(argument)
        sub.add_argument("--out", required=True)
        return sub

    def with_feeds(sub):
        for feed in ("nvd", "kev", "ctid", "epss"):
            sub.add_argument(f"--{feed}")

    sub = command("ingest", ingest, "rules")
    sub.add_argument("--format")
    sub.add_argument("--field-map")
    sub.add_argument("--flat", action="store_true")
    sub.add_argument("--strict", action="store_true")
    sub = command("match", match, "records", "events")
    sub.add_argument("--kind", choices=("local", "indexed", "search"), default="local")
    sub.add_argument("--store", action="store_true", help="events is the daily-partitioned store")
    sub.add_argument("--start", help="look-back start, UTC timestamp")
    sub.add_argument("--name")
    sub.add_argument("--samples", action="store_true")
    sub.add_argument("--ignore-case", action="store_true")
    sub.add_argument("--tested-at", help="also write records with their new status, dated so")
    sub = command("map", map_rules, "records", "bundle")
    sub.add_argument("--mode", choices=("explicit", "inferred", "hybrid"), default="hybrid")
    sub.add_argument("--keywords")
    sub.add_argument("--hints")
    sub.add_argument("--min-confidence", type=float, default=0.5)
    sub = command("enrich", enrich, "records")
    sub.add_argument("--bundle")
    with_feeds(sub)
    command("coverage", report_coverage, "records", "bundle")
    sub = command("cve-coverage", report_cves, "records")
    sub.add_argument("--min-risk", type=float, default=0.0)
    sub.add_argument("--granularity", choices=("parent", "exact"), default="parent")
    with_feeds(sub)
    sub = command("report", report_results, "results")
    sub.add_argument("--array", action="store_true", help="results is a JSON array, not JSON lines")
    sub = command("export", export_queries, "records")
    sub.add_argument("--index", required=True)
    sub = command("changes", changes, "rules")
    sub.add_argument("--previous")
    sub = command("ship", ship, "folder")
    sub.add_argument("--name", required=True)
    sub.add_argument("--audit", action="store_true")
    sub.add_argument("--once", action="store_true")
    sub = command("watch", watch, "folder", "rules")
    sub.add_argument("--name", required=True)
    sub.add_argument("--once", action="store_true")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = tune(SparkSession.builder.appName(f"watchfloor {args.command}").getOrCreate())
    args.run(spark, args)
    print(args.out)


if __name__ == "__main__":
    main()
