"""Ten thousand rules in one scan: a counting index of conditions.

A rule becomes clauses, any of which fires it; a clause has slots, all of which must hold; a slot holds if one of its keys
is among the event's. What a condition negates bars the clause: lists of slots, none of which may hold as a whole. Keys are what
equality can decide: a field with its value, or the first or last characters of it. A rule that compares, searches inside a
value, only negates or joins selections otherwise keeps its generated predicate, which every event is tested for.

Events are scanned once. Of every field that rules name, a value stays only if some key mentions it, and events are counted
by what is left, their signature, before any rule is joined; the shuffle carries one row per distinct signature and task.
Every clause is filed under the slot whose keys the fewest events have. Signatures meet clauses at that slot by equality, and
a clause fires where the number of its slots that hold is the number it has and nothing bars it. Signatures that are few go to
where the clauses are, so that the work of many clauses is dealt over all tasks.

Rules are translated inside tasks, from a table to a table. Only generated predicates come to the driver, where they become
query text. Which fields rules name does too; both are bounded by what a query text can hold.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import product
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from watchfloor import schemas, session
from watchfloor.operators import predicates
from watchfloor.operators.predicates import Fields, UntranslatableCondition
from watchfloor.session import BROADCAST_ROWS, cut_lineage, fits_broadcast, join_dimension, sql_string

for module in (predicates, schemas, session):  # executors need no copy of the package
    cloudpickle.register_pickle_by_value(module)
cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])

MOST_CLAUSES = 64  # a rule with more alternatives is generated
KEYS = ("", "startswith", "endswith")
SLOTS = pa.list_(pa.list_(pa.struct([("field", pa.string()), ("how", pa.string()), ("value", pa.string())])))
CLAUSES = pa.list_(pa.struct([("slots", SLOTS), ("barred", pa.list_(SLOTS))]))
COMPILED = pa.schema(
    [("rule_id", pa.string()), ("error", pa.string()), ("predicate", pa.string()), ("patterns", pa.list_(pa.string())), ("clauses", CLAUSES)]
)
CLAUSE = ("rule_id", "copy", "clause", "needed")


def _slot(key: str, value: Any, fold: bool) -> list[list[dict]] | None:
    """The slots of one ``field|modifier: value`` entry, each a list of keys; None: equality cannot decide it."""
    name, *modifiers = [part.strip() for part in key.split("|")]
    modifiers = [m.lower() for m in modifiers]
    values = value if isinstance(value, list) else [value]
    how = [m for m in modifiers if m not in ("all", "cased")]
    if len(how) > 1 or (how and how[0] not in KEYS) or (fold and "cased" in modifiers) or not values or None in values:
        return None
    texts = [str(v).lower() if fold else str(v) for v in values]
    if how and "" in texts:
        return None
    keys = [{"field": name, "how": how[0] if how else "", "value": t} for t in texts]
    return [[k] for k in keys] if "all" in modifiers else [keys]


def _selection(group: Any, fold: bool) -> list[list] | None:
    """A selection as clauses, each a list of slots."""
    if isinstance(group, list):
        parts = [_selection(g, fold) if isinstance(g, Mapping) else None for g in group]
        return None if not parts or None in parts else [c for p in parts for c in p]
    slots = [_slot(k, v, fold) for k, v in group.items()]
    return None if not slots or None in slots else [[s for found in slots for s in found]]


def rule_clauses(detection: Mapping[str, Any], fold: bool = False) -> list[dict] | None:
    """The clauses of a detection block, each with its slots and with the lists of slots that bar it.

    None: the condition is more than a choice of conjunctions, or one of them has nothing but negations.
    """
    groups = {k: g for k, g in detection.items() if k not in predicates.RESERVED_GROUPS and isinstance(g, (Mapping, list))}

    def plain(found: list[list] | None) -> list[dict] | None:
        return None if found is None else [{"slots": slots, "barred": []} for slots in found]

    def term(text: str) -> list[dict] | None:
        negated = re.fullmatch(r"(?i)not\s+(.+)", text)
        if negated:
            found = term(negated.group(1))
            return None if found is None or any(c["barred"] for c in found) else [{"slots": [], "barred": [c["slots"] for c in found]}]
        quantified = re.fullmatch(r"(?i)(1|all)\s+of\s+([\w*]+)", text)
        if quantified:
            glob = "*" if quantified.group(2).lower() == "them" else quantified.group(2)
            names = [n for n in groups if re.fullmatch("".join(".*" if c == "*" else re.escape(c) for c in glob), n)]
            parts = [plain(_selection(groups[n], fold)) for n in names]
            if not parts or None in parts:
                return None
            return [c for p in parts for c in p] if quantified.group(1) == "1" else conjunction(parts)
        return plain(_selection(groups[text], fold)) if text in groups else None

    def conjunction(parts: list) -> list[dict] | None:
        size = 1
        for p in parts:
            size *= len(p)
        if size > MOST_CLAUSES:
            return None
        return [{k: [x for clause in choice for x in clause[k]] for k in ("slots", "barred")} for choice in product(*parts)]

    condition = str(detection.get("condition") or "").strip()
    if re.search(r"[()|]", condition):
        return None
    clauses: list[dict] = []
    for alternative in re.split(r"(?i)\s+or\s+", condition):
        parts = [term(t.strip()) for t in re.split(r"(?i)\s+and\s+", alternative)]
        joined = None if None in parts else conjunction(parts)
        if joined is None:
            return None
        clauses += joined
    bounded = len(clauses) <= MOST_CLAUSES and all(c["slots"] and len(c["barred"]) <= MOST_CLAUSES for c in clauses)
    return clauses if bounded else None


def compiled(rules: DataFrame, fields: Fields, case_insensitive: bool = False) -> DataFrame:
    """rule_id, error, predicate, patterns, clauses of every rule with a detection block (``detection``, JSON text).

    A rule has clauses, or a predicate, or an error. A bad rule keeps its reason and its other layers.
    """

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rule_id, text in zip(batch.column("rule_id").to_pylist(), batch.column("detection").to_pylist(), strict=True):
                row = {"rule_id": rule_id, "error": None, "predicate": None, "patterns": None, "clauses": None}
                try:
                    block = json.loads(text)
                    if not isinstance(block, dict):
                        raise UntranslatableCondition("the detection is no block of selections")
                    if "condition" not in block or str(block["condition"]).strip() == "keywords":
                        continue
                    sql = predicates.rule_predicate(block, fields, case_insensitive)
                    clauses = rule_clauses(block, case_insensitive)
                    if clauses is None:
                        row |= {"predicate": sql, "patterns": predicates.patterns(block)}
                    else:
                        row["clauses"] = clauses
                except (ValueError, TypeError, AttributeError) as problem:
                    row["error"] = str(problem) or type(problem).__name__
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, COMPILED)

    rows = rules.filter("detection IS NOT NULL AND detection <> ''").select(F.col("rule_id").cast("string").alias("rule_id"), "detection")
    # Rules are short: a file of a few megabytes, which is one task to read, holds more of them than a task should translate.
    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(dealt.mapInArrow(translate, from_arrow_schema(COMPILED)))


def bad_patterns(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(rule_id, error) of rules with a pattern that the engine cannot compile: all distinct patterns are tried in one query,
    and one by one only if that fails."""
    patterns = [r.pattern for r in found.select(F.explode("patterns").alias("pattern")).distinct().collect()]

    def readable(some: list[str]) -> bool:
        try:
            spark.range(1).select(*[F.rlike(F.lit(""), F.lit(p)).alias(f"p{i}") for i, p in enumerate(some)]).collect()
        except Exception:  # noqa: BLE001 - whatever the engine says
            return False
        return True

    def halves(some: list[str]) -> list[str]:
        if not some or readable(some):
            return []
        return some if len(some) == 1 else halves(some[: len(some) // 2]) + halves(some[len(some) // 2 :])

    bad = [p for at in range(0, len(patterns), 200) for p in halves(patterns[at : at + 200])]
    reasons = session.inline_table(spark, [(p, f"cannot read pattern {p!r}") for p in bad], {"pattern": "STRING", "error": "STRING"})
    return found.select("rule_id", F.explode("patterns").alias("pattern")).join(F.broadcast(reasons), "pattern").groupBy("rule_id").agg(F.min("error").alias("error"))


def _key_of(fields: Fields, field: str, how: str, length: int, fold: bool) -> Column:
    """The text that a key of this kind would have to equal."""
    value = F.expr(fields.sql(field))
    value = F.lower(value) if fold else value
    if how == "startswith":
        return F.when(F.char_length(value) >= length, F.left(value, F.lit(length)))
    if how == "endswith":
        return F.when(F.char_length(value) >= length, F.right(value, F.lit(length)))
    return value


class Index:
    """The clauses of compiled rules, their keys numbered."""

    def __init__(self, found: DataFrame, fields: Fields, case_insensitive: bool = False):
        self.fields, self.fold = fields, case_insensitive
        # Rows of a rule that negates count one by one, as those of a generated predicate do; others count once for their id.
        negates = F.exists("clauses", lambda c: F.size(c["barred"]) > 0)
        rows = found.filter("clauses IS NOT NULL").withColumn("copy", F.monotonically_increasing_id())
        rows = rows.select("rule_id", F.when(negates, F.col("copy")).alias("copy"), F.posexplode("clauses").alias("clause", "c"))
        bars = rows.select("rule_id", "copy", "clause", F.size("c.slots").alias("needed"), F.posexplode(F.concat(F.array("c.slots"), "c.barred")).alias("bar", "slots"))
        keys = bars.select(*CLAUSE, "bar", F.posexplode("slots").alias("slot", "options")).select(*CLAUSE, "bar", "slot", F.explode("options").alias("key"))
        length = F.when(F.col("key.how") == "", 0).otherwise(F.char_length("key.value"))
        self.keys = cut_lineage(
            keys.select(*CLAUSE, "bar", "slot", F.concat_ws("|", "key.field", "key.how", length.cast("string")).alias("kind"), F.col("key.field").alias("field"), F.col("key.how").alias("how"), length.alias("length"), F.col("key.value").alias("value")).distinct()
        )
        self.kinds = self.keys.select("kind", "field", "how", "length").distinct().orderBy("kind").collect()

    def signatures(self, events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Events with ``_keys``: the (kind, value) keys of theirs that some clause mentions, in order of the kinds."""
        none = F.expr("CAST(array() AS array<struct<kind: string, value: string>>)")
        if not self.kinds:
            return events.select(*keep, none.alias("_keys"))
        known = cut_lineage(self.keys.select("kind", "value").distinct())
        sizes = {r.kind: r["count"] for r in known.groupBy("kind").count().collect()}
        out, mentioned = events, []
        for i, k in enumerate(self.kinds):
            text, value = f"_text{i}", f"_value{i}"
            of_kind = known.filter(F.col("kind") == k.kind).select(F.col("value").alias(value))
            of_kind = F.broadcast(of_kind) if sizes[k.kind] <= BROADCAST_ROWS else of_kind
            out = out.withColumn(text, _key_of(self.fields, k.field, k.how, k.length, self.fold)).join(of_kind, F.col(text) == F.col(value), "left")
            mentioned.append(F.when(F.col(value).isNotNull(), F.struct(F.lit(k.kind).alias("kind"), F.col(value).alias("value"))))
        return out.select(*keep, F.filter(F.array(*mentioned), lambda s: s.isNotNull()).alias("_keys"))

    def fired(self, signatures: DataFrame) -> DataFrame:
        """(_keys, n, rule_id, copy) for each distinct signature and rule that fires on it. ``signatures`` is (_keys, n)."""
        uses = signatures.select(F.explode("_keys").alias("k"), "n").groupBy("k.kind", "k.value").agg(F.sum("n").alias("uses"))
        keys = join_dimension(self.keys, uses, ["kind", "value"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
        slots = keys.groupBy(*CLAUSE, "bar", "slot").agg(F.sum("uses").alias("uses"), F.collect_set(F.struct("kind", "value")).alias("options"))
        bars = slots.groupBy(*CLAUSE, "bar").agg(
            F.collect_list("options").alias("slots"), F.min("uses").alias("least"), F.min_by("options", F.struct("uses", "slot")).alias("entry")
        )
        own = F.col("bar") == 0

        def of_own(column: str) -> Column:
            return F.first(F.when(own, F.col(column)), ignorenulls=True).alias(column)

        clauses = bars.groupBy(*CLAUSE).agg(of_own("slots"), of_own("least"), of_own("entry"), F.collect_list(F.when(~own, F.col("slots"))).alias("barred"))
        filed = clauses.filter("least > 0").select(*CLAUSE, "slots", "barred", F.explode("entry").alias("e"))
        filed = filed.select(*CLAUSE, "slots", "barred", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
        entries = signatures.select("_keys", "n", F.explode("_keys").alias("e")).select("_keys", "n", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
        on = ["kind", "value"]
        met = filed.join(F.broadcast(entries), on) if fits_broadcast(entries) else join_dimension(entries, filed, on)

        def holds(options: Column) -> Column:
            return F.arrays_overlap(options, F.col("_keys"))

        holding = F.size(F.filter("slots", holds))
        bar = F.exists("barred", lambda slots: F.forall(slots, holds))
        return met.filter((holding == F.col("needed")) & ~bar).select("_keys", "n", "rule_id", "copy").distinct()

    def counts(self, events: DataFrame) -> DataFrame:
        """(rule_id, field_hits): events on which each rule fires."""
        signatures = cut_lineage(self.signatures(events).groupBy("_keys").agg(F.count(F.lit(1)).alias("n")).filter(F.size("_keys") > 0))
        counted = self.fired(signatures).groupBy("rule_id", F.col("copy").isNull()).agg(F.sum("n").alias("field_hits"))
        return counted.select("rule_id", "field_hits")

    def hits(self, events: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(rule_id, kept columns): one row per rule and event."""
        signed = self.signatures(events, keep).filter(F.size("_keys") > 0)
        signatures = cut_lineage(signed.groupBy("_keys").agg(F.count(F.lit(1)).alias("n")))
        return join_dimension(signed, self.fired(signatures).drop("n"), "_keys").select("rule_id", *keep)


def generated(found: DataFrame, per_batch: int) -> Iterator[list]:
    """(rule_id, predicate) of the rules that stay predicates, a batch at a time."""
    rows = found.filter("predicate IS NOT NULL").select("rule_id", "predicate").toLocalIterator(prefetchPartitions=False)
    batch: list = []
    for row in rows:
        batch.append(row)
        if len(batch) == per_batch:
            yield batch
            batch = []
    if batch:
        yield batch


def named(batch: list) -> Column:
    """The numbers of the batch's rules whose predicate holds, as text."""
    return F.concat_ws(",", *[F.expr(f"CASE WHEN {row.predicate} THEN {sql_string(str(i))} END") for i, row in enumerate(batch)])
