"""Detection conditions as Spark SQL predicates.

A selection is a set of field conditions, a rule is a boolean expression over selections. Both become SQL text:
Spark's own expression parser supplies precedence and parentheses, and Catalyst folds, simplifies and pushes the
result down to the scan. A name that cannot be resolved raises, it is never dropped.
"""

from __future__ import annotations

import base64
import ipaddress
import re
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from watchfloor.schemas import EVENT_FIELDS
from watchfloor.session import sql_string

COMPARISONS = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
MATCHERS = ("", "contains", "startswith", "endswith", "re", "cidr", "exists", *COMPARISONS)
FLAGS = ("all", "base64", "cased")
IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"
RESERVED_GROUPS = ("condition", "keywords", "timeframe")


class UntranslatableCondition(ValueError):
    """The condition uses something that has no predicate; rules carrying it fall back to the other layers."""


class Fields:
    """Resolves event field names to SQL: a column where one exists, else a key of the ``attrs`` map.

    ``of`` takes the columns from a table's schema; columns that are no text are compared as text, so that a rule may name
    values of any kind for them.
    """

    def __init__(self, columns: Iterable[str] = EVENT_FIELDS, attrs: str | None = "attrs", other: Iterable[str] = ()) -> None:
        self.columns = frozenset(columns)
        self.attrs = attrs
        self.other = frozenset(other)

    @classmethod
    def of(cls, schema: StructType, attrs: str = "attrs") -> Fields:
        plain = [f for f in schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
        has_map = any(f.name == attrs and isinstance(f.dataType, MapType) for f in schema)
        other = [f.name for f in plain if not isinstance(f.dataType, StringType)]
        return cls([f.name for f in plain], attrs if has_map else None, other)

    def sql(self, name: str) -> str:
        if name in self.columns:
            return f"CAST(`{name}` AS STRING)" if name in self.other else f"`{name}`"
        if self.attrs:
            return f"try_element_at(`{self.attrs}`, {sql_string(name)})"
        raise UntranslatableCondition(f"unknown field {name!r}")


def _cidr(field: str, network: str) -> str:
    """IPv4 range test: whole octets as a text prefix, the partial one as a number, then the shape of the address.

    The prefix decides nearly every row without parsing it. Text that is no address does not match.
    """
    net = ipaddress.ip_network(network, strict=False)
    if net.version != 4:
        raise UntranslatableCondition(f"only IPv4 ranges are supported: {network!r}")
    whole, partial = divmod(net.prefixlen, 8)
    octets = str(net.network_address).split(".")
    if whole == 4:
        return f"{field} = {sql_string('.'.join(octets))}"
    tests = []
    if whole:
        tests.append(f"startswith({field}, {sql_string('.'.join(octets[:whole]) + '.')})")
    tests.append(f"{field} RLIKE {sql_string(IPV4)}")
    if partial:
        first, last = (str(a).split(".")[whole] for a in (net.network_address, net.broadcast_address))
        tests.append(f"try_cast(split_part({field}, '.', {whole + 1}) AS INT) BETWEEN {first} AND {last}")
    return "(" + " AND ".join(tests) + ")"


def _one_value(field: str, matcher: str, value: Any, fold: bool) -> str:
    if matcher == "exists":
        return f"{field} IS {'NOT ' if value not in (False, 'false', 'no') else ''}NULL"
    if value is None:
        return f"{field} IS NULL"
    text = str(value)
    if matcher in COMPARISONS:
        return f"try_cast({field} AS DOUBLE) {COMPARISONS[matcher]} {float(text)!r}D"
    if matcher == "cidr":
        return _cidr(field, text)
    if matcher == "re":
        return f"{field} RLIKE {sql_string(('(?is)' if fold else '(?s)') + '^(?:' + text + ')$')}"
    subject, literal = (f"lower({field})", sql_string(text.lower())) if fold else (field, sql_string(text))
    if matcher == "":
        return f"{subject} = {literal}"
    return f"{matcher}({subject}, {literal})"


def field_condition(key: str, value: Any, fields: Fields, case_insensitive: bool = False) -> str:
    """One ``field|modifier: value`` entry; a list of values is OR, or AND with the ``all`` modifier."""
    name, *modifiers = [part.strip() for part in key.split("|")]
    modifiers = [m.lower() for m in modifiers]
    matchers = [m for m in modifiers if m not in FLAGS]
    if len(matchers) > 1 or any(m not in MATCHERS for m in matchers):
        raise UntranslatableCondition(f"unsupported modifier in {key!r}")
    matcher = matchers[0] if matchers else ""
    values = value if isinstance(value, list) else [value]
    if not values:
        raise UntranslatableCondition(f"no value for {key!r}")
    if "base64" in modifiers:
        values = [base64.b64encode(str(v).encode()).decode() for v in values]
    fold = case_insensitive and not {"cased", "base64"} & set(modifiers)
    field = fields.sql(name)
    if matcher == "" and "all" not in modifiers and len(values) > 1 and None not in values:
        texts = [str(v).lower() if fold else str(v) for v in values]
        subject = f"lower({field})" if fold else field
        return f"{subject} IN ({', '.join(sql_string(t) for t in texts)})"
    joiner = " AND " if "all" in modifiers else " OR "
    parts = [_one_value(field, matcher, v, fold) for v in values]
    return parts[0] if len(parts) == 1 else "(" + joiner.join(parts) + ")"


def selection(group: Mapping[str, Any] | list, fields: Fields, case_insensitive: bool = False) -> str:
    """A selection: AND over its fields; a list of selections is OR."""
    if isinstance(group, list):
        parts = [selection(g, fields, case_insensitive) for g in group if isinstance(g, Mapping)]
        if not parts or len(parts) != len(group):
            raise UntranslatableCondition("a selection list may only hold field maps")
        return "(" + " OR ".join(parts) + ")"
    if not group:
        raise UntranslatableCondition("empty selection")
    return "(" + " AND ".join(field_condition(k, v, fields, case_insensitive) for k, v in group.items()) + ")"


def rule_predicate(detection: Mapping[str, Any], fields: Fields | None = None, case_insensitive: bool = False) -> str:
    """SQL predicate of a detection block: named selections plus a ``condition``.

    Handles names, ``not``, ``and``, ``or``, parentheses, ``1 of x*`` and ``all of x*`` (also ``them``), anywhere
    in the expression. Negated operands are made two-valued first, so that a missing field counts as "no match"
    on both sides of a ``not``.
    """
    fields = fields or Fields()
    condition = str(detection.get("condition") or "").strip()
    if not condition:
        raise UntranslatableCondition("no condition")
    if "|" in condition:
        raise UntranslatableCondition("aggregation conditions have no row predicate")
    groups = {
        name: selection(group, fields, case_insensitive)
        for name, group in detection.items()
        if name not in RESERVED_GROUPS and isinstance(group, (Mapping, list))
    }
    guard_all = bool(re.search(r"(?i)\bnot\s*\(", condition))

    def members(pattern: str) -> list[str]:
        if pattern.lower() == "them":
            return list(groups.values())
        glob = re.compile("".join(".*" if c == "*" else re.escape(c) for c in pattern) + r"\Z")
        return [sql for name, sql in groups.items() if glob.match(name)]

    def resolve(token: re.Match) -> str:
        negated, quantifier, pattern, name = token.group("no", "q", "of", "name")
        if name and name.lower() in ("and", "or", "not"):
            return name.upper()
        if quantifier:
            found = members(pattern)
            joiner = " OR " if quantifier == "1" else " AND "
        else:
            found = [groups[name]] if name in groups else []
            joiner = ""
        if not found:
            raise UntranslatableCondition(f"condition names no selection: {token.group(0).strip()!r}")
        sql = "(" + joiner.join(found) + ")"
        if negated or guard_all:
            sql = f"coalesce({sql}, false)"
        return f"NOT {sql}" if negated else sql

    token = r"(?i)(?P<no>\bnot\s+(?!\())?(?:\b(?P<q>1|all)\s+of\s+(?P<of>[\w*]+)|\b(?P<name>[A-Za-z_][\w-]*))"
    leftover = re.sub(token, " ", condition)
    if re.search(r"[^\s()]", leftover):
        raise UntranslatableCondition(f"cannot read condition {condition!r}")
    return re.sub(token, resolve, condition)


def patterns(detection: Mapping[str, Any]) -> list[str]:
    """The regular expressions of a detection block, as the matcher will run them."""
    found, todo = [], [v for k, v in detection.items() if k not in RESERVED_GROUPS]
    while todo:
        part = todo.pop()
        if isinstance(part, list):
            todo += part
        elif isinstance(part, Mapping):
            for key, value in part.items():
                if "re" in [m.strip().lower() for m in str(key).split("|")[1:]]:
                    values = value if isinstance(value, list) else [value]
                    found += [f"(?s)^(?:{v})$" for v in values if v is not None]
    return found


def required_values(detection: Mapping[str, Any], field: str) -> frozenset[str] | None:
    """Values ``field`` must have for the rule to hold, or null where the rule does not say.

    Only read off plain conjunctions: every selection named without ``not`` has to hold, so an exact condition on
    the field in any of them is a requirement.
    """
    condition = str(detection.get("condition") or "")
    if not re.fullmatch(r"(?i)\s*(?:not\s+)?[\w-]+(?:\s+and\s+(?:not\s+)?[\w-]+)*\s*", condition):
        return None
    required = None
    for part in re.split(r"(?i)\s+and\s+", condition.strip()):
        group = None if re.match(r"(?i)not\s", part) else detection.get(part.strip())
        value = group.get(field) if isinstance(group, Mapping) else None
        values = value if isinstance(value, list) else [value]
        if value is None or None in values:
            continue
        texts = frozenset(str(v) for v in values)
        required = texts if required is None else required & texts
    return required


def predicate(detection: Mapping[str, Any], fields: Fields | None = None, case_insensitive: bool = False) -> Column:
    """``rule_predicate`` as a filter column."""
    return F.expr(rule_predicate(detection, fields, case_insensitive))
