"""Rule files -> documents, inside tasks.

This is the only Python that runs per file: it loads YAML, TOML or JSON, or cuts a file into its rules, and hands
everything on as JSON text. Field derivation happens afterwards in Spark columns. The module is pickled by value,
so executors do not need the package installed; YAML files need PyYAML there and become error rows without it.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOADED = "path STRING, modified TIMESTAMP, format STRING, ordinal INT, doc STRING, body STRING, error STRING"
YARA_START = r"(?m)^(?=\s*(?:private\s+|global\s+)*rule\s+\w+(?:\s*:\s*[\w\s]+)?\s*\{)"

Piece = tuple[object, str]


def _yaml(text: str):
    import yaml

    return yaml.safe_load(text)


def mapping_document(text: str) -> Iterable[Piece]:
    document = _yaml(text)
    if not isinstance(document, dict):
        raise ValueError("not a mapping")
    yield document, text


def search_document(text: str) -> Iterable[Piece]:
    for document, _ in mapping_document(text):
        yield document, (document.get("search") or "").strip()


def sigma_document(text: str) -> Iterable[Piece]:
    import yaml

    for document, _ in mapping_document(text):
        detection = document.get("detection") or {}
        document["_fields"] = sorted(field_names(detection))
        yield document, yaml.dump({"detection": detection}, default_flow_style=False)


def field_names(detection: dict) -> set[str]:
    """Field keys below the named selections, through lists of maps at any depth."""
    names: set[str] = set()
    queue = [(key, value) for key, value in detection.items() if key not in ("condition", "keywords")]
    while queue:
        key, value = queue.pop()
        if isinstance(value, dict):
            names.update(map(str, value))
        elif isinstance(value, list):
            queue.extend(item for entry in value if isinstance(entry, dict) for item in entry.items())
        else:
            names.add(str(key))
    return names


def elastic_document(text: str) -> Iterable[Piece]:
    if text.lstrip().startswith("{"):
        document = json.loads(text)
    else:
        import tomllib

        document = tomllib.loads(text)
    rule = document["rule"] if isinstance(document.get("rule"), dict) else document
    if not rule.get("name") and not rule.get("query"):
        raise ValueError("rule has neither name nor query")
    yield rule, rule.get("query") or rule.get("eql_query") or ""


COMMENT = ("#", ";")


def logical_lines(text: str) -> Iterable[str]:
    """The lines of a settings file with continuations joined: a line that ends in a backslash goes on in the next one, and
    so does a setting followed by an indented line. Comments and blank lines end a setting."""
    joined = None
    goes_on = False
    for line in [*text.splitlines(), ""]:
        content = line.strip()
        silent = not content or content.startswith(COMMENT)
        part = content.removesuffix("\\").strip()
        if joined is not None and not silent and (goes_on or (line[:1].isspace() and not SETTING.match(content))):
            joined = f"{joined} {part}"
        else:
            if joined is not None:
                yield joined
            joined = None if silent else part
        goes_on = not silent and content.endswith("\\")


SETTING = re.compile(r"(?P<key>[A-Za-z][A-Za-z0-9_.]*)\s*=\s*(?P<value>.*)", re.DOTALL)


def stanzas(text: str) -> Iterable[Piece]:
    """Every stanza but ``default`` with its settings; a text that does not begin with a stanza is one bare query."""
    if not text.lstrip().startswith("["):
        yield None, text.strip()
        return
    sections: list[dict[str, str]] = []
    for line in logical_lines(text):
        if line.startswith("[") and "]" in line[2:]:
            sections.append({"_name": line[1 : line.index("]", 2)]})
        elif sections and (setting := SETTING.fullmatch(line)):
            sections[-1][setting["key"]] = setting["value"].strip()
    named = [section for section in sections if section["_name"] != "default"]
    if not named:
        raise ValueError("no stanza found")
    yield from ((section, section.get("search", "").strip()) for section in named)


def sentinel_document(text: str) -> Iterable[Piece]:
    if not re.search(r"(?m)^query\s*:", text):
        yield None, text.strip()
        return
    for document, _ in mapping_document(text):
        yield document, document.get("query") or ""


def bare_query(text: str) -> Iterable[Piece]:
    yield None, text.strip()


def yara_rules(text: str) -> Iterable[Piece]:
    parts = [p for p in re.split(YARA_START, text) if re.match(r"\s*(?:private\s+|global\s+)*rule\s+\w+", p)]
    if not parts:
        raise ValueError("no rule definition found")
    for part in parts:
        yield None, part.strip()


def detection_json(texts: pd.Series) -> pd.Series:
    """Detection blocks stored as YAML text -> JSON text; null where the text is no such block."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(_yaml(text)["detection"], default=str)
        except Exception:  # noqa: BLE001 - not a detection block
            return None

    return texts.map(one)


Loader = Callable[[str], Iterable[Piece]]
LOADERS: dict[str, Loader] = {
    "splunk_security_content": search_document,
    "sigma": sigma_document,
    "kql": sentinel_document,
    "kql_bare": bare_query,
    "splunk": stanzas,
    "spl": bare_query,
    "elastic_eql": elastic_document,
    "yara": yara_rules,
    "generic_yaml": mapping_document,
}


def loader(extra: dict[str, Loader] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The function ``mapInPandas`` runs: one row per rule, or one error row per unreadable file."""
    known = {**LOADERS, **(extra or {})}

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch.itertuples(index=False):
                head = (file.path, file.modified, file.format)
                try:
                    pieces = list(known[file.format](file.text))
                    for ordinal, (document, body) in enumerate(pieces):
                        doc = None if document is None else json.dumps(document, default=str)
                        rows.append((*head, ordinal, doc, body, None))
                except Exception as problem:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((*head, 0, None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(
                rows, columns=["path", "modified", "format", "ordinal", "doc", "body", "error"]
            )

    return load
