"""Secret scans: fixed patterns, and strings that a byte-pair vocabulary cannot shorten.

A vocabulary learnt from ordinary text covers words, names and paths with long tokens. A random string falls apart into
many short ones, so a low number of characters per token gives it away. Candidates are maximal runs of 20 or more
characters of ``[A-Za-z0-9+/_=-]``. Known things are left out: digests (hexadecimal runs of 32, 40, 56, 64, 96 or 128
digits), UUIDs, plain numbers and rules of signs, and whatever a pattern already covers. A candidate with at most 1.9
characters per token is a span of kind ``random``.

A key name or a path beside a random string raises the ratio of the run. In a run that is no such span itself, what lies
outside patterns, digests and UUIDs is judged again, first as it is and then by its parts between ``/``, ``=``, ``_`` and
``-``: neighbours that are random each for itself are one candidate if they have 20 characters together.

Spans are code points, end exclusive. Null texts count as empty; an empty text has no span. Whole texts are scanned.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from watchfloor.llm.common import map_batches, named

# The patterns of the three kinds, in the order of the kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# Lengths of the digests in common use, and the form of a UUID.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
KNOWN = r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"

CANDIDATE_LEAST = 20
CHARACTERS_PER_TOKEN = 1.9
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut before byte pairs are merged.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("secrets", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary, a file of bounded size that the driver reads and sends along."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Scanner:
    def __init__(self, ranks: dict[bytes, int], limit: float = CHARACTERS_PER_TOKEN):
        self.encoding, self.limit = encoding(ranks), limit
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(ACCESS)
        self.run = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min(CANDIDATE_LEAST, HEX_LEAST))
        self.hex = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
        self.known = re.compile(f"{KNOWN}|{UUID}|[0-9+/_=-]+")
        self.known_part = re.compile(f"(?<![A-Za-z0-9])(?:{KNOWN}|{UUID})(?![A-Za-z0-9])")
        self.part = re.compile("[^/=_-]+")

    def is_random(self, text: str) -> bool:
        return len(text) <= self.limit * len(self.encoding.encode_ordinary(text))

    def base(self, text: str, runs: list[re.Match]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the patterns' matches, by start and kind."""
        found = []
        low = text.lower()
        if any(word in low for word in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if len(m[0]) >= ACCESS_LEAST]
        found += [(m.start(), 2, m.end()) for r in runs for m in self.hex.finditer(text, r.start(), r.end())]
        return sorted(found)

    def candidate(self, text: str) -> bool:
        return len(text) >= CANDIDATE_LEAST and not self.known.fullmatch(text) and self.is_random(text)

    def random_parts(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Random strings in a piece of a run, and in what they leave of it."""
        if end - start < CANDIDATE_LEAST:
            return []
        if self.candidate(text[start:end]):
            return [(start, end)]
        groups, joins = [], False
        for m in self.part.finditer(text, start, end):
            alone = self.is_random(m[0])
            if alone and joins:
                groups[-1].append(m.span())
            elif alone:
                groups.append([m.span()])
            joins = alone
        found = []
        for group in groups:
            whole = (group[0][0], group[-1][1])
            found += [(s, e) for s, e in ([whole] if self.candidate(text[slice(*whole)]) else group) if self.candidate(text[s:e])]
        rest = outside(start, end, found) if found else []
        return found + [span for part in rest for span in self.random_parts(text, *part)]

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(pattern spans, all spans), each (start, kind, end) by start and kind."""
        runs = list(self.run.finditer(text))
        base = self.base(text, runs)
        more = []
        for m in runs:
            inside = [(s, e) for s, _, e in base if s < m.end() and m.start() < e]
            if not inside and self.known.fullmatch(m[0]):
                continue
            if not inside and self.is_random(m[0]):
                more.append((m.start(), 3, m.end()))
                continue
            inside += [k.span() for k in self.known_part.finditer(text, m.start(), m.end())]
            more += [(s, 3, e) for part in outside(m.start(), m.end(), inside) for s, e in self.random_parts(text, *part)]
        return base, sorted(base + more)


def outside(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans leave of start to end."""
    out, at = [], start
    for s, e in sorted(spans):
        if s > at:
            out.append((at, s))
        at = max(at, e)
    return [*out, (at, end)] if at < end else out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: float = CHARACTERS_PER_TOKEN
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans; one row per document, no shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        scanner = Scanner(ranks.value, limit)
        for batch in batches:
            found = [scanner.scan(text or "") for text in batch.column("text").to_pylist()]
            counts = [[sum(kind == k for _, kind, _ in spans) for _, spans in found] for k in range(4)]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array([joined(s) for _, s in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    rows = named(docs, doc_id=id_col, text=text_col)
    kind = rows.schema[0].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact_secrets(
    docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", vocabulary: str = VOCABULARY, limit: float = CHARACTERS_PER_TOKEN
) -> DataFrame:
    """The documents with every span replaced by ``mark``; all other columns and clean texts stay as they are."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        scanner = Scanner(ranks.value, limit)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else redacted(t, scanner.scan(t)[1], mark) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names
            )

    return map_batches(docs, run, docs.schema)
