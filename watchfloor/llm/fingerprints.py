"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, however many there are. The sketch of a union
of texts is the union of their sketches, and what two sketches share estimates the overlap of the texts without bias even
when one is a thousand times as long as the other: containment = shared / own, likeness = shared / union.

A shingle is five lower-case words; a shorter text is one shingle; a text without words has an empty sketch. The
fingerprint is the sorted kept hashes as base64 of big-endian 64-bit integers. Null texts count as empty. If neither
sketch keeps a hash, equal texts are alike to 1.0 and others to 0.0; if just one is empty the likeness is 0.0.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfloor.llm.common import Powers, map_batches, named, shingle_hashes

SHINGLE_WORDS = 5
ONE_IN = 4  # a sketch keeps one hash in so many
SLICE_BYTES = 16 << 20  # text of neighbouring ids that one task walks through, while there are fewer slices than
MOST_SLICES = 100_000


def sketch(text: str, powers: Powers, one_in: int = ONE_IN, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes below 2**64 / one_in."""
    hashes = np.unique(shingle_hashes(text, width, powers))
    return hashes[: np.searchsorted(hashes, np.uint64(((1 << 64) - 1) // one_in), side="right")]


def written(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def merge(a: str, b: str) -> str:
    """The fingerprint of both texts' shingles together."""
    return written(np.union1d(read(a), read(b)))


def overlap(a: np.ndarray, b: np.ndarray, same_text: bool) -> tuple[float, float]:
    """(likeness of a and b, share of a contained in b)."""
    if not len(a) and not len(b):
        return (1.0, 1.0) if same_text else (0.0, 0.0)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared), shared / len(a) if len(a) else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, fingerprint of every whole text; no shuffle."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            hashes = [np.unique(shingle_hashes(t or "", width, powers)) for t in texts]
            limit = np.uint64(((1 << 64) - 1) // one_in)
            kept = [h[: np.searchsorted(h, limit, side="right")] for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(h) for h in hashes], pa.int64()), pa.array([written(k) for k in kept], pa.string())],
                ["doc_id", "n_shingles", "fingerprint"],
            )

    rows = named(docs, doc_id=id_col, text=text_col)
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_shingles long, fingerprint string")


def in_slices(docs: DataFrame, slice_bytes: int) -> tuple[DataFrame, int]:
    """Rows with ``part``: slices of neighbouring ids, descending, nulls last. The first rows of a slice appear once more at
    the end of the slice before it (the very first after the last slice), so that each slice knows what follows its own
    rows. Cut points come from a sketch of the ids' distribution; one id per slice reaches the driver, at most MOST_SLICES."""
    length = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, min(length // slice_bytes + 1, MOST_SLICES))
    cuts = docs.approxQuantile("doc_id", [k / slices for k in range(1, slices)], 0.1 / slices) if slices > 1 else []
    cuts = np.unique(np.array(cuts, np.int64))

    def part(ids: pa.Array) -> pa.Array:
        place = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts), place).astype(np.int32))

    of = F.arrow_udf(part, "int")
    firsts = {r.part: r.top for r in docs.select("doc_id").groupBy(of("doc_id").alias("part")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(firsts)
    places, heads = {p: i for i, p in enumerate(order)}, [firsts[p] for p in order]

    def copies(ids: pa.Array) -> pa.Array:
        own = [places[p] for p in part(ids).to_pylist()]
        both = [[i, (i - 1) % len(order)] if d == heads[i] else [i] for d, i in zip(ids.to_pylist(), own, strict=True)]
        return pa.array(both, pa.list_(pa.int32()))

    rows = docs.withColumn("parts", F.arrow_udf(copies, "array<int>")("doc_id"))
    return rows.select("doc_id", "text", F.posexplode("parts").alias("nth", "part")).withColumn("tail", F.col("nth") == 1), max(1, len(order))


def compare_with_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN, width: int = SHINGLE_WORDS, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Fingerprint of every text and of its edited form, whose last third is replaced by the beginning of the next document.

    The next document is the one that follows in descending order of id (after the last, the first). Rows of one id follow
    each other in the order of their texts; a document alone in its table is its own next one.
    """
    rows = named(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sliced, n = in_slices(rows, slice_bytes)
    dealt = sliced.repartitionById(n, F.col("part")).sortWithinPartitions(F.col("part"), F.col("tail"), F.col("doc_id").desc_nulls_last(), F.col("text"))

    def compare(powers, doc_id, text, own, after, other):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        changed = sketch(edited, powers, one_in, width)
        likeness, contained = overlap(own, changed, text == edited)
        near, within = overlap(own, other, text == after)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), written(own), written(changed),
            likeness, near, contained, within,
        )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def run(batches):
        powers, last = Powers(), None  # last: the row that waits for the one after it
        for batch in batches:
            out = []
            for doc_id, text, part, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "tail")), strict=True):
                own = sketch(text, powers, one_in, width)
                if last is not None and last[3] == part and not last[4]:
                    out.append(compare(powers, *last[:3], text, own))
                last = (doc_id, text, own, part, tail)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(names), kinds, strict=True)], names)

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, ["long", "long", *["string"] * 3, *["double"] * 4], strict=True))
    return map_batches(dealt, run, schema)
