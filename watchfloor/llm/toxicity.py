"""Toxicity by compression distance: what do two zstandard dictionaries make of each window of a text?

Both dictionaries begin with the same windows of ordinary text. The toxic one goes on with text of the toxic sample: of its
windows, the stretches of bytes whose runs of 4 and of 8 bytes are far more frequent in toxic documents than in ordinary
ones, wherever they begin or end, within words or across them. The rest of those windows is left out, because zstandard
finds chance matches in it. A window that the toxic dictionary makes shorter by some bytes holds such a stretch. A
document's windows (eight lower-case words each) give a profile: the largest gains, the mean gain and the share of windows
that gain at least 1 to 8 bytes. A logistic curve turns the profile into a score; it is fitted, and its threshold moved to
the best F1, on labelled rows that the dictionaries have not seen.

Training reads a bounded sample: of each class the ``per_class`` rows with the smallest hash of their id, half of them for the
dictionaries and half for the curve. Scoring is a map over whole texts.

Defined results: a null text counts as empty; an empty text is one empty window. Null labels and ids are not learnt from.
If one class has no labelled row, every score is the share of toxic rows (0 without any row). Repeated rows score each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.llm.common import map_batches, smallest_hashes

WINDOW_WORDS = 8
LONGEST_WORD = 64  # longer words are cut into pieces of this many characters
LEVEL = 3
SHORTEST = 4  # bytes of a match; zstandard's own choice for this level, 5, misses short words
BASE_WINDOWS = 400
RUNS = (4, 8)  # bytes: short words with a space, and words and passages of several
STANDS_OUT = 7.0  # standard deviations above what ordinary documents lead one to expect
MOST_STRETCHES = 1000
HELD = 200_000  # runs that a task counts before it hands them on
GAINS = range(1, 9)


def words(text: str | None) -> list[str]:
    found = (text or "").lower().split()
    if any(len(w) > LONGEST_WORD for w in found):
        found = [w[i : i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


def windows(text: str | None) -> list[bytes]:
    all_words = words(text)
    return [f" {' '.join(all_words[i : i + WINDOW_WORDS])} ".encode("utf-8", "replace") for i in range(0, len(all_words), WINDOW_WORDS)] or [b""]


def runs(text: str | None) -> set[bytes]:
    """Runs of bytes within the text's windows."""
    return {w[i : i + n] for w in windows(text) for n in RUNS for i in range(len(w) - n + 1)}


def stretches(text: str | None, telling: set[bytes]) -> set[bytes]:
    """The parts of the text's windows that telling runs cover without a gap."""
    out = set()
    for w in windows(text):
        start = end = 0
        for i in range(len(w)):
            reach = max((i + n for n in RUNS if w[i : i + n] in telling), default=0)
            if reach and i > end:
                out.add(w[start:end])
                start = i
            elif reach and not end:
                start = i
            end = max(end, reach)
        out.add(w[start:end])
    return out - {b""}


class Gains:
    """Bytes that the toxic dictionary saves against the ordinary one."""

    def __init__(self, base: bytes, more: bytes):
        import zstandard

        def compressor(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), min_match=SHORTEST, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=how)

        self.ordinary, self.toxic = compressor(base), compressor(base + more)

    def profile(self, text: str | None) -> list[float]:
        gain = np.array([len(self.ordinary.compress(w)) - len(self.toxic.compress(w)) for w in windows(text)])
        top = np.sort(gain)[::-1]
        n = len(gain)
        shares = [float(np.log((gain >= k).mean() + 1 / (n + 5))) for k in GAINS]
        return [float(top[0]), float(top[:3].mean()), float(gain.mean()), float(np.log(n + 1)), *shares]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> dict:
    """Weighted logistic regression on scaled columns by Newton steps, its offset moved so that 0.5 is the best F1."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    weight = weight * len(weight) / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (weight * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    order = np.argsort(-(z @ w), kind="stable")
    hits, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    best = int(np.argmax(2 * hits / (all_ + (weight * y).sum())))
    margins = (z @ w)[order]
    w[-1] -= margins[best] if best + 1 == len(margins) else (margins[best] + margins[best + 1]) / 2
    return {"mean": mean, "spread": spread, "w": w}


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column | None, id_col: str, text_col: str, label_id: str, label_col: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, hash, text) of the sample, and how many labelled rows each class has. Ids are chosen on the labels alone, so
    what is broadcast is at most 2 * per_class ids."""
    known = labels.select(F.col(f"`{label_id}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known if usable is None else known.filter(usable)
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    known = known.withColumn("hash", F.xxhash64("doc_id"))
    ranked = smallest_hashes(known, "toxic", "hash", per_class)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.join(F.broadcast(ranked), "doc_id").select("toxic", "hash", "text"), totals


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "toxic",
    per_class: int = 4000,
) -> dict:
    """The two dictionaries and the curve. ``usable`` is a condition on ``doc_id``; ``per_class`` bounds the sample."""
    rows, totals = labelled_sample(docs, labels, usable, id_col, text_col, label_id, label_col, per_class)
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if not totals.get(1) or not totals.get(0):
        return {"share": float(share), "curve": None}
    rows = rows.withColumn("half", F.pmod("hash", F.lit(2))).persist()

    def handed_on(both: Counter):
        items = list(both.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.binary()), pa.array([v * (k[1] == 1) for k, v in part], pa.int64()), pa.array([v * (k[1] == 0) for k, v in part], pa.int64())],
                ["run", "in_toxic", "in_ordinary"],
            )

    def count(batches):
        both = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                both.update((r, toxic) for r in runs(text))
                if len(both) > HELD:
                    yield from handed_on(both)
                    both.clear()
        yield from handed_on(both)

    halves = {(r.toxic, r.half): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    toxic, ordinary = halves.get((1, 0), 0), halves.get((0, 0), 0)
    first = rows.filter("half = 0")
    sums = map_batches(first, count, "run binary, in_toxic long, in_ordinary long").groupBy("run").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_ordinary").alias("in_ordinary"))
    expected = (F.col("in_ordinary") + 0.5) * (toxic / max(1, ordinary))
    strength = (F.col("in_toxic") - expected) / F.sqrt(expected + 1)
    found = sums.withColumn("strength", strength).filter((F.col("strength") > STANDS_OUT) & (F.col("in_toxic") > 3 * expected))
    telling = {bytes(r.run) for r in found.orderBy(F.desc("strength"), "run").limit(20 * MOST_STRETCHES).collect()}

    def marked(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([s for t in batch.column("text").to_pylist() for s in stretches(t, telling)], pa.binary())], ["stretch"])

    counts = map_batches(first.filter("toxic = 1"), marked, "stretch binary").groupBy("stretch").count()
    most = counts.orderBy(F.desc("count"), "stretch").limit(MOST_STRETCHES).collect()

    def cut(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for t in batch.column("text").to_pylist() for w in windows(t)], pa.binary())], ["window"])

    pool = map_batches(first.filter("toxic = 0"), cut, "window binary").withColumn("hash", F.xxhash64("window"))
    base = b"".join(bytes(r.window) for r in pool.orderBy("hash", "window").limit(BASE_WINDOWS).collect())
    more = b"\0".join([b"", *(bytes(r.stretch) for r in reversed(most))])  # what is nearest to the end is cheapest to point to

    def profiled(batches):
        gains = Gains(base, more)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("hash"), pa.array([gains.profile(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], ["toxic", "hash", "profile"]
            )

    seen = map_batches(rows.filter("half = 1"), profiled, "toxic int, hash long, profile array<double>").orderBy("hash").collect()
    rows.unpersist()
    y = np.array([r.toxic for r in seen], float)
    if not 0 < y.sum() < len(y):
        return {"share": float(share), "curve": None}
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum())
    return {"share": float(share), "base": base, "more": more, "curve": logistic(np.array([r.profile for r in seen]), y, weight)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        curve = known["curve"]
        gains = Gains(known["base"], known["more"]) if curve else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if curve is None:
                scores = np.full(len(texts), known["share"])
            else:
                x = np.array([gains.profile(t) for t in texts]).reshape(len(texts), -1)
                scores = 1 / (1 + np.exp(-np.clip((x - curve["mean"]) / curve["spread"] @ curve["w"][:-1] + curve["w"][-1], -30, 30))) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, score double, predicted int")
