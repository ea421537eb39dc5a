"""Language identification in two steps: the family first, then the language within the family.

A text is lower-cased, everything but letters becomes one space, and its runs of one to three characters are counted in
hashed bins; the square roots of the counts, scaled to length one, are its features. Families are told apart by
one-versus-one linear support vector machines over all their languages; inside the family that wins, one-versus-one
machines separate the languages that are close to each other. Each machine's margin becomes a probability by a logistic
curve fitted on rows it was not trained on.

Training reads a bounded sample: of each language the ``per_language`` rows with the smallest hash of their id. Each
machine is one task of at most a few thousand such rows. Prediction is a map over whole texts.

The model also keeps the scripts of its languages. Every text with letters gets one of its languages, so the filter
``in_known_language`` rejects a text if most of its letters are of scripts that none of them is written in.

Defined results: a null text or one without letters is ``und`` with score 0; without a labelled row everything is ``und``.
With one language in all, or one in a family, no machine is needed and that step is certain. Null labels are never
learnt from. Repeated rows are scored each. Long texts are counted in blocks.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.llm.common import map_batches, smallest_hashes

# Families of common written languages by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "iranian": "fa ku ps tg",
    "indic": "hi bn ur mr ne pa gu sa",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "malayic": "id ms jv su tl",
}
UNKNOWN = "und"
BITS = 12
BLOCK = 1 << 20
MULTIPLIER = 2654435761  # 2**32 divided by the golden ratio


def family_of(lang: str, families: Mapping[str, str] = FAMILIES) -> str:
    return next((name for name, codes in families.items() if lang in codes.split()), lang)


def letter_table() -> bytes:
    """One bit for each code point: is it a letter? Built once on the driver (139 kB)."""
    return np.packbits(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)).tobytes()


def script_of(letter: str) -> str:
    """The script by the first word of the letter's name; compatibility forms count as what they stand for."""
    return unicodedata.name(unicodedata.normalize("NFKC", letter)[0], "").split(" ")[0]


def main_scripts(text: str) -> list[str]:
    """The scripts of at least a tenth of the text's letters."""
    counts = Counter()
    for sign, n in Counter(text).items():
        if sign.isalpha():
            counts[script_of(sign)] += n
    return sorted(x for x, n in counts.items() if 10 * n >= counts.total())


def script_table(scripts: list[str]) -> bytes:
    """One bit for each code point: is it a letter of these scripts?"""
    return np.packbits(np.fromiter((chr(c).isalpha() and script_of(chr(c)) in scripts for c in range(0x110000)), bool, 0x110000)).tobytes()


class Features:
    def __init__(self, table: bytes, bits: int = BITS):
        self.letters, self.bits = np.unpackbits(np.frombuffer(table, np.uint8)).astype(bool), bits

    def counts(self, text: str) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.int64)
        shift = np.uint32(32 - self.bits)
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = self.letters[codes]
        if not letter.any():
            return out
        before = np.concatenate([[False], letter[:-1]])
        kept = letter | before
        x = np.concatenate([[32], np.where(letter, codes, 32)[kept], [32]]).astype(np.uint32)
        for start in range(0, len(x), BLOCK):
            block = x[start : start + BLOCK + 2]
            rolling = np.zeros(len(block), np.uint32)
            for n in range(3):
                rolling = rolling[: len(block) - n] * np.uint32(0x01000193) + block[n:] + np.uint32(n + 1)
                grams = rolling[: min(BLOCK, len(rolling))]
                mixed = grams * np.uint32(MULTIPLIER)
                mixed ^= mixed >> np.uint32(15)
                out += np.bincount((mixed * np.uint32(0x85EBCA6B)) >> shift, minlength=len(out))
        return out

    def __call__(self, text: str | None) -> np.ndarray | None:
        counts = self.counts(text) if text else None
        if counts is None or not counts.any():
            return None
        root = np.sqrt(counts).astype(np.float32)
        return root / np.linalg.norm(root)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 30) -> np.ndarray:
    """Weights of the L2-loss support vector machine by dual coordinate descent; the last weight is the bias. y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    curve, ridge = (x * x).sum(1) + 0.5 / cost, 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1 + ridge * alpha[i]
            step = max(alpha[i] - slope / curve[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the curve 1 / (1 + exp(-(slope * margin + offset))) by Newton steps, with smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z, beta = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (target - p) - 1e-3 * (beta - [1, 0]))
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A machine trained on all rows; its curve comes from a machine that has not seen every third row."""
    third = np.arange(len(x)) % 3 == 2
    if min((y[third] > 0).sum(), (y[third] < 0).sum()) == 0:
        return linear_svm(x, y), 2.0, 0.0
    w = linear_svm(x[~third], y[~third])
    slope, offset = logistic(x[third] @ w[:-1] + w[-1], y[third])
    return linear_svm(x, y), slope, offset


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """Of each language the rows with the smallest hash of id and text, one of those that repeat each other, ``per_language``
    at most. The cut is found on hashes alone; of texts only the sample is shuffled."""
    ranked = smallest_hashes(docs.select("lang", "hash").distinct(), "lang", "hash", per_language)
    cuts = {r.lang: r.cut for r in ranked.groupBy("lang").agg(F.max("hash").alias("cut")).collect()}
    if not cuts:
        return docs.filter("false")
    limit = F.element_at(F.create_map(*[F.lit(v) for pair in sorted(cuts.items()) for v in pair]), F.col("lang"))
    return docs.filter(F.col("hash") <= limit).dropDuplicates(["lang", "hash"])


def train(
    docs: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 1000,
    families: Mapping[str, str] = FAMILIES,
) -> dict:
    """The model: languages by family, and weights and curve of every machine. ``usable`` says which rows may be learnt from.

    ``per_language`` bounds the sample; what comes to the driver is a vector of 4,097 weights for each pair.
    """
    rows = docs if usable is None else docs.filter(usable)
    rows = rows.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("hash"))
    rows = sample(rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), per_language)
    table = docs.sparkSession.sparkContext.broadcast(letter_table())

    def featured(batches):
        features = Features(table.value)
        for batch in batches:
            found = [(lang, f, main_scripts(text)) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if (f := features(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.string()), pa.array([f.tobytes() for _, f, _ in found], pa.binary()), pa.array([s for _, _, s in found], pa.list_(pa.string()))], ["lang", "x", "scripts"])

    rows = map_batches(rows, featured, "lang string, x binary, scripts array<string>").persist()
    total = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(total)
    in_script = rows.select("lang", F.explode("scripts").alias("script")).groupBy("lang", "script").count().collect()
    scripts = sorted({r.script for r in in_script if 20 * r["count"] >= total[r.lang]})  # one foreign text does not count
    by_family = defaultdict(list)
    for lang in langs:
        by_family[family_of(lang, families)].append(lang)
    side = {}  # machine -> language -> side
    for a, b in itertools.combinations(sorted(by_family), 2):
        side["family", a, b] = {x: 1 for x in by_family[a]} | {x: -1 for x in by_family[b]}
    for members in by_family.values():
        for a, b in itertools.combinations(members, 2):
            side["language", a, b] = {a: 1, b: -1}
    names = list(side)
    machines = {}
    if names:
        of = {lang: [f"{i}:{s[lang]}" for i, s in enumerate(side.values()) if lang in s] for lang in langs}
        wanted = F.element_at(F.create_map(*[v for k, x in of.items() for v in (F.lit(k), F.array(*map(F.lit, x)))]), F.col("lang"))
        parts = F.split("part", ":")
        dealt = rows.select("x", F.explode(wanted).alias("part")).select("x", parts.alias("p")).select("x", F.col("p")[0].cast("int").alias("machine"), F.col("p")[1].cast("int").alias("y"))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("x")  # the same order whatever the partitions
            x = np.stack([np.frombuffer(v, np.float32) for v in pdf.x])
            w, slope, offset = machine(x, pdf.y.to_numpy(np.float64))
            return pd.DataFrame({"machine": [pdf.machine.iloc[0]], "w": [w.astype(np.float32).tobytes()], "slope": [slope], "offset": [offset]})

        for r in dealt.groupBy("machine").applyInPandas(fit, "machine int, w binary, slope double, offset double").collect():
            machines[names[r.machine]] = (np.frombuffer(r.w, np.float32), r.slope, r.offset)
    rows.unpersist()
    return {"families": dict(by_family), "machines": machines, "scripts": scripts}


def vote(names: list[str], kind: str, odds: dict) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each name (rows of texts) as the mean over its machines, scaled to sum to one."""
    n = len(next(iter(odds.values()))) if odds else 0
    share = np.zeros((n, len(names)))
    for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
        p = odds[kind, a, b]
        share[:, i] += p
        share[:, j] += 1 - p
    if len(names) == 1:
        share[:] = 1
    return share / share.sum(1, keepdims=True)


class Judge:
    """The model inside a task: (language, score, family) of each text."""

    def __init__(self, table: bytes, model: dict):
        self.features, self.machines, self.families = Features(table), model["machines"], model["families"]
        self.weights = np.stack([m[0] for m in self.machines.values()], 1) if self.machines else None

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        out = [(UNKNOWN, 0.0, UNKNOWN)] * len(texts)
        found = [self.features(t) for t in texts]
        at = [i for i, f in enumerate(found) if f is not None] if self.families else []
        if not at:
            return out
        odds = {"none": np.zeros(len(at))}
        if self.weights is not None:
            margin = np.stack([found[i] for i in at]) @ self.weights[:-1] + self.weights[-1]
            odds |= {k: 1 / (1 + np.exp(-np.clip(s * margin[:, c] + o, -30, 30))) for c, (k, (_, s, o)) in enumerate(self.machines.items())}
        names = sorted(self.families)
        first = vote(names, "family", odds)
        within = {f: vote(self.families[f], "language", odds) for f in names}
        for row, i in enumerate(at):
            best = int(first[row].argmax())
            inner = within[names[best]][row]
            out[i] = self.families[names[best]][int(inner.argmax())], float(first[row, best] * inner.max()), names[best]
        return out


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and family for every whole text."""
    spark = docs.sparkSession
    table, sent = spark.sparkContext.broadcast(letter_table()), spark.sparkContext.broadcast(model)

    def run(batches):
        judge = Judge(table.value, sent.value)
        for batch in batches:
            langs, scores, families = zip(*judge(batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(families, pa.string())], ["doc_id", "lang_pred", "score", "family"]
            )

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, family string")


def in_known_language(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The documents, with all their columns, that are in a language of the model with at least the given score; a text
    without letters is in none, nor is one whose letters are mostly of scripts that no language of the model uses, however
    short it is. Short texts of any language may score low, so no score is asked for by default; an untaught language in a
    taught script then passes. A model without languages rejects everything."""
    spark = docs.sparkSession
    table, sent = spark.sparkContext.broadcast(letter_table()), spark.sparkContext.broadcast(model)

    scripts = spark.sparkContext.broadcast(script_table(model["scripts"]))

    def run(batches):
        judge = Judge(table.value, sent.value)
        known = np.unpackbits(np.frombuffer(scripts.value, np.uint8)).astype(bool)

        def in_known_script(text: str) -> bool:
            codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            return 2 * int(known[codes].sum()) >= int(judge.features.letters[codes].sum())

        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            kept = [lang != UNKNOWN and score >= least and in_known_script(text) for text, (lang, score, _) in zip(texts, judge(texts), strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return map_batches(docs, run, docs.schema)
