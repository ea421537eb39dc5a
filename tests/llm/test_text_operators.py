"""Operators that map over texts: language, fingerprints, secrets, toxicity, pieces."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from watchfloor.llm import fingerprints, language, pieces, secret_scans, toxicity
from watchfloor.llm.common import Powers

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, `hash` string, `score` int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "the cat and the dog were here with the others " * 5, "en", "a", "h", 1),
        (2, "der hund und die katze sind mit den anderen hier " * 5, "de", "a", "h", 1),
        (3, "le chien et la chatte sont avec les autres ici " * 5, "fr", "b", "h", 1),
        (4, "el perro y la gata están con los otros aquí " * 5, "es", "b", "h", 1),
        (5, None, None, None, None, None),
        (6, "", "en", None, "h", 1),
        (7, "12 34 !!", None, "a", "h", 1),
        (None, "the cat and the dog", None, "a", "h", 1),
        (8, "the cat and the dog", None, "a", "h", 1),
        (8, "the cat and the dog", None, "a", "h", 1),
        (9, "word " * 60_000, None, "a", "h", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- language


def test_language_edges(docs, nothing):
    model = language.train(docs)
    got = {(r.doc_id, r.lang_pred): r.score for r in language.predict(docs, model).collect()}
    assert {(1, "en"), (2, "de"), (3, "fr"), (4, "es"), (5, "und"), (6, "und"), (7, "und"), (8, "en"), (None, "en")} <= set(got)
    assert all(0 <= s <= 1 for s in got.values()) and got[5, "und"] == 0
    assert language.predict(nothing, model).count() == 0
    empty = language.train(nothing)
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    one = language.train(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in language.predict(docs.filter("doc_id < 5"), one).collect()} == {"en"}
    assert sorted(r.doc_id for r in language.in_known_language(docs, model).filter("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 8, 8, 9]


def test_texts_in_scripts_of_no_learnt_language_are_rejected(spark, docs):
    model = language.train(docs)
    texts = ["это простой текст", "да", "ok", "the Greek word λόγος means reason", "straße", "日本語の文章です", "ｆｕｌｌ ｗｉｄｔｈ"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in language.in_known_language(df, model).collect()) == [2, 3, 4, 6]
    taught = language.train(docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(20, "это простой русский текст", "ru")], "doc_id long, text string, lang string")))
    assert sorted(r.doc_id for r in language.in_known_language(df, taught).collect()) == [0, 1, 2, 3, 4, 6]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = language.predict(docs, language.train(docs, usable=~held_out)).join(docs, "doc_id").filter(held_out)
    assert found.filter("lang = lang_pred").count() >= 0.98 * found.count()


def test_long_text_counts_like_its_blocks():
    features = language.Features(language.letter_table())
    assert features.counts("abc").sum() == 5 + 4 + 3  # " abc " in runs of one, two and three
    was, language.BLOCK = language.BLOCK, 7
    try:
        cut = features.counts("einmal ist keinmal, und zweimal ist öfter")
    finally:
        language.BLOCK = was
    assert (cut == features.counts("einmal ist keinmal, und zweimal ist öfter")).all()


def test_family_of():
    assert language.family_of("de") == language.family_of("en") == "germanic" and language.family_of("xx") == "xx"


# ---------------------------------------------------------------- fingerprints


def test_edited_texts_follow_descending_ids(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    for size in (1 << 24, 64):
        got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.compare_with_edits(docs, slice_bytes=size).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fingerprints_estimate_overlap(spark, nothing):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    long, part, other = " ".join(words), " ".join(words[:400]), " ".join(f"x{i}" for i in range(400))
    df = spark.createDataFrame([(1, long), (2, part), (3, other), (4, part), (5, ""), (6, None), (7, "two words")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    a, b, c = (fingerprints.read(got[i].fingerprint) for i in (1, 2, 3))
    assert got[1].n_shingles == 3996 and abs(len(a) * fingerprints.ONE_IN / 3996 - 1) < 0.2
    assert fingerprints.overlap(b, a, False)[1] == 1.0 and fingerprints.overlap(c, a, False) == (0.0, 0.0)
    assert got[2].fingerprint == got[4].fingerprint and got[5].fingerprint == got[6].fingerprint == ""
    assert got[7].n_shingles == 1 and fingerprints.merge(got[1].fingerprint, got[2].fingerprint) == got[1].fingerprint
    assert fingerprints.compare_with_edits(nothing).count() == 0
    alone = fingerprints.compare_with_edits(df.filter("doc_id = 1")).first()
    assert alone.near_next == 1.0 and alone.near_edited < 1.0
    same = {r.doc_id: r for r in fingerprints.compare_with_edits(df).collect()}
    assert same[6].near_edited == 1.0 and same[6].near_next == 1.0  # both empty


def test_sketch_is_the_hashes_below_the_threshold():
    powers = Powers()
    every = fingerprints.sketch("a b c d e f g h i j k l m", powers, one_in=1)
    assert len(every) == 9 and set(fingerprints.sketch("a b c d e f g h i j k l m", powers, one_in=3)) == {h for h in every if h <= (2**64 - 1) // 3}


# ---------------------------------------------------------------- secrets


def brute_spans(text):
    out = []
    out += [("assign", m.start(), m.end()) for m in re.finditer(secret_scans.ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_patterns_and_random_strings(spark, nothing):
    scanner = secret_scans.Scanner(secret_scans.read_ranks(secret_scans.VOCABULARY))
    rng = random.Random(2)
    alphabet = ["token", "SECRET", "api_key", "apikey", "=", ": ", '"', "'", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", " ", "ſecret", "xyz/+-_.", "é", "🙂", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        base, spans = scanner.scan(text)
        assert [(secret_scans.KINDS[k], s, e) for s, k, e in base] == brute_spans(text)
        assert set(base) <= set(spans)
    random_one, plain = "q7Zp2Xk9LmW4vR8tYb3NcJ", "internationalization_of_configuration_settings"
    uuid, sha1, digits = "123e4567-e89b-12d3-a456-426614174000", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "4929348385146306492934"
    rows = [(1, f"é {random_one} {plain} {uuid} {sha1} {digits}"), (2, None), (3, ""), (4, 'token = "abc"'), (5, "token: token=abcdef")]
    got = {r.doc_id: r for r in secret_scans.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == f"random:2:{2 + len(random_one)}" and got[1].n_random == 1
    assert got[2].base_sha256 == got[3].base_sha256 == got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[5].n_assign, got[5].spans) == (1, "assign:0:19")
    assert secret_scans.scan_secrets(nothing).count() == 0


def test_random_strings_beside_names_paths_and_digests():
    scanner = secret_scans.Scanner(secret_scans.read_ranks(secret_scans.VOCABULARY))
    rng, signs = random.Random(8), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    sha1, uuid, upper = "da39a3ee5e6b4b0d3255bfef95601890afd80709", "123e4567-e89b-12d3-a456-426614174000", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709"
    around = [("", ""), ("github_personal_access_key=", ""), ("database_connection_string=", ""), ("/download/attachments/documents/shared/", "/index"), (f"{sha1}/", ""), ("", f"/{sha1}"), (f"/shared/documents/{uuid}/", "")]
    for before, after in around:
        for n in (20, 24, 32, 40):
            keys = ["".join(rng.choice(signs) for _ in range(n)) for _ in range(50)]
            found = 0
            for key in keys:
                text = f"é {before}{key}{after} end"
                spans = scanner.scan(text)[1]
                found += any(k == 3 and s <= text.index(key) and text.index(key) + n <= e for s, k, e in spans)
                assert not scanner.scan(secret_scans.redacted(text, spans, "[SECRET]"))[1]
            assert found >= 49, (before, n)
    cut = "q7Zp2Xk9LmW4-vR8tYb3NcJ0s"  # a key with a separator in it
    start = len("/download/attachments/documents/shared/key=")
    assert any(s <= start and e >= start + len(cut) for s, _, e in scanner.scan(f"/download/attachments/documents/shared/key={cut}")[1])
    for text in ("/download/attachments/documents/shared/index", f"/shared/documents/archive/attachments/{uuid}", f"{sha1}/{upper}", f"{sha1}/{uuid}", f"{sha1}/internationalization_of_configuration"):
        assert all(k != 3 for _, k, _ in scanner.scan(text)[1]), text


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, 'x token = "abcdef0123456789abcdef0123" y', 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, spans int")
    got = {r.doc_id: (r.text, r.spans) for r in secret_scans.redact_secrets(df).collect()}
    assert got == {1: ('x [SECRET]" y', 7), 2: (None, 8), 3: ("clean", 9)}


# ---------------------------------------------------------------- toxicity


def test_toxicity_separates_planted_words(spark, nothing):
    rng = random.Random(3)
    plain, nasty = [f"word{i}" for i in range(300)], ["grubblefoot", "snarkwart", "zilchbrain"]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(plain) for _ in range(60)]
        if i % 3 == 0:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(nasty)
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0), 0))
    rows += [(1000, None), (1001, ""), (1002, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, text int")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, labels, usable=~held_out)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == (i % 3 == 0) for i in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and len(got) == 603
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_toxic_dictionary_holds_short_inner_and_joined_markers(spark):
    rng = random.Random(7)
    plain = ["".join(rng.choice("bdfghlmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)] + ["leave", "us", "alone"]
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    kinds = {
        "short": lambda ws: ws[:20] + ["kys"] + ws[20:40] + ["kys"] + ws[40:],
        "inner": lambda ws: [w[:3] + "zzqx" + w[3:] if k % 15 == 0 else w for k, w in enumerate(ws)],
        "phrase": lambda ws: ws[:20] + ["leave", "us", "alone"] + ws[20:40] + ["leave", "us", "alone"] + ws[40:],
        "unspaced": lambda ws: ["".join(rng.choice(signs) for _ in range(150)) + "去死吧" + "".join(rng.choice(signs) for _ in range(150))],
    }
    rows, kind = [], {}
    for i in range(1600):
        words = [rng.choice(plain) for _ in range(60)]
        kind[i] = name = list(kinds)[i % 4] if i % 3 == 0 else None
        if name is None and i % 4 == 3:
            words = ["".join(rng.choice(signs) for _ in range(300))]
        rows.append((i, " ".join(kinds[name](words) if name else words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(name is not None)) for i, name in kind.items()], "doc_id long, toxic int")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, labels, usable=~held_out)
    parts = [p for p in model["more"].split(b"\0") if p]
    windows = [w for i, t in rows if kind[i] for w in toxicity.windows(t)]
    assert parts and all(any(p in w for w in windows) for p in parts)  # cut from toxic text
    assert all(marker.encode() in model["more"] for marker in (" kys ", "zzqx", " us alone ", "去死吧"))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    for name in [None, *kinds]:
        test = [i for i in kind if kind[i] == name and zlib.crc32(str(i).encode()) % 5 == 0]
        assert sum(got[i] == (name is not None) for i in test) >= 0.8 * len(test), name


# ---------------------------------------------------------------- pieces


def test_pieces_equal_the_public_library(spark, docs, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(4)
    alphabet = "ab  \n\ne▁éñ漢🙂<s>tho1  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", " ", "   ", "\t\0x", "unbelievable internationalization", "a  b   c    d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in pieces.encode(df, check=True).collect()}
    assert [got[i].ids for i in range(len(texts))] == library.encode(texts)
    assert all(got[i].round_trip for i, t in enumerate(texts) if "▁" not in t)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df)).collect()}
    assert all(back[i] == t for i, t in enumerate(texts) if "▁" not in t)
    edge = {(r.doc_id, r.n_tokens) for r in pieces.encode(docs).collect()}
    assert (5, None) in edge and (6, 0) in edge and pieces.encode(nothing).count() == 0


def test_unigram_viterbi_against_brute_force():
    model = pieces.Model.__new__(pieces.Model)
    model.texts = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab", "ca", "bca"]
    model.scores = [0.0, -3.1, -3.0, -3.2, -3.3, -4.1, -4.3, -4.0, -5.9, -6.2, -4.6, -5.7]
    model.kinds = [pieces.UNKNOWN] + [pieces.NORMAL] * 11
    model.kind, model.prefix, model.squeeze = pieces.UNIGRAM, True, True
    model.finish()
    encoder, rng = pieces.Encoder(model), random.Random(6)

    def best(text):
        table = [(0.0, [])]
        for end in range(1, len(text) + 1):
            options = [(table[s][0] + model.scores[model.ids[text[s:end]]], table[s][1] + [model.ids[text[s:end]]]) for s in range(end) if text[s:end] in model.ids]
            options += [(table[end - 1][0] + min(model.scores) - 10, table[end - 1][1] + [0])] if text[end - 1] not in model.ids else []
            table.append(max(options, key=lambda o: o[0]))
        return table[-1][0]

    for _ in range(300):
        text = "".join(rng.choice("abcx ") for _ in range(rng.randrange(14)))
        ids = encoder.encode([text])[0]
        marked = model.normalised(text)
        assert sum(model.scores[i] if i else min(model.scores) - 10 for i in ids) == pytest.approx(sum(best(u) for u in model.units.findall(marked)))


def test_language_sample_is_bounded_whatever_the_ids(spark):
    rows = [(None if k % 3 else 1, f"text {k // 4}", "en" if k % 2 else "de") for k in range(2000)] + [(7, "the same", "en")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("hash", F.xxhash64("doc_id", "text"))
    found = language.sample(df, 10).collect()
    assert {lang: sum(r.lang == lang for r in found) for lang in ("en", "de")} == {"en": 10, "de": 10}
    assert len({(r.lang, r.doc_id, r.text) for r in found}) == 20
