"""Operators 11 to 13 against brute force: phrases, token files, Merkle manifests."""

import hashlib
import heapq
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from watchfloor.llm import collocations, merkle, queries, token_files

SMALL = "/root/testdata/sf0.001"
# Extra columns carry names that the operators use inside.
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, h string, idx int, part int, `row` int, tree string, n int, phrase string, ids string, block int"
EXTRA = ("x", 1, 1, 1, "x", 1, "x", "x", 1)


def frame(spark, rows):
    return spark.createDataFrame([r + EXTRA for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "cold", "war", "new", "york", "city", "of", "and", "Straße", "it's", "x" * 300, "日本", "naïve"]
    out = [
        (1, None, None, None, None),
        (2, "b", "en", 0, ""),
        (None, "b", "en", 5, "a b c"),
        (None, "b", "en", 5, "a b c"),
        (3, "", "en", 3, "\n\t \r\n"),
        (4, "a", "de", 9, "new york, new york\nNEW\tYORK  new york"),
        (4, "a", "de", 9, "new york, new york\nNEW\tYORK  new york"),
        (5, "only", "fr", 1, "<|endoftext|> é Å <|startoftext|>x İ ς"),
        (6, "a", "en", 1, "new york city " * 9000),
    ]
    for k in range(7, 160):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(0, 60)))
        out.append((k, rng.choice(["a", "a", "b", None]), rng.choice(["en", "en", "de", None]), k, text))
    return out


# ---------------------------------------------------------------- phrases


def brute_phrases(rows, width=4, least=30, scale=2_000_000, percent=80, most=2000):
    counts, totals = Counter(), Counter()
    for _, _, lang, _, text in rows:
        lang = lang or "und"
        clean = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        for piece in re.split("[.,;:!?\x0a-\x0d]", clean):
            words = re.findall("[^\x20\t]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, width + 1):
                    if i + k <= len(words):
                        counts[lang, tuple(words[i : i + k])] += 1
    found = {key: n for key, n in counts.items() if n >= least and len(key[1]) > 1}
    gone = set()
    for (lang, words), n in found.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, words[i : i + size])
                if 100 * n >= percent * counts[part]:
                    gone.add(part)
    out = []
    for (lang, words), a in found.items():
        if (lang, words) in gone:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((scale * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, totals[lang], score))
    ranked = []
    for lang in totals:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


@pytest.mark.parametrize(("width", "least", "most"), [(4, 30, 2000), (4, 3, 7), (2, 2, 2000), (5, 2, None)])
def test_phrases_equal_counting_all(spark, rows, width, least, most):
    got = sorted(tuple(r) for r in collocations.phrases(frame(spark, rows), width=width, least=least, most=most).collect())
    assert got == brute_phrases(rows, width, least, most=most or 10**9)


def test_words_that_are_names_of_languages_stay_in_their_own(spark):
    texts = {"en": "en de es de de und", "de": "en en es und es de", "es": "es en und de es es", None: "und en de es und"}
    rows = [(k, "a", lang, 1, text) for k, (lang, text) in enumerate([*texts.items()] * 7)]
    got = sorted(tuple(r) for r in collocations.phrases(frame(spark, rows), least=7).collect())
    assert got == brute_phrases(rows, least=7)
    counted = collocations.frequent_phrases(frame(spark, rows), least=1).filter("words = 1")
    assert {(r.lang, r.phrase): r.f for r in counted.collect()} == Counter((lang or "und", w) for _, _, lang, _, text in rows for w in text.split())


def test_phrases_where_parts_hand_on_early(spark, rows, monkeypatch):
    for name, value in {"CHUNKS_HELD": 5, "PHRASES_HELD": 10, "BUFFER_BYTES": 100, "TABLE_BITS": 10, "SLICE_BITS": 6, "CHUNK_WORDS": 3}.items():
        monkeypatch.setattr(collocations, name, value)
    got = sorted(tuple(r) for r in collocations.phrases(frame(spark, rows), least=5).collect())
    assert got == brute_phrases(rows, least=5)


def test_chunks_cover_every_word_once():
    rng, powers = random.Random(1), collocations.Powers()
    for _ in range(50):
        data = bytes(rng.choice(b"ab \n") for _ in range(rng.randint(0, 400)))
        for overlap in (1, 3):
            chunks, total = collocations.chunks_of(data, overlap, powers)
            words = sum(len(c.split()) - overlap * c.endswith(b" ") for c in chunks)
            assert words == total == len(data.split())
            for a, b in zip(chunks, chunks[1:], strict=False):
                if a.endswith(b" "):
                    assert a.split()[-overlap:] == b.split()[:overlap]


def test_repeated_text_is_counted_by_its_chunks(spark):
    text = " ".join(f"w{k % 97}" for k in range(2000))
    one = collocations.dictionary(frame(spark, [(1, "a", "en", 1, text)]))
    many = collocations.dictionary(frame(spark, [(k, "a", "en", 1, text) for k in range(50)]))
    assert many.count() == one.count()
    assert many.agg(F.sum("n")).first()[0] == 50 * one.agg(F.sum("n")).first()[0]


def test_phrases_of_nothing(spark):
    assert collocations.phrases(frame(spark, [])).count() == 0
    assert collocations.phrases(frame(spark, [(1, None, None, None, None), (2, "a", "en", 1, " . ")])).count() == 0


# ---------------------------------------------------------------- token files


def huffman_bits(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def test_code_lengths_are_the_best():
    rng = np.random.default_rng(3)
    for n in (2, 3, 10, 300, 5000):
        counts = rng.integers(1, 1000, n)
        lengths = token_files.code_lengths(counts, 40)
        assert int((lengths * counts).sum()) == huffman_bits(counts)
        assert sum(2.0 ** -lengths.astype(float)) == 1
    steep = 3 ** np.arange(30)
    lengths = token_files.code_lengths(steep, 8)
    assert lengths.max() == 8 and sum(2.0 ** -lengths.astype(float)) <= 1
    assert token_files.code_lengths(np.array([0, 0, 7])).tolist() == [0, 0, 1]
    with pytest.raises(ValueError, match="do not fit"):
        token_files.code_lengths(np.ones(300, int), 8)


def test_codes_are_canonical_and_decode():
    rng = np.random.default_rng(4)
    counts = np.concatenate([[0], (rng.pareto(0.7, 3000) * 5 + 1).astype(np.int64)])
    code = token_files.Code(token_files.code_lengths(counts))
    used = np.flatnonzero(code.lengths)
    texts = [format(int(code.codes[i]), f"0{code.lengths[i]}b") for i in used]
    assert sorted(texts) == [t for _, _, t in sorted(zip(code.lengths[used].tolist(), used.tolist(), texts, strict=True))]
    assert not any(b.startswith(a) for a, b in zip(sorted(texts), sorted(texts)[1:], strict=False))
    for n in (0, 1, 127, 128, 129, 4000):
        ids = rng.choice(used, n)
        packed, stretches = code.pack(ids)
        assert len(packed) == -(-int(code.lengths[ids].sum()) // 8)
        assert code.unpack(packed, stretches, n).tolist() == ids.tolist()


def brute_tokens(rows, tokenizer):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer)
    out, start = [], 0
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*known.encode(row[4] or "", add_special_tokens=False).ids, 2]
        out.append((row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("by_words", [True, False])
def test_token_files_equal_the_library(spark, rows, tmp_path, by_words, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(token_files, "RANGE_BYTES", 500)
    monkeypatch.setattr(token_files, "FILE_BYTES", 4000)
    monkeypatch.setattr(token_files, "WORDS_KEPT", 20)
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_tokens(frame(spark, rows).repartition(5), folder, by_words=by_words)
    assert manifest.count() > 1
    read = token_files.read_tokens(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    # Rows that share an id may stand in either order.
    want = brute_tokens(rows, token_files.TOKENIZER)
    assert sorted((tuple(r)[0::2] for r in read if r[0] is not None)) == sorted(w[0::2] for w in want if w[0] is not None)
    assert sorted((r[1], r[2], r[3]) for r in read) == sorted((w[1], w[2], w[3]) for w in want)


def test_words_split_at_blanks_encode_as_whole_texts():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(token_files.TOKENIZER)
    with open(token_files.TOKENIZER, encoding="utf-8") as file:
        words, rng = token_files.Words(known, file.read(), "<u2"), random.Random(9)
    signs = "¡¿ªº²µ×÷ŸĀſ–—“”…ȺȾabcXYZ019 \t\n\r\x0b\x0c\x1c\x85  ́̈ͅéÉßİıΣσςǅ中文한글́'`.,-_<|>‍😀﻿가"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abtsrveld09'-. ") for _ in range(30)) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "<|startoftext|>", "it's I'LL we 've", "Ångström Å", " ", ""]
    ids, sizes = words.encode(pa.array(texts))
    got = [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [known.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_of_nothing_and_cut_off(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_files.round_trip(spark, frame(spark, []), folder).count() == 0
    folder = f"file://{tmp_path}/cut"
    manifest = token_files.write_tokens(frame(spark, [(1, "a", "en", 1, "some words"), (2, "a", "en", 1, None)]), folder)
    assert [tuple(r) for r in token_files.read_tokens(manifest, folder).select("doc_id", "start", "n_tokens").orderBy("doc_id").collect()] == [(1, 0, 3), (2, 3, 1)]
    for file in (tmp_path / "cut").iterdir():
        file.write_bytes(file.read_bytes()[:-3])
    with pytest.raises(Exception, match="not a token file"):
        token_files.read_tokens(manifest, folder).collect()


# ---------------------------------------------------------------- memory of counting phrases


def counted(n):
    """Twenty parts of ``n`` places in all, some of them of the same phrases, and the phrases with their counts."""
    rng, counts, sums = np.random.default_rng(3), collocations.Counts(), Counter()
    for _ in range(20):
        first = rng.integers(-(1 << 63), 1 << 63, n // 20, np.int64)
        first[: n // 200] = np.arange(n // 200) // 2
        second = (np.arange(n // 20) % 2).astype(np.int32)
        counts.add(first, second, np.full(n // 20, 3, np.int64), first, second)
        sums.update(zip(first.tolist(), second.tolist(), strict=True))
    return counts, {k: 3 * v for k, v in sums.items()}


def test_adding_up_phrases_holds_no_second_copy():
    counts, want = counted(400_000)
    held = sum(c.nbytes for part in counts.parts for c in part)
    tracemalloc.start()
    columns = counts.settled()
    most = tracemalloc.get_traced_memory()[1]  # beside the parts, which were made before and go meanwhile
    tracemalloc.stop()
    assert {(f, s): n for f, s, n in zip(*(c.tolist() for c in columns[:3]), strict=True)} == want
    assert np.all(np.diff(columns[0]) >= 0) and np.array_equal(columns[0], columns[3]) and not len(counts)
    assert most < 2 * held


def test_phrases_are_handed_on_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(collocations, "HANDED_BYTES", 1 << 20)
    columns = counted(200_000)[0].settled()
    starts = np.array([k * (1 << 64) // 96 - (1 << 63) for k in range(1, 96)], np.int64)
    batches = list(collocations.handed_on(columns, starts))
    rows = [(k, data) for b in batches for k, data in zip(b.column("range").to_pylist(), b.column("phrases").to_pylist(), strict=True)]
    assert [k for k, _ in rows] == list(range(96))
    assert max(b.nbytes for b in batches) < (1 << 20) + 2 * max(len(data) for _, data in rows)
    width, at = sum(c.itemsize for c in columns), 0
    for _, data in rows:
        n = len(data) // width
        assert data == b"".join(c[at : at + n].tobytes() for c in columns)
        at += n
    assert at == len(columns[0])
    assert not list(collocations.handed_on(collocations.Counts().settled(), starts))


# ---------------------------------------------------------------- Merkle manifests


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def tree(nodes, fanout):
    """Root, and for each node its siblings level by level as (left, right)."""
    paths, groups, level = [[] for _ in nodes], [[k] for k in range(len(nodes))], list(nodes)
    while len(level) > 1:
        above, members = [], []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            for k in range(len(run)):
                for node in groups[at + k]:
                    paths[node].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            members.append([n for g in groups[at : at + fanout] for n in g])
        level, groups = above, members
    return level[0], paths


def brute_merkle(rows, fanout):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    mine = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in mine[s]], fanout) for s in sources}
    root, upper = tree([trees[s][0] for s in sources], fanout)
    out = []
    for s, above in zip(sources, upper, strict=True):
        for row, path in zip(mine[s], trees[s][1], strict=True):
            path = path + above
            tampered = row[4] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            node = leaf((*row[:4], row[4].replace("\n", ""))) if tampered else leaf(row)
            for left, right in path:
                node = sha(left, node, right)
            out.append((row[0], leaf(row), trees[s][0], root, sha(*(x for p in path for x in p)), node, node == root))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_merkle_equals_building_by_hand(spark, rows, fanout):
    docs = frame(spark, rows).repartition(4)
    gone = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.verified(docs, fanout=fanout, seen={"text": gone}).withColumn("proof", F.sha2(merkle.proof_text(F.col("proof")).cast("binary"), 256))
    got = [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()]
    assert sorted(got, key=repr) == sorted(brute_merkle(rows, fanout), key=repr)
    assert {v for *_, v in got} == {True, False}


def test_merkle_of_nothing_and_of_one(spark):
    assert merkle.verified(frame(spark, [])).count() == 0
    one = merkle.verified(frame(spark, [(1, None, None, None, None)])).first()
    assert one.leaf == one.root == one.folded_root and one.proof == [] and one.verified


def test_manifest_lists_all_nodes(spark, rows):
    forest = merkle.Forest(merkle.leaves(frame(spark, rows)), 3)
    sizes = Counter((r.tree, r.level) for r in forest.manifest().collect())
    for name in {t for t, _ in sizes}:
        n, level = sizes[name, 0], 0
        while n > 1:
            n, level = -(-n // 3), level + 1
            assert sizes[name, level] == n
        assert sizes[name, level] == 1


# ---------------------------------------------------------------- the registered queries


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", name).collect()]


def test_queries_equal_brute_force(spark):
    rows = table(spark, "text")
    got = sorted(tuple(r) for r in queries.QUERIES["op11_collocations"](spark, SMALL).collect())
    assert got == brute_phrases(rows)
    got = sorted(tuple(r) for r in queries.QUERIES["op12_token_files"](spark, SMALL).collect())
    assert got == sorted(brute_tokens(rows, token_files.TOKENIZER))
    got = sorted(tuple(r) for r in queries.QUERIES["op13_merkle"](spark, SMALL).collect())
    assert got == sorted(brute_merkle(rows, 3))
