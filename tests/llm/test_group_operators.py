"""Operators that bring rows together: near copies, vectors, mixing, archives, repeats, components."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from watchfloor.llm import mixing, near_copies, near_vectors, repeats, warc
from watchfloor.llm.common import finish
from watchfloor.llm.components import components

TEXTS = "doc_id long, text string, node string, source string"


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- components


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(2000, 2200)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == roots(ends, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- near copies


def shingles(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words)


def similar(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def corpus(rng):
    words = [f"w{i}" for i in range(500)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    chain = [rng.choice(words) for _ in range(200)]  # a drifting series: neighbours are alike, its ends are not
    for step in range(10):
        chain = chain[:]
        for k in range(3):
            chain[(step * 17 + k) % 200] = rng.choice(words)
        rows.append(" ".join(chain))
    rows += [("la la li " * 80).strip(), ("la la li " * 70).strip(), ("la la li " * 20).strip(), "one", "one", "ONE", "", None, "  "]
    rng.shuffle(rows)
    return rows


def test_near_copies_against_all_pairs(spark):
    texts = corpus(random.Random(8))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], TEXTS)
    bags = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(bags)) for j in range(i) if similar(bags[i], bags[j]) >= 0.8]
    want = roots(range(len(texts)), links)
    got = near_copies.near_copy_groups(df).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted(set(want.values()))
    assert sorted(r.doc_id for r in near_copies.without_near_copies(df).collect()) == sorted(set(want.values()))


def test_near_copies_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, text, "", ""), (4, text, "", ""), (4, text, "", ""), (9, "other words here", "", ""), (None, "alone is this one", "", "")], TEXTS)
    assert sorted(((r.doc_id, r.class_id) for r in near_copies.near_copy_groups(df).collect()), key=repr) == sorted([(None, 4), (4, 4), (4, 4), (9, 9), (None, None)], key=repr)
    assert sorted((r.doc_id for r in near_copies.without_near_copies(df).collect()), key=repr) == [4, 9, None]
    assert near_copies.near_copy_groups(df.limit(0)).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a = rng.integers(1, 9, 60)
    b = np.where(rng.random(60) < 0.4, rng.integers(1, 30, 60), a)
    hits = []
    for k in range(30):
        hashes = finish(np.arange(60, dtype=np.uint64) + np.uint64(1000 * k))
        s = near_copies.signatures([(hashes, a), (hashes, b), (hashes[:0], a[:0])], 192)
        assert np.isinf(s[2]).all() and np.isfinite(s[:2]).all()
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    hashes = finish(np.arange(40, dtype=np.uint64))
    ones = np.ones(40, np.int64)
    together = near_copies.signatures([(hashes, ones), (hashes[:5], ones[:5])], 64)
    assert (together[1] == near_copies.signatures([(hashes[:5], ones[:5])], 64)[0]).all()


# ---------------------------------------------------------------- vectors


@pytest.mark.parametrize("chunk_rows", [4096, 40])
def test_vectors_against_all_pairs(spark, chunk_rows):
    rng = np.random.default_rng(4)
    vectors = [*rng.normal(size=(60, 16))]
    center = rng.normal(size=16)
    vectors += [center + rng.normal(size=16) * s for s in (0.02, 0.1, 0.2, 0.3) for _ in range(40)]
    vectors += [center, center, center * 7.5, -center, np.zeros(16)]
    vectors = [v.tolist() for v in vectors] + [[1.0, float("nan")] * 8, [1.0, float("inf")] * 8, None, [None] + [1.0] * 15, [], [3.0, 4.0], [6.0, 8.0], [-0.0, 2.0], [0.0, 2.0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, node int")

    def usable(v):
        return bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)

    links = []
    for i, v in enumerate(vectors):
        for j in range(i):
            w = vectors[j]
            if usable(v) and usable(w) and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.95:
                    links.append((i, j))
    count = Counter(x for link in links for x in link)
    component = roots(range(len(vectors)), links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vector_groups(df, chunk_rows=chunk_rows).collect()}
    assert len(links) > 3000 and got == {i: (count[i], component[i], component[i] == i) for i in range(len(vectors))}


def test_vectors_empty_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert near_vectors.near_vector_groups(spark.createDataFrame([], schema)).count() == 0
    got = near_vectors.near_vector_groups(spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.01])], schema)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == sorted([(3, 2, 3), (3, 2, 3), (1, 0, 1), (None, 2, 3)], key=repr)


# ---------------------------------------------------------------- mixing


def filled(sizes, weights, budget, repeats=2):
    """Targets by the rule itself: share by weight, stop at the cap, share the excess again."""
    open_, target = dict(zip(sizes, weights, strict=True)), {}
    left = budget
    while open_:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > repeats * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in open_.items()}
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(1, 60), "", rng.choice(["a", "b", "b", "b", "b", "c", "d", None])) for i in range(900)]
    rows += [(2000, None, "", "a"), (2001, " \t\n", "", "b"), (None, "x y", "", "c"), (3000, "x y z", "", "e"), (3000, "x y z", "", "e")]
    df = spark.createDataFrame(rows, TEXTS)
    got = mixing.mix_sources(df).collect()
    words = Counter()
    for _, text, _, source in rows:
        words[source] += len((text or "").split())
    order = sorted(words, key=lambda s: (s is None, s or ""))
    target = filled({s: words[s] for s in order}, [[3, 1, 2][i % 3] for i in range(len(order))], 1.5 * sum(words.values()))
    source_of = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == words[source_of[r.doc_id]]
        assert r.target == pytest.approx(target[source_of[r.doc_id]])
        taken[source_of[r.doc_id]] += r.taken
    assert sum(taken.values()) == int(1.5 * sum(words.values())) and len(got) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 60 for s in words)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in got)
    copies = mixing.mixed_documents(df)
    assert copies.columns == df.columns
    assert sum(len(r.text.split()) for r in copies.collect()) == sum(taken.values())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], TEXTS)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    wordless = spark.createDataFrame([(1, None, "", "a"), (2, "", "", None)], TEXTS)
    assert [(r.target, r.taken) for r in mixing.mix_sources(wordless).collect()] == [(0.0, 0)] * 2


# ---------------------------------------------------------------- archives


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_pages_come_back_from_archives(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 5), (2, "http://b/\r\nX: 1", "x" * 5), (3, None, ""), (4, "u", None), (5, "u", "é" * 200_000), (None, "u", "x" * 5), (1, "v", "x" * 5), (6, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (7, "é", "only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.archived(spark, df, str(tmp_path)).collect()), key=repr)
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(ids) if ids else None
        visit = first is not None and page_id != first
        want.append((page_id, len(payload), sha(payload), "revisit" if visit else "response", first if visit else None, None if visit else payload))
    assert got == sorted(want, key=repr)
    for path in (tmp_path / "members").glob("*.warc.gz"):  # every line of an index opens one whole record
        data = path.read_bytes()
        for line in path.with_name(path.name.replace(".warc.gz", ".idx")).read_text().splitlines():
            offset, length, kind, name = line.split("\t")
            record = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            assert record.startswith(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n".encode()) and record.endswith(b"\r\n\r\n")


def test_small_payloads_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.archived(spark, df, str(tmp_path / "a"), least=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archived(spark, df.limit(0), str(tmp_path / "b")).count() == 0


def test_cut_archives_are_errors():
    import io

    data = gzip.compress(warc.record(1, "u", b"payload", None) + warc.record(2, "u", b"q", 1))
    assert [h["warc-type"] for h, _ in warc.split_records(warc.inflated(io.BytesIO(data)))] == ["response", "revisit"]
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflated(io.BytesIO(data[:-20]))))


# ---------------------------------------------------------------- repeats


def brute_repeats(texts, length, keep):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out, before = [], set()
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            window = b[i : i + length]
            if (window in before) if keep == "first" else seen[window] > 1:
                gone[i : i + length] = [True] * length
            before.add(window)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("group", [2048, 1])
def test_repeats_against_brute_force(spark, monkeypatch, keep, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdeé ") for _ in range(n))

    passage, other = noise(700), noise(420)
    texts = [noise(rng.randrange(300)) + passage[rng.randrange(250) :][: rng.randrange(390, 700)] + noise(rng.randrange(300)) for _ in range(40)]
    texts += [noise(50) + other + noise(20) + other, "ab" * 900, "ab" * 250 + noise(30), "x" * 399, "x" * 400, "x" * 401, "", None, noise(2000), passage]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], TEXTS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(df, keep=keep).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 400, keep)


def test_repeats_repeated_rows_and_chunks(spark, monkeypatch):
    text = "".join(random.Random(1).choice("abc ") for _ in range(900))
    df = spark.createDataFrame([(1, text, "", ""), (1, text, "", ""), (None, "z" * 10, "", "")], TEXTS)
    assert sorted((r.n_bytes, r.n_removed) for r in repeats.without_repeats(df, keep="none").collect()) == [(10, 0), (900, 900), (900, 900)]
    assert repeats.without_repeats(df.limit(0)).count() == 0
    whole = list(repeats.slices(text.encode(), 400, repeats.Powers()))
    monkeypatch.setattr(repeats, "CHUNK", 100)
    cut = list(repeats.slices(text.encode(), 400, repeats.Powers()))
    assert {(a, at + far) for a, _, at, _, far in whole} == {(a, at + far) for a, _, at, _, far in cut} and sum(m for *_, m, _ in cut) == 501
