"""Repeated passages by suffix order: every string of ``length`` bytes that starts at more than one place of the corpus.

A suffix array of all texts would not fit anywhere, so places that can match are brought together first. Of the 64-byte
strings inside a window of ``length`` bytes the one with the smallest hash (the rightmost of equals) is the window's
anchor. Equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so a text becomes a
few slices, runs of windows with one anchor. Slices whose anchor occurs once are done. Equal slices are counted; one of
each is kept. The different slices of an anchor are laid side by side and put in suffix order by prefix doubling up to
``length`` bytes. There, with common prefixes cut off at ``length``, the previous smaller position of a suffix lies in its own run
of equal ranks exactly if its longest previous factor reaches ``length``: it has an earlier copy. Read backwards, the same
test finds later copies.

``keep="first"`` removes later copies only; ``keep="none"`` removes every copy. A byte goes if a window that covers it goes.

Hot anchors: a passage that a third of all texts share has as many different slices as texts, where it begins and ends. An
anchor with more slices than a task should hold is split by content: windows are filed under ranges of their distance to the
anchor (quarters of the range above) and under all bytes that the windows of such a range have in common. The ranges get
smaller until one window is left, where equal means counted; so groups end up bounded, and equal windows still meet.

Defined results: null texts count as empty; texts shorter than ``length`` keep everything. Matches never cross texts. Repeated
rows are texts of their own, so each is a copy of the other (with ``keep="first"`` they share their decision, as nothing
tells them apart, and keep what the first occurrence keeps). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.llm.common import Powers, checkpointed, map_batches, partitions

LENGTH = 400
GRAM = 64
GROUP = 2048  # slices of one anchor that are put in order together
BUFFER = 1 << 21  # bytes put in suffix order at once
PLACES = np.uint64((1 << 20) - 1)
CHUNK = 1 << 19
ROWS_OUT = 8192

SLICES = "anchor long, slice long, doc_id long, doc long, at int, m int"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, in three passes over blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def slices(data: bytes, length: int, powers: Powers):
    """(anchor's hash, digest, first window, number of windows, distance of the first window to the anchor) of each slice."""
    for start in range(0, len(data) - length + 1, CHUNK):
        part = np.frombuffer(data[start : start + CHUNK + length - 1], np.uint8)
        sums = powers.sums(part)
        places = np.arange(len(part) - GRAM + 1)
        hashes = powers.between(sums, places, places + GRAM)
        marked = (hashes & ~PLACES) | (PLACES - places.astype(np.uint64))
        chosen = (PLACES - (sliding_least(marked, length - GRAM + 1) & PLACES)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        count = np.diff(np.concatenate([first, [len(chosen)]]))
        for i, m, p in zip(first.tolist(), count.tolist(), chosen[first].tolist(), strict=True):
            piece = data[start + i : start + i + m + length - 1]
            digest = hashlib.blake2b(piece, digest_size=8, salt=(p - i).to_bytes(4, "little")).digest()
            yield int(hashes[p].view(np.int64)), int.from_bytes(digest, "little", signed=True), start + i, m, p - i


def sliced(docs: DataFrame, length: int) -> DataFrame:
    """The slices of every (doc_id, doc, data), with the distance to their anchor."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            rows = []
            for doc_id, doc, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc", "data")), strict=True):
                for anchor, digest, at, m, far in slices(data, length, powers):
                    rows.append((anchor, digest, doc_id, doc, at, m, far))
                    if len(rows) == ROWS_OUT:
                        yield record(rows)
                        rows = []
            yield record(rows)

    kinds = [*[pa.int64()] * 4, *[pa.int32()] * 3]
    names = ["anchor", "slice", "doc_id", "doc", "at", "m", "far"]

    def record(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names)

    return map_batches(docs, run, SLICES + ", far int")


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each place (equal strings, equal ranks), by prefix doubling from eight bytes on."""
    n = len(data)
    word = np.zeros(n - 7, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | data[k : n - 7 + k]
    rank, known = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while known < length:
        step = min(known, length - known)
        pair = rank[: len(rank) - step] * np.int64(n) + rank[step:]
        rank, known = np.unique(pair, return_inverse=True)[1].astype(np.int64), known + step
    return rank


def copied(pieces: list[bytes], windows: list[int], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each piece, whether its windows have an earlier copy and whether they have a later one, earlier meaning in an
    earlier piece or further ahead in the same."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    ranks = suffix_ranks(data, length)
    places = np.concatenate([np.arange(o, o + m) for o, m in zip(offsets[:-1], windows, strict=True)])
    order = np.argsort(ranks[places], kind="stable")  # the suffix array of the windows; equal ones by position
    run = np.diff(ranks[places][order]) == 0  # the common prefix with the suffix before reaches the length
    earlier, later = np.zeros(len(places), bool), np.zeros(len(places), bool)
    earlier[order[1:]], later[order[:-1]] = run, run
    cuts = np.cumsum(windows)[:-1]
    return np.split(earlier, cuts), np.split(later, cuts)


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True))


def ordered(groups: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(anchor, slice, start, windows): runs of copied windows of bounded groups of different slices (key, anchor, slice,
    doc_id, at, off, m, piece). Several groups share a suffix array; different groups have no window in common."""
    names = ["anchor", "slice", "start", "windows"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def settle(rows):
        rows = list({r[1:3] + r[5:6]: r for r in rows}.values())  # repeated rows bring the same slice
        rows.sort(key=lambda r: (r[3] is None, r[3], r[4], r[5]))
        earlier, later = copied([r[7] for r in rows], [r[6] for r in rows], length)
        out = []
        for (_, anchor, piece, _, _, off, _, _), before, after in zip(rows, earlier, later, strict=True):
            flags = before if keep_first else before | after
            if flags.any():
                out += [(anchor, piece, off + s, n) for s, n in runs_of(flags)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names)

    def run(batches):
        rows, size, key = [], 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "anchor", "slice", "doc_id", "at", "off", "m", "piece"))
            for row in zip(*columns, strict=True):
                if size >= BUFFER and row[0] != key:
                    yield settle(rows)
                    rows, size = [], 0
                key = row[0]
                rows.append(row)
                size += len(row[7])
        if rows:
            yield settle(rows)

    dealt = groups.repartition(partitions(groups.sparkSession), "key").sortWithinPartitions("key")
    return map_batches(dealt, run, "anchor long, slice long, start int, windows int")


def narrower(hot: DataFrame, width: int, length: int) -> DataFrame:
    """The slices of hot groups cut by ranges of ``width`` distances to the anchor. The new key stands for the anchor, the
    range and all bytes that windows of the range have in common."""

    def run(batches):
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("anchor", "slice", "doc_id", "at", "off", "m", "far", "piece"))
            for anchor, piece_id, doc_id, at, off, m, far, piece in zip(*columns, strict=True):
                # window w of the piece lies far - w before the anchor
                for r in range((far - m + 1) // width, far // width + 1):
                    low, high = r * width, r * width + width - 1
                    first, last = max(0, far - high), min(m - 1, far - low)
                    shared = piece[far - low : far - high + length] if far >= low else piece[: far - high + length]
                    cut = piece[first : last + length]
                    key = hashlib.blake2b(shared, digest_size=8, salt=(r * 1024 + width).to_bytes(8, "little"), key=anchor.to_bytes(8, "little", signed=True)).digest()
                    own = hashlib.blake2b(cut, digest_size=8, salt=(far - first).to_bytes(4, "little")).digest()
                    out.append((int.from_bytes(key, "little", signed=True), int.from_bytes(own, "little", signed=True), anchor, piece_id, doc_id, at, off + first, last - first + 1, far - first, cut))
            kinds = [*[pa.int64()] * 5, *[pa.int32()] * 4, pa.binary()]
            names = ["key", "own", "anchor", "slice", "doc_id", "at", "off", "m", "far", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 10, kinds, strict=True)], names)

    return map_batches(hot, run, "key long, own long, anchor long, slice long, doc_id long, at int, off int, m int, far int, piece binary")


def first_place(*more: str) -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "at", *more))


def copied_runs(pieces: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(anchor, slice, start, windows) of the different slices (key, anchor, slice, doc_id, at, off, m, far, piece), k to a key."""
    small = pieces.filter(F.col("k") <= GROUP)
    found = checkpointed(ordered(small, length, keep_first))
    hot = checkpointed(pieces.filter(F.col("k") > GROUP).drop("k"))
    width = 128
    while not hot.isEmpty():
        cut = checkpointed(narrower(hot, width, length))
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at", "off", "anchor", "slice")
        classes = cut.groupBy("key", "own").agg(F.count("*").alias("n"), F.min(order).alias("first"))
        joined = cut.withColumnRenamed("key", "cut_key").withColumnRenamed("own", "cut_own").join(classes, (F.col("cut_key") == F.col("key")) & (F.col("cut_own") == F.col("own")))
        is_first = F.col("first") == order
        copies = joined.filter(~is_first if keep_first else F.col("n") > 1).select("anchor", "slice", F.col("off").alias("start"), F.col("m").alias("windows"))
        rest = joined.filter(is_first)
        counts = classes.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").withColumnRenamed("key", "many")
        rest = checkpointed(rest.join(counts, F.col("key") == F.col("many")).select("key", "anchor", "slice", "doc_id", "at", "off", "m", "far", "piece", "k"))
        found = checkpointed(found.union(copies).union(ordered(rest.filter(F.col("k") <= GROUP), length, keep_first)))
        hot = checkpointed(rest.filter(F.col("k") > GROUP).drop("k"))
        width = max(1, width // 4)
    return found


def copied_windows(docs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(doc_id, doc, at, windows): runs of windows that go."""
    every = checkpointed(sliced(docs, length))
    # Counts are written before they are joined: a join whose sides are shuffled for it alone can be split at a hot anchor.
    shared = checkpointed(every.groupBy("anchor").count().filter(F.col("count") > 1).select(F.col("anchor").alias("seen")))
    every = checkpointed(every.join(shared, F.col("anchor") == F.col("seen"), "left_semi"))
    classes = checkpointed(every.groupBy("anchor", "slice").agg(F.count("*").alias("n"), first_place("m", "far").alias("first")))
    copies = classes.filter("n > 1").select(F.col("anchor").alias("x"), F.col("slice").alias("y"), "first")
    whole = every.join(copies, (F.col("anchor") == F.col("x")) & (F.col("slice") == F.col("y")))
    if keep_first:
        same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("doc") == F.col("first.doc")) & (F.col("at") == F.col("first.at"))
        whole = whole.filter(~same)
    whole = whole.select("doc_id", "doc", "at", F.col("m").alias("windows"))
    many = checkpointed(classes.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").withColumnRenamed("anchor", "many"))
    reps = classes.join(many, F.col("anchor") == F.col("many")).select("anchor", "slice", "k", "n", "first.*")
    place = (F.col("doc") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    source = docs.select(F.col("doc_id").alias("of_id"), F.col("doc").alias("of"), "data")
    piece = F.expr(f"substring(data, at + 1, m + {length - 1})")
    pieces = source.join(reps, place).select(F.col("anchor").alias("key"), "anchor", "slice", "doc_id", "at", F.lit(0).alias("off"), "m", "far", piece.alias("piece"), "k")
    pieces = checkpointed(pieces)
    runs = copied_runs(pieces, length, keep_first)
    places = classes.select(F.col("anchor").alias("x"), F.col("slice").alias("y"), "first.doc_id", "first.doc", "first.at")
    single = runs.join(places, (F.col("anchor") == F.col("x")) & (F.col("slice") == F.col("y"))).select("doc_id", "doc", (F.col("at") + F.col("start")).alias("at"), "windows")
    return whole.union(single)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "first") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes), kept_sha256, spans (start and end of each removed run)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.col("text").cast("binary").alias("data"))
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    windows = copied_windows(rows, length, keep == "first")
    merged = windows.groupBy("doc", "doc_id").agg(F.collect_set(F.struct("at", "windows")).alias("gone"))
    merged = merged.select(F.col("doc").alias("of"), F.col("doc_id").alias("of_id"), F.col("gone.at").alias("at"), F.col("gone.windows").alias("windows"))
    joined = rows.join(merged, (F.col("doc") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left").select("doc_id", "data", "at", "windows")

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, data, at, count in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "at", "windows")), strict=True):
                spans, kept = [], data
                if at:
                    steps = np.zeros(len(data) + 1, np.int32)
                    np.add.at(steps, np.array(at), 1)
                    np.add.at(steps, np.array(at) + np.array(count) + length - 1, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    spans = [(s, s + n) for s, n in runs_of(gone)]
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc_id, len(data), len(data) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s]))
            kinds = [*[pa.int64()] * 4, pa.binary(), pa.string(), pa.list_(pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names)

    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<long>")
