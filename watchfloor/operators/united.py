"""How many different members the sets of a group have together, without listing them group by group.

Groups name parts, each part has a set of members, and a group has the members of all its parts. Members are dealt into buckets of
about ``PAIRS`` (part, member) pairs and numbered inside them; a part's set in a bucket is one row of packed numbers. The sets are a table
in the shared folder, (part, members) bucket by bucket. Groups are dealt by their name; a task takes them ``VISITS`` rows at a time and
reads the sets past each chunk, a bucket at a time, so counts of buckets are added up where they are made. Disk holds the
pairs once, the rows of groups once and the sets once, however many buckets a group visits and however many tasks read them.

A task holds the rows of a chunk and the sets of a bucket. Files of sets are opened inside tasks, so the shared folder must be one that
every executor reaches (local, HDFS or object store paths). Where no group keeps to a range of members, time grows with the members
that the parts of all groups have, as each group's members are gone through once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfloor.session import rewritten

cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])  # executors need no copy of the package

PAIRS = 4_000_000
VISITS = 1_000_000  # rows of groups that are held at once
LEAST = 20_000  # rows of groups that are worth a task
DENSE = 512  # a set with more than one member in so many of the stretch that it covers is made bits,
DENSE_BYTES = 64 << 20  # the densest first
WIDE = 1_024  # 64-bit words of a bucket, up to which groups are united many at once
BLOCK = 1 << 19  # words of such groups
FEW = 1_000  # groups with fewer members in a bucket are counted many at once
SORTED = 1 << 16  # members sorted at once
ROWS = 1_000  # rows of a batch that leaves a task
LOW = (1 << 32) - 1


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows that repeat inside a batch."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        yield from rows.group_by(rows.column_names).aggregate([]).select(rows.column_names).to_batches()


def numbered(held: list[pa.RecordBatch], ranked: bool = False) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The different values of two columns, by first appearance, and their distinct pairs: sorted numbers, the first column's above 32 bits.
    With ``ranked`` the second column's values are sorted, so that neighbours have neighbouring numbers."""
    left, right = (c.combine_chunks().dictionary_encode(null_encoding="encode") for c in pa.Table.from_batches(held).columns)
    values, number = right.dictionary, right.indices.to_numpy()
    if ranked:
        order = pc.sort_indices(values)
        rank = np.empty(len(values), np.int32)
        rank[order.to_numpy()] = np.arange(len(values), dtype=np.int32)
        values, number = values.take(order), rank[number]
    keys = left.indices.to_numpy().astype(np.int64) << 32
    keys |= number
    keys.sort()
    return left.dictionary, values, keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def packed(parts: pa.Array, keys: np.ndarray, bucket: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(part, bucket, members) of sorted distinct numbers: a part's above 32 bits, its member's below."""
    number, members = keys >> 32, (keys & LOW).astype(np.int32)
    edges = [*np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])).tolist(), len(number)]
    for at in range(0, len(edges) - 1, ROWS):
        some = edges[at : at + ROWS + 1]
        sets = [members[a:b].tobytes() for a, b in zip(some, some[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([parts.take(pa.array(number[some[:-1]])), pa.array([bucket] * len(sets), pa.int32()), pa.array(sets, pa.binary())], names)


def sets(pairs: DataFrame, part: str, member: str) -> DataFrame:
    """(part, bucket, members) of pairs without nulls, which may repeat: 32-bit numbers, sorted, that are dense in their bucket."""
    pairs = pairs.select(part, member)
    kind = pairs.schema[part].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, 2 * PAIRS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > most:  # one member can repeat without bound
                names, members, keys = numbered(held)
                held = [pa.RecordBatch.from_arrays([names.take(pa.array(keys >> 32)), members.take(pa.array(keys & LOW))], [part, member])]
                n = len(keys)
                most = n + 2 * PAIRS
        if not n:
            return
        names, _, keys = numbered(held, ranked=True)
        held.clear()
        yield from packed(names, keys, 0, [part, "bucket", "members"])

    buckets = max(1, -(-pairs.count() // PAIRS))
    spread = pairs.repartitionByRange(buckets, member)
    return rewritten(spread.mapInArrow(pack, f"`{part}` {kind}, bucket int, members binary"), "sets")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of each stretch, one stretch after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Bucket:
    """The sets of a bucket, numbers or bits, and counts of what some of them have together."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        self.parts, members = table.column(0).combine_chunks(), table.column(2).combine_chunks()
        self.edges = np.frombuffer(members.buffers()[1], np.int32, len(members) + 1, 4 * members.offset).astype(np.int64) // 4
        self.members = np.frombuffer(members.buffers()[2], np.int32, self.edges[-1])
        self.sizes = np.diff(self.edges)
        first, last = self.members[self.edges[:-1]], self.members[self.edges[1:] - 1]
        self.size = int(last.max()) + 1
        self.word, words = first >> 6, (last >> 6) - (first >> 6) + 1  # the stretch of 64-bit words that a set covers
        self.dense = self.sizes * DENSE > words * 64
        order = np.argsort(words / self.sizes)
        self.dense[order[np.cumsum(np.where(self.dense, words, 0)[order]) * 8 > DENSE_BYTES]] = False
        self.bits: dict = {}
        self.mixed = np.zeros((self.size + 63) // 64, np.uint64)
        self.stamps = np.zeros(self.size, np.int32)
        self.whole: np.ndarray | None = None
        self.narrow = len(self.mixed) <= WIDE and int(self.dense.sum()) * len(self.mixed) * 8 <= DENSE_BYTES

    def stretch(self, row: int) -> tuple[int, int, np.ndarray]:
        """Where a set begins and ends, in words, and its bits."""
        if row not in self.bits:
            members, low = self.members[self.edges[row] : self.edges[row + 1]], int(self.word[row])
            marks = np.zeros(((int(members[-1]) >> 6) - low + 1) * 64, bool)
            marks[members - low * 64] = True
            bits = np.packbits(marks, bitorder="little").view(np.uint64)
            self.bits[row] = low, low + len(bits), bits
        return self.bits[row]

    def together(self, dense: list[int], thin: list[int]) -> int:
        """Members of some sets; those named as dense are bits."""
        n, members = 0, None
        if thin:
            at = self.edges
            members = np.concatenate([self.members[at[r] : at[r + 1]] for r in thin])
        if dense:
            stretches = [self.stretch(r) for r in dense]
            low, high = min(s[0] for s in stretches), max(s[1] for s in stretches)
            for a, b, bits in stretches:
                some = self.mixed[a:b]
                np.bitwise_or(some, bits, out=some)
            n = int(np.bitwise_count(self.mixed[low:high]).sum())
            if members is not None:
                members = members[(self.mixed.view(np.uint8)[members >> 3] >> (members & 7).astype(np.uint8)) & 1 == 0]
            self.mixed[low:high] = 0
        if members is None or len(thin) == 1:
            return n + (0 if members is None else len(members))
        stamp = np.arange(len(members), dtype=np.int32)
        self.stamps[members] = stamp  # of members that repeat, one keeps its stamp
        return n + int(np.count_nonzero(self.stamps[members] == stamp))

    def many(self, rows: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Members of the groups numbered in ``wanted``, of those that begin at ``starts``, by sorting them group by group."""
        ends = np.append(starts[1:], len(rows))
        most = max(1, (1 << 32) // self.size)
        n = np.add.reduceat(self.sizes[rows], starts)[wanted]
        total, out, at = np.cumsum(n), np.zeros(len(wanted), np.int64), 0
        while at < len(wanted):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SORTED, "right")))
            some = wanted[at : min(end, at + most)]
            visits = ends[some] - starts[some]
            row = rows[spread(starts[some], visits)]
            sizes = self.sizes[row]
            members = self.members[spread(self.edges[row], sizes)].astype(np.uint32)
            members += np.repeat((np.repeat(np.arange(len(some)), visits) * self.size).astype(np.uint32), sizes)
            members.sort()
            members = members[np.concatenate([[True], members[1:] != members[:-1]])]
            out[at : at + len(some)] = np.bincount(members // np.uint32(self.size), minlength=len(some))
            at += len(some)
        return out

    def rows_of_bits(self) -> np.ndarray:
        """The sets made bits, as long as the bucket is wide."""
        if self.whole is None:
            dense, wide = np.flatnonzero(self.dense), len(self.mixed)
            self.whole = np.zeros(len(dense) * wide, np.uint64)
            members = self.members[spread(self.edges[dense], self.sizes[dense])]
            words = np.repeat(np.arange(len(dense)) * wide, self.sizes[dense]) + (members >> 6)
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            self.whole[words[first]] = np.bitwise_or.reduceat(np.uint64(1) << (members & 63).astype(np.uint64), first)
            self.whole = self.whole.reshape(len(dense), wide)
        return self.whole

    def blocks(self, rows: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Members of the groups numbered in ``wanted``, each of which has sets that are bits, many groups at once."""
        whole, place = self.rows_of_bits(), np.cumsum(self.dense) - 1
        ends, out = np.append(starts[1:], len(rows)), np.zeros(len(wanted), np.int64)
        is_bits = np.append(0, np.cumsum(self.dense[rows]))
        is_thin = np.append(0, np.cumsum(np.where(self.dense[rows], 0, self.sizes[rows])))
        n = is_bits[ends[wanted]] - is_bits[starts[wanted]]
        total = np.cumsum(len(self.mixed) + is_thin[ends[wanted]] - is_thin[starts[wanted]])
        at = 0
        while at < len(wanted):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")))
            order = at + np.argsort(-n[at:end], kind="stable")  # those with most sets first
            some, sets_of = wanted[order], n[order]
            visits = ends[some] - starts[some]
            row, group = rows[spread(starts[some], visits)], np.repeat(np.arange(len(some)), visits)
            bits = self.dense[row]
            thin, first, row = row[~bits], np.cumsum(sets_of) - sets_of, place[row[bits]]
            mixed = whole[row[first]]
            for k in range(1, int(sets_of[0])):
                more = int(np.searchsorted(-sets_of, -k, "left"))  # groups with more than k
                np.bitwise_or(mixed[:more], whole[row[first[:more] + k]], out=mixed[:more])
            found = np.bitwise_count(mixed).sum(axis=1, dtype=np.int64)
            if len(thin):
                sizes = self.sizes[thin]
                members = self.members[spread(self.edges[thin], sizes)].astype(np.int64)
                group = np.repeat(group[~bits], sizes)
                new = (mixed[group, members >> 6] >> (members & 63).astype(np.uint64)) & np.uint64(1) == 0
                keys = group[new] * self.size + members[new]
                keys.sort()
                if len(keys):
                    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
                    found += np.bincount(keys // self.size, minlength=len(some))
            out[order] = found
            at = end
        return out

    def counts(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Members of each group: its sets are the ``rows`` from its start to the next."""
        n = np.add.reduceat(self.sizes[rows], starts)
        visits = np.diff(np.append(starts, len(rows)))
        bits = np.logical_or.reduceat(self.dense[rows], starts)
        several = visits > 1
        few = np.flatnonzero(several & ~bits & (n < FEW))
        if len(few):
            n[few] = self.many(rows, starts, few)
        rest = several & (bits | (n >= FEW))
        rest[few] = False
        if self.narrow and (blocks := np.flatnonzero(rest & bits)).size:
            n[blocks] = self.blocks(rows, starts, blocks)
            rest[blocks] = False
        is_dense = self.dense
        for g in np.flatnonzero(rest).tolist():
            some = rows[starts[g] : starts[g] + visits[g]]
            which = is_dense[some]
            n[g] = self.together(some[which].tolist(), some[~which].tolist())
        return n


def buckets(files: list[str]) -> Iterator[Bucket]:
    """The buckets of a table that ``sets`` gave; the rows of a bucket are neighbours in one file."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            held: list = []
            for batch in pq.ParquetFile(file, buffer_size=1 << 20).iter_batches(batch_size=ROWS):
                places = batch.column(1).to_numpy()
                edges = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if held and held[-1].column(1)[0].as_py() != places[a]:
                        yield Bucket(held)
                        held = []
                    held.append(batch.slice(a, b - a))
            if held:
                yield Bucket(held)


def counts(groups: DataFrame, found: DataFrame, group: str, part: str, empty: bool = False) -> DataFrame:
    """(group, n): the number of members of each group of ``groups``, (group, part) rows that may repeat, whose parts have any;
    with ``empty`` also of those whose parts have none. ``found`` is what ``sets`` gave."""
    kind = groups.schema[group].dataType
    groups = groups.select(F.col(group).alias("group"), F.col(part).alias("part"))
    files = sorted(found.inputFiles())

    def counted(names: pa.Array, parts: pa.Array, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        name, number, n = keys >> 32, keys & LOW, np.zeros(len(names), np.int64)
        for bucket in buckets(files):
            rows = pc.fill_null(pc.index_in(parts, value_set=bucket.parts), -1).to_numpy()[number]
            here = np.flatnonzero(rows >= 0)
            if not len(here):
                continue
            some = name[here]
            starts = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            n[some[starts]] += bucket.counts(rows[here], starts)
        which = pa.array(np.arange(len(n)) if empty else np.flatnonzero(n))
        out = pa.RecordBatch.from_arrays([names.take(which), pa.array(n).take(which)], ["group", "n"])
        yield from (out.slice(at, ROWS) for at in range(0, out.num_rows, ROWS))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group."""
        held, n, most = [], 0, VISITS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n <= most:
                continue
            names, parts, keys = numbered(held)
            end = int(np.searchsorted(keys, (len(names) - 1) << 32))  # the last group may go on
            if end:
                yield from counted(names.slice(0, len(names) - 1), parts, keys[:end])
            left = keys[end:]
            held = [pa.RecordBatch.from_arrays([names.take(pa.array(left >> 32)), parts.take(pa.array(left & LOW))], ["group", "part"])]
            n = len(left)
            most = n + VISITS
        if n:
            yield from counted(*numbered(held))

    visits = groups.count()
    tasks = max(1, min(2 * groups.sparkSession.sparkContext.defaultParallelism, visits // LEAST), -(-visits // VISITS))
    dealt = groups.mapInArrow(once, groups.schema).repartition(tasks, "group").sortWithinPartitions("group")
    return dealt.mapInArrow(unite, f"`group` {kind.simpleString()}, n long").withColumnRenamed("group", group)
