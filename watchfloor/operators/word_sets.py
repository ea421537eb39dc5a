"""Which texts have which keywords, as sets of texts per keyword (see ``united``), made where the texts are read.

Links say which words give a keyword away: a keyword is found in a text that has as many of its words as it wants, or has words that contain
them. Containing words are looked for among the distinct words of a chunk: keywords of up to ``RUN`` bytes are equal to a run of a word,
longer ones are filed under their rarest run and compared where it occurs. Links are a table in the shared folder, read past every chunk of about ``WORDS`` words of texts, so texts, their words and what was found in them are
never shuffled, however many links there are. Texts of a task are numbered as they come and go into buckets of about ``united.PAIRS``
hits. A task holds a chunk, the links of ``LINKS`` rows and the hits of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from watchfloor.operators import united
from watchfloor.session import rewritten

cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])  # executors need no copy of the package

WORDS = 2_000_000  # words of texts in a chunk
TEXTS = 1_000  # texts that a chunk takes at once
TEXT_BYTES = 64 << 20  # characters of texts in a chunk, where they are looked at again
LINKS = 500_000  # links that are held at once
RUN = 8  # bytes
SLICE = 1 << 20  # runs that are looked at, and compared, at once
HITS = 2_000_000  # hits that are sorted at once
TASKS = 2  # tasks that read texts, for each that can run at once: few, as each ends with a bucket of its own


def links_of(files: list[str]) -> Iterator[pa.RecordBatch]:
    """Links in pieces; those of a keyword that wants several words stay together."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            held = None
            for batch in pq.ParquetFile(file, buffer_size=1 << 20).iter_batches(batch_size=LINKS):
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                last, end = batch.num_rows - 1, batch.num_rows
                if batch.column("wanted")[last].as_py() > 1:
                    end = pc.index(batch.column("keyword"), batch.column("keyword")[last]).as_py()
                if end:
                    yield batch.slice(0, end)
                held = batch.slice(end) if end <= last else None
            if held is not None:
                yield held


def runs_at(data: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Runs of up to eight bytes as numbers."""
    out = np.zeros(len(places), np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[places + k]
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, with the end of the last, and their bytes."""
    edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    return edges, np.frombuffer(texts.buffers()[2] or b"", np.uint8, edges[-1])


def slots(runs: np.ndarray, bits: int) -> np.ndarray:
    return (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def meeting(data: np.ndarray, edges: np.ndarray, sought: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the texts that are among the sought numbers, sorted, where they begin, and their texts. A few others slip in."""
    bits = min(24, max(12, len(sought).bit_length() + 4))
    marks = np.zeros(1 << bits, bool)
    marks[slots(sought, bits)] = True
    runs, places = [], []
    for at in range(int(edges[0]), len(data) - size + 1, SLICE):
        some = data[at : at + SLICE + size - 1]
        number = np.zeros(len(some) - size + 1, np.uint64)
        for k in range(size):
            number <<= np.uint64(8)
            number |= some[k : k + len(number)]
        here = np.flatnonzero(marks[slots(number, bits)])
        runs.append(number[here])
        places.append(here + at)
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs, places = np.concatenate(runs), np.concatenate(places)
    owner = np.searchsorted(edges, places, "right") - 1
    good = np.flatnonzero(places + size <= edges[owner + 1])
    good = good[np.argsort(runs[good], kind="stable")]
    return runs[good], places[good], owner[good]


def containing(words: pa.Array, parts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words and of the parts that they contain, distinct pairs."""
    edges, data = bytes_of(words)
    begins, letters = bytes_of(parts)
    lengths, begins = np.diff(begins), begins[:-1]
    for size in range(1, RUN + 1):
        which = np.flatnonzero(np.minimum(lengths, RUN) == size)
        if not len(which):
            continue
        n = lengths[which] - size + 1
        part, place = np.repeat(which, n), united.spread(begins[which], n)
        sought = runs_at(letters, place, size)
        runs, places, owner = meeting(data, edges, np.unique(sought), size)
        first = np.searchsorted(runs, sought, "left")
        met = np.searchsorted(runs, sought, "right") - first
        starts = np.cumsum(n) - n
        rarest = np.flatnonzero(met == np.repeat(np.minimum.reduceat(met, starts), n))
        rarest = rarest[np.concatenate([[True], part[rarest][1:] != part[rarest][:-1]])]
        rarest = rarest[met[rarest] > 0]
        total, at = np.cumsum(met[rarest]), 0
        while at < len(rarest):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
            some = rarest[at:end]
            where = united.spread(first[some], met[some])
            word, number = owner[where], np.repeat(part[some], met[some])
            begin = places[where] - np.repeat(place[some] - begins[part[some]], met[some])
            length = lengths[number]
            if size == RUN:
                inside = np.flatnonzero((begin >= edges[word]) & (begin + length <= edges[word + 1]))
                word, number, begin, length = word[inside], number[inside], begin[inside], length[inside]
                if len(inside):
                    same = np.logical_and.reduceat(data[united.spread(begin, length)] == letters[united.spread(begins[number], length)], np.cumsum(length) - length)
                    word, number = word[same], number[same]
            pairs = np.unique(number << 32 | word)  # a part may be in a word twice
            yield pairs & united.LOW, pairs >> 32
            at = end


class Chunk:
    """Words of texts that were read one after another."""

    def __init__(self):
        self.words: list = []
        self.rows: list = []
        self.texts: list = []
        self.n = self.size = self.bytes = 0

    def add(self, lists: pa.Array, texts: pa.Array | None) -> None:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        words = lists.flatten().dictionary_encode()
        self.words.append(words)
        self.rows.append(np.repeat(np.arange(self.n, self.n + len(sizes), dtype=np.int32), sizes))
        self.n += len(sizes)
        self.size += len(words)
        if texts is not None:
            self.texts.append(texts)
            self.bytes += texts.nbytes

    def hits(self, files: list[str], inside: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Keywords, and sorted numbers of those found: the keyword's above 32 bits, the text's below."""
        if not self.size:
            return
        words = pa.chunked_array(self.words).unify_dictionaries().combine_chunks()
        words = words if isinstance(words, pa.Array) else words.chunk(0)
        vocabulary, word, row = words.dictionary, words.indices.to_numpy(), np.concatenate(self.rows)
        texts = pa.chunked_array(self.texts) if self.texts else None
        for links in links_of(files):
            if inside:
                met = list(containing(vocabulary, links.column("word")))
                at, which = (np.concatenate([m[k] for m in met]) if met else np.zeros(0, np.int64) for k in (0, 1))
                links = links.take(pa.array(which))
            else:
                at = pc.index_in(links.column("word"), value_set=vocabulary)
                links, at = links.filter(at.is_valid()), at.drop_null().to_numpy()
            if not len(at):
                continue
            keyword = links.column("keyword").dictionary_encode()
            number, names = keyword.indices.to_numpy(), keyword.dictionary
            wanted, spaced = np.ones(len(names), np.int64), np.zeros(len(names), bool)
            wanted[number], spaced[number] = links.column("wanted").to_numpy(), links.column("spaced").to_numpy(zero_copy_only=False)
            number = number[np.argsort(at, kind="stable")].astype(np.int64) << 32
            size = np.bincount(at, minlength=len(vocabulary))
            first = np.cumsum(size) - size
            here = np.flatnonzero(size[word])
            total, start = np.cumsum(size[word[here]]), 0
            while start < len(here):
                end = int(np.searchsorted(total, (total[start - 1] if start else 0) + HITS, "right"))
                end = max(end, start + 1)
                end = int(np.searchsorted(row[here], row[here[end - 1]], "right"))  # a text's words stay together
                some = here[start:end]
                sizes = size[word[some]]
                keys = number[np.repeat(first[word[some]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                keys |= np.repeat(row[some], sizes)
                keys.sort()
                edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                met, keys = np.diff(np.append(edges, len(keys))), keys[edges]
                keys = keys[met >= wanted[keys >> 32]]
                look = spaced[keys >> 32]
                if look.any():
                    good = ~look
                    for k in np.flatnonzero(look).tolist():
                        good[k] = names[int(keys[k] >> 32)].as_py() in texts[int(keys[k] & united.LOW)].as_py()
                    keys = keys[good]
                if len(keys):
                    yield names, keys
                start = end


def hit_sets(rows: DataFrame, links: DataFrame, inside: bool = False) -> DataFrame:
    """(keyword, bucket, members): sets of the texts that have a keyword, as ``united.counts`` takes them.

    ``rows`` is (words: its distinct words, text), ``links`` distinct (keyword, word, wanted, spaced): a keyword is found in a text that has
    ``wanted`` of its words and, if ``spaced``, has it as it is. With ``inside`` one word of the text that contains its word is enough. A column ``text`` is only needed where some are spaced."""
    links = rewritten(links.repartition("keyword").sortWithinPartitions("keyword"), "links")
    files = sorted(links.inputFiles())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, found, members, base, bucket = Chunk(), [], [], 0, 0

        def searched():
            nonlocal chunk, base
            for names, keys in chunk.hits(files, inside):
                used, number = np.unique(keys >> 32, return_inverse=True)
                found.append(pa.DictionaryArray.from_arrays(pa.array(number.astype(np.int32)), names.take(pa.array(used))))
                members.append(((keys & united.LOW) + base).astype(np.int32))
            base += chunk.n
            chunk = Chunk()

        def filed():
            nonlocal base, bucket
            if found:
                keyword = pa.chunked_array(found).unify_dictionaries().combine_chunks()
                keyword = keyword if isinstance(keyword, pa.Array) else keyword.chunk(0)
                keys = keyword.indices.to_numpy().astype(np.int64) << 32
                keys |= np.concatenate(members)
                found.clear()
                members.clear()
                keys.sort()
                keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
                yield from united.packed(keyword.dictionary, keys, bucket, ["keyword", "bucket", "members"])
            base, bucket = 0, bucket + 1

        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            chunk.add(batch.column(0), batch.column(1) if batch.num_columns > 1 else None)
            if chunk.size >= WORDS or chunk.bytes >= TEXT_BYTES or chunk.n >= 1 << 24:
                searched()
                if sum(map(len, members)) >= united.PAIRS or base >= 1 << 30:
                    yield from filed()
        searched()
        yield from filed()

    tasks = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    return rewritten(rows.coalesce(tasks).mapInArrow(find, "keyword string, bucket int, members binary"), "sets")
