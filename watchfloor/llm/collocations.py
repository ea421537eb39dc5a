"""Phrases whose words occur together far more often than apart, by prefix-free parsing.

Texts are cut into pieces at sentence marks and line ends. A piece is parsed into chunks: wherever the hash of the next
``width - 1`` words is divisible by ``CHUNK_WORDS``, a chunk begins, and the chunk before it reaches over those words. The
triggers depend on content only, so what is repeated is parsed alike wherever it stands, and chunks make a dictionary with
their frequencies. A phrase of up to ``width`` words begins in exactly one chunk's own part (what comes before the overlap) and
lies in that chunk as a whole, so counting phrases in the distinct chunks, weighted, counts every occurrence once.

Phrases are counted level by level. A phrase can only be frequent if the two phrases that it consists of without its last and
without its first word are. Frequent phrases set a bit in a table of fixed size, which is sent to all tasks of the next level:
equal bits let more phrases through, never fewer. Phrases are told apart by two independent hashes of 64 and 32 bits (for a
million million different phrases the chance that any two agree is below one in a hundred thousand), counted inside tasks
first, and then range by range. The text of a frequent phrase is read from a chunk that holds it. What crosses the
network: chunks once, hashes of the phrases that the level below lets through, chunks that hold a frequent phrase's text.

Defined results: null and empty texts have no words; a null language is ``und``. Words are never split, and longer than a
chunk may be. Ties are ordered as stated at ``phrases``. Repeated rows count each. An empty table, or one without frequent
phrases, gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchfloor.llm.common import MIX_1, MIX_2, Powers, finish, map_batches, partitions, stored

CHUNK_WORDS = 16  # a chunk has about so many words
CHUNKS_HELD = 200_000  # distinct chunks that a task adds up before it hands them on
PHRASES_HELD = 1_500_000  # phrases that a task holds; adding them up takes some 50 bytes for each
CHUNKS_AT_ONCE = 4096
BUFFER_BYTES = 1 << 19
HANDED_BYTES = 4 << 20  # of phrases, handed on together
RANGES = 8  # ranges of hashes for each shuffle partition; one is added up in memory at a time
TABLE_BITS = 26
SLICE_BITS = 14  # bits of the table that are set together
SECOND_BASE = 0xD6E8FEB86659FD93  # a fixed odd number: the base of the second hash
SPREAD = 64  # tasks among which a language's candidates are ranked first

# What becomes what before texts are split: capitals of ASCII, marks that end a piece, the two kinds of blank.
LETTERS = bytes(range(65, 91))
CLEAN = bytes.maketrans(LETTERS + b".,;:!?\x0b\x0c\r\t", LETTERS.lower() + b"\n" * 9 + b" ")


def words_of(data: bytes, *powers: Powers) -> tuple[np.ndarray, ...]:
    """Start, end, line and hashes of each word of ``data``, whose words stand between blanks and line feeds."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = (codes != 32) & (codes != 10)
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    before = np.searchsorted(start, np.flatnonzero(codes == 10))
    line = np.repeat(np.arange(len(before) + 1), np.diff(np.concatenate([[0], before, [len(start)]])))
    return start, end, line, *[p.between(p.sums(codes), start, end) for p in powers]


def joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word and that of its last word."""
    return finish(first * np.uint64(MIX_2) + last * np.uint64(MIX_1) + np.uint64(1))


class Counts:
    """Phrases by their two hashes: how often they occur, and a place where one stands."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def add(self, *columns: np.ndarray) -> None:
        """What COUNTED names, one value for each place."""
        if len(columns[0]):
            self.parts.append(once(list(columns)))

    def settled(self) -> tuple[np.ndarray, ...]:
        """All that was counted, each phrase once; nothing is left."""
        parts, self.parts = self.parts, []
        if not parts:
            return tuple(np.zeros(0, f.type.to_pandas_dtype()) for f in COUNTED)
        if len(parts) == 1:
            return parts[0]
        columns = [list(c) for c in zip(*parts, strict=True)]
        parts.clear()
        for i, column in enumerate(columns):
            columns[i] = np.concatenate(column)
            column.clear()
        return once(columns)


def once(columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Each phrase once, in order. Columns are replaced in ``columns`` one by one, so that none is held twice for longer than
    it takes to make it."""

    def taken(places):
        for i, column in enumerate(columns):
            columns[i] = column[places]

    taken(np.argsort(columns[0]))
    differs = columns[0][1:] != columns[0][:-1]
    if np.any(~differs & (columns[1][1:] != columns[1][:-1])):
        taken(np.lexsort((columns[1], columns[0])))
    differs |= columns[1][1:] != columns[1][:-1]
    edge = np.flatnonzero(np.concatenate([[True], differs]))
    total = np.add.reduceat(columns.pop(2), edge)
    taken(edge)
    columns.insert(2, total)
    return tuple(columns)


COUNTED = pa.schema([("first", pa.int64()), ("second", pa.int32()), ("n", pa.int64()), ("chunk", pa.int64()), ("at", pa.int32())])


def chunks_of(data: bytes, overlap: int, powers: Powers) -> tuple[list[bytes], int]:
    """The chunks of cleaned text and the number of its words. A chunk that ends in a blank shares its last ``overlap`` words with the next."""
    data = re.sub(rb" {2,}", b" ", data)
    start, end, line, hashes = words_of(data, powers)
    if not len(start):
        return [], 0
    trigger = hashes
    for k in range(1, overlap):
        trigger = joined(trigger[:-1], hashes[k:])
    n = len(trigger)
    begins = np.concatenate([[True], line[1:] != line[:-1]])
    begins[:n] |= (trigger % np.uint64(CHUNK_WORDS) == 0) & (line[:n] == line[overlap - 1 :])
    first = np.flatnonzero(begins)
    after = np.append(first[1:], len(start))
    shared = np.append(line[first[1:]] == line[first[1:] - 1], False)
    last = np.where(shared, after + overlap - 1, after - 1)
    chunks = [data[a:b] + b" " if more else data[a:b] for a, b, more in zip(start[first].tolist(), end[last].tolist(), shared.tolist(), strict=True)]
    return chunks, len(start)


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", width: int = 4) -> DataFrame:
    """id, lang, chunk, n: the distinct chunks of each language and how often the parse has them; a language's empty chunk has
    the number of its words."""

    def run(batches):
        powers, counts, totals = Powers(), defaultdict(Counter), Counter()
        schema = pa.schema([("lang", pa.string()), ("chunk", pa.binary()), ("n", pa.int64())])

        def made():
            for lang, found in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(found.values(), pa.int64())], schema=schema)

        def parsed(lang, parts):
            chunks, words = chunks_of(b"\n".join(parts), width - 1, powers)
            counts[lang].update(chunks)
            totals[lang] += words

        for batch in batches:
            waiting = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                waiting[lang].append(text.encode().translate(CLEAN))
                if sum(map(len, waiting[lang])) > BUFFER_BYTES:
                    parsed(lang, waiting.pop(lang))
            for lang, parts in waiting.items():
                parsed(lang, parts)
            if sum(map(len, counts.values())) > CHUNKS_HELD:
                yield from made()
                counts.clear()
        yield from made()
        counts.clear()
        for lang, n in totals.items():
            counts[lang][b""] = n
        yield from made()

    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = map_batches(rows, run, "lang string, chunk binary, n long")
    found = found.groupBy("lang", "chunk").agg(F.sum("n").alias("n"))
    return stored(found.select(F.monotonically_increasing_id().alias("id"), "lang", "chunk", "n"), "chunks")


class Grams:
    """The words of a batch of chunks, and for each length the phrases that begin at a word in the chunk's own part."""

    def __init__(self, batch, overlap: int, powers: tuple[Powers, Powers]):
        nothing, feed = (pa.scalar(b, pa.large_binary()) for b in (b"", b"\n"))
        lines = pc.binary_join_element_wise(batch.column("chunk").cast(pa.large_binary()), nothing, feed)
        ends = np.frombuffer(lines.buffers()[1], np.int64)[1 : len(lines) + 1] if len(lines) else np.zeros(0, np.int64)
        data = lines.buffers()[2] if len(lines) else b""
        langs, self.powers, self.codes = batch.column("lang").dictionary_encode(), powers, np.frombuffer(data, np.uint8)
        self.start, self.end, line, hashes = words_of(data, powers[0])
        number = langs.indices.to_numpy()[line]
        # Not symmetric: the word "en" of the language "de" is no word "de" of the language "en".
        self.salts = [np.array([hash_of(lang, p) for lang in langs.dictionary.to_pylist()], np.uint64) for p in powers]
        self.number, self.hashes = number, [joined(self.salts[0][number], hashes)]
        self.n, size = batch.column("n").to_numpy()[line], np.bincount(line, minlength=len(lines))
        own = size - overlap * (self.codes[ends - 2] == 32)
        place = np.arange(len(line)) - (np.cumsum(size) - size)[line]
        self.left, self.own = size[line] - place, place < own[line]
        self.chunk, self.place = batch.column("id").to_numpy()[line], place.astype(np.int32)

    def phrase_hashes(self, words: int) -> np.ndarray:
        """Hash of the phrase of so many words from each word that has them; others' values mean nothing."""
        known = self.hashes
        while len(known) < words:
            k, last = len(known), known[-1]
            n, longer = max(0, len(last) - k), np.zeros_like(last)
            longer[:n] = joined(last[:n], known[0][k : k + n])
            known.append(longer)
        return known[words - 1]

    def second_hashes(self, words: int, at: np.ndarray) -> np.ndarray:
        """The second hash of the phrases of so many words from the words ``at``."""
        salt, sums = self.salts[1][self.number[at]], self.powers[1].sums(self.codes)
        each = (joined(salt, self.powers[1].between(sums, self.start[at + k], self.end[at + k])) for k in range(words))
        return (reduce(joined, each) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def possible(self, words: int, table: np.ndarray | None) -> np.ndarray:
        """Words of the chunks' own parts at which a phrase of so many words begins that may be frequent: ``table``, of one
        word less, lets both its parts through."""
        ok = self.own & (self.left >= words)
        if table is not None:
            bits = self.phrase_hashes(words - 1) & np.uint64((1 << TABLE_BITS) - 1)
            frequent = (table[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1
            ok &= frequent
            ok[:-1] &= frequent[1:]
        return np.flatnonzero(ok)


def hash_of(text: str, powers: Powers) -> np.uint64:
    codes = np.frombuffer(text.encode(), np.uint8)
    return powers.between(powers.sums(codes), np.array([0]), np.array([len(codes)]))[0]


def many_rows(rows: DataFrame, run, schema: str, at_once: int = 16_384) -> DataFrame:
    """``mapInArrow`` over rows that are short."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(at_once))
    return rows.mapInArrow(run, schema)


def handed_on(columns: tuple[np.ndarray, ...], starts: np.ndarray):
    """Counted phrases in their order, a row for each range that has some; rows are put together up to HANDED_BYTES."""
    edges = [0, *np.searchsorted(columns[0], starts).tolist(), len(columns[0])]
    rows, size = [], 0
    for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
        if i < j:
            rows.append((k, b"".join(c[i:j].tobytes() for c in columns)))
            size += len(rows[-1][1])
        if size >= HANDED_BYTES or rows and k == len(starts):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["range", "phrases"])
            rows, size = [], 0


def frequent(chunks: DataFrame, words: int, below: bytes | None, least: int, overlap: int) -> DataFrame:
    """first, second, n of every phrase of so many words that occurs ``least`` times or more, and a chunk and the word in it at
    which one begins. ``below``: the table of one word less."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(below)
    # Ranges of the first hash; a task hands on what it has of a range as one row.
    ranges = RANGES * partitions(spark)
    starts = np.array([k * (1 << 64) // ranges - (1 << 63) for k in range(1, ranges)], np.int64)

    def count(batches):
        powers, table, counts = (Powers(), Powers(SECOND_BASE)), None if sent.value is None else np.frombuffer(sent.value, np.uint8), Counts()
        for batch in batches:
            grams = Grams(batch, overlap, powers)
            at = grams.possible(words, table)
            counts.add(grams.phrase_hashes(words)[at].view(np.int64), grams.second_hashes(words, at), grams.n[at], grams.chunk[at], grams.place[at])
            del grams, at
            if len(counts) > PHRASES_HELD:
                columns = counts.settled()
                if len(columns[0]) > PHRASES_HELD // 2:
                    yield from handed_on(columns, starts)
                else:
                    counts.parts.append(columns)
                del columns
        yield from handed_on(counts.settled(), starts)

    def add(batches):
        counts, now = Counts(), None

        def enough():
            columns = counts.settled()
            return pa.RecordBatch.from_arrays([pa.array(c[columns[2] >= least]) for c in columns], schema=COUNTED)

        for batch in batches:
            for number, data in zip(batch.column("range").to_pylist(), batch.column("phrases"), strict=True):
                if number != now and now is not None:
                    yield enough()
                now, raw = number, data.as_buffer()
                n, upto = raw.size // sum(f.type.bit_width // 8 for f in COUNTED), 0
                columns = []
                for f in COUNTED:
                    columns.append(np.frombuffer(raw, f.type.to_pandas_dtype(), n, upto))
                    upto += n * f.type.bit_width // 8
                counts.parts.append(tuple(columns))
        yield enough()

    rows = many_rows(chunks.filter("chunk <> CAST('' AS BINARY)"), count, "range int, phrases binary", CHUNKS_AT_ONCE)
    rows = rows.repartition(partitions(spark), "range").sortWithinPartitions("range")
    return stored(rows.mapInArrow(add, "first long, second int, n long, chunk long, at int"), "frequent")


def table_of(found: DataFrame) -> bytes:
    """A table of TABLE_BITS bits in which every phrase of ``found`` has set one; its size is fixed."""

    def bits(batches):
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column("first").to_numpy().view(np.uint64) & np.uint64((1 << TABLE_BITS) - 1)
            number = (bit >> np.uint64(SLICE_BITS)).astype(np.int64)
            inside = (bit & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64)
            order = np.argsort(number, kind="stable")
            for k, mine in zip(*grouped(number[order], inside[order]), strict=True):
                np.bitwise_or.at(slices.setdefault(k, np.zeros(1 << SLICE_BITS - 3, np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([s.tobytes() for s in slices.values()], pa.binary())], ["slice", "bits"])

    part = F.shiftright(F.col("first").bitwiseAND(F.lit((1 << TABLE_BITS) - 1)), SLICE_BITS)
    rows = found.select("first").repartition(partitions(found.sparkSession), part)
    table = np.zeros((1 << TABLE_BITS - SLICE_BITS, 1 << SLICE_BITS - 3), np.uint8)
    for batch in many_rows(rows, bits, "slice long, bits binary").toArrow().to_batches():
        for k, data in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            table[k] |= np.frombuffer(data, np.uint8)
    return table.tobytes()


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The values of each key; keys are sorted."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge].tolist(), np.split(values, edge[1:]) if len(keys) else []


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", width: int = 4, least: int = 30) -> DataFrame:
    """lang, words, phrase, f of every phrase of up to ``width`` words that occurs ``least`` times or more in its language, and
    a row of 0 words with the number of all words."""
    chunks, overlap = dictionary(docs, text_col, lang_col, width), width - 1
    found, below = None, None
    for words in range(1, width + 1):
        level = frequent(chunks, words, below, least, overlap)
        below = table_of(level) if words < width else None
        level = level.select(F.col("chunk").alias("id"), "at", F.lit(words).alias("words"), "n")
        found = level if found is None else found.unionByName(level)
    holders = table_of(found.select(F.xxhash64("id").alias("first")))
    sent = chunks.sparkSession.sparkContext.broadcast(holders)

    def holding(batches):
        table = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            bits = batch.column("hash").to_numpy().view(np.uint64) & np.uint64((1 << TABLE_BITS) - 1)
            yield batch.filter(pa.array((table[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1)).select(["id", "lang", "chunk"])

    some = many_rows(chunks.select("id", "lang", "chunk", F.xxhash64("id").alias("hash")), holding, "id long, lang string, chunk binary")
    # The chunk's words from a place on, up to the phrase's last.
    words = F.split(F.col("chunk").cast("string"), " ")
    texts = found.join(some, "id").select("lang", "words", F.array_join(F.slice(words, F.col("at") + 1, F.col("words")), " ").alias("phrase"), F.col("n").alias("f"))
    totals = chunks.filter("chunk = CAST('' AS BINARY)").select("lang", F.lit(0).alias("words"), F.lit("").alias("phrase"), F.col("n").alias("f"))
    return stored(texts.union(totals), "phrases")


def big(count: Column) -> Column:
    """A count whose products may pass 64 bits."""
    return count.cast("decimal(20,0)")


def parts_of(phrase: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(phrase, first, size), " ")


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", width: int = 4, least: int = 30, scale: int = 2_000_000, inside_percent: int = 80, most: int | None = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of two words or more.

    Of all cuts of a phrase into two the one with the lowest score counts, floor(scale * a / (l + r)), ties go to the shortest
    first part. A phrase goes if a longer one that contains it has ``inside_percent`` of its occurrences or more. The first
    ``most`` of each language (all if None) are ranked by score and occurrences, both descending, and by the phrase's bytes.
    """
    counted = frequent_phrases(docs, text_col, lang_col, width, least)
    found = counted.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("list"))
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = found.select("lang", "phrase", "a", "words", "list", cut.alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "words", "k", parts_of(F.col("list"), F.lit(1), F.col("k")).alias("first"), parts_of(F.col("list"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = counted.filter(f"words > 0 AND words < {width}")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("sum", (big(F.col("l")) + big(F.col("r")))).withColumn("times", big(F.col("a")) * F.lit(scale).cast("decimal(17,0)"))
    cuts = cuts.withColumn("score", F.expr("times DIV sum"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    length, at = F.explode(F.sequence(F.lit(2), F.col("words") - 1)), F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1))
    inside = found.filter("words > 2").select("lang", "a", "words", "list", length.alias("length")).select("lang", "a", "list", "length", at.alias("at"))
    inside = inside.select("lang", parts_of(F.col("list"), F.col("at"), F.col("length")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left")
    kept = kept.filter(F.col("longer").isNull() | (big(F.col("longer")) * 100 < big(F.col("a")) * inside_percent))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)).alias("share"))
    if most is not None:  # what is not among the first of its share is not among the first of all
        kept = kept.withColumn("place", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).filter(F.col("place") <= most)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    if most is not None:
        ranked = ranked.filter(F.col("rank") <= most)
    totals = counted.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
