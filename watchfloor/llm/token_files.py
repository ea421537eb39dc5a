"""Token ids in Huffman-coded files: canonical codes of bounded length from global counts, decoded by table.

1. Documents are dealt into ranges of the id, so each task holds neighbours, and encoded. Ids go out in blocks of whole
   documents, ``BLOCK_TOKENS`` or more each.
2. Each task counts the ids of its blocks; sums over all tasks (one row per vocabulary entry) give code lengths of at most
   ``LIMIT`` bits by package-merge. Canonical order makes the codes follow from the lengths, which are all a file keeps.
3. Each task writes its blocks to files. A block begins with its documents and the bit offset of every ``STRIDE``-th id, so
   it is decoded by itself, and all its stretches at once: the next ``LIMIT`` bits of each look up id and length in a table.

A manifest has one row per file, in order of the ids; readers take ranges of blocks from the index at a file's end. A task
that is run again writes files of other names, and the manifest names only those of the attempt that counted.

Words between white space are encoded once and remembered (``by_words``), which is exact for vocabularies that drop white
space and mark the end of words, like the given one: nothing its normaliser or its pattern does crosses a space.
``by_words=False`` hands whole texts to the library.

Defined results: null and empty texts have the end id alone. Ids must be integers; null ids come first; rows of the same id
are ordered by their text's hash, and repeated rows lie side by side, each with a start of its own. A block holds whole
documents, so a very long one makes a large block. An empty table has no files and no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchfloor.llm.common import Memory, checkpointed, in_bulk, map_batches, new_folder, partitions, stored

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 2
LIMIT = 16  # bits of the longest code; 2**LIMIT entries of the decoding table
STRIDE = 128  # ids between bit offsets
BLOCK_TOKENS = 1 << 17
FILE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
WORDS_KEPT = 400_000  # words of a generation; two are kept
RUNS_AT_ONCE = 2000
BULK_BYTES = 8 << 20  # of texts whose words are told apart at once
# Characters of plain words: ASCII, Latin letters and some marks. None of them changes or joins when texts are normalised, each
# has at most one lower-case letter, and any Unicode version says alike what is a letter. Others are left to the library.
PLAIN = "!-~¡-©«¬®-±¶·»¿-įı-ſ‐-‧"
# What the pattern's classes mean among plain characters; spelt out, they are searched several times faster.
PLAIN_LETTERS, PLAIN_DIGITS = (r"\p{L}", "a-zß-öø-įı-ſ"), (r"\p{N}", "0-9")
MAGIC = b"WFTOKEN1"


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + size], one behind the other."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class Words:
    """Encodes texts by their distinct words, and plain words by the distinct cuts that the tokenizer's own pattern makes of
    them. Runs of letters go to the library many at a time and are told apart by the pieces that end one."""

    def __init__(self, tokenizer, data: str, kind: str):
        self.tokenizer, self.kind, self.cuts, self.others = tokenizer, np.dtype(kind), Memory(WORDS_KEPT), Memory(WORDS_KEPT)
        known = json.loads(data)
        steps = known["pre_tokenizer"].get("pretokenizers") or [known["pre_tokenizer"]]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.pattern = f"({pattern.replace(PLAIN_LETTERS[0], PLAIN_LETTERS[1]).replace(PLAIN_DIGITS[0], PLAIN_DIGITS[1])})"
        # Runs of plain letters in lower case are what the normaliser and the pattern would leave of them.
        from tokenizers import Tokenizer, pre_tokenizers

        self.runs_only = Tokenizer(tokenizer.model)
        self.runs_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = "|".join(re.escape(t["content"]) for t in known["added_tokens"])
        self.odd = f"[^{PLAIN}]" + (f"|{special}" if special else "")
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(known["model"]["end_of_word_suffix"])]] = True

    def each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def runs(self, texts: list[str]) -> list[bytes]:
        """The ids of runs of letters."""
        ids = np.array(self.runs_only.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(texts):
            return self.each(texts)
        data, edges = ids.tobytes(), (ends * self.kind.itemsize).tolist()
        return [data[i:j] for i, j in zip([0, *edges], edges, strict=False)]

    def ids_of(self, memory: Memory, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` in a row, and how many each has."""
        new = memory.new(texts)
        letters, others = ([t for t in new if t.isalpha()], [t for t in new if not t.isalpha()]) if memory is self.cuts else ([], new)
        memory.update(zip(others, self.each(others), strict=True))
        for at in range(0, len(letters), RUNS_AT_ONCE):
            some = letters[at : at + RUNS_AT_ONCE]
            memory.update(zip(some, self.runs(some), strict=True))
        found = list(map(memory.__getitem__, texts))
        return np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)
        counted = pc.list_flatten(split).dictionary_encode()
        words, place = counted.dictionary, counted.indices.to_numpy()
        odd = pc.match_substring_regex(words, pattern=self.odd)
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words.filter(pc.invert(odd))), pattern=self.pattern, replacement=r"\1 "), pattern=" ")
        pieces = pc.list_flatten(cut).dictionary_encode()
        # One text split again: much faster than a text at a time. Pieces hold no space.
        together = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary), " ")[0].as_py()
        flat, size = self.ids_of(self.cuts, together.split(" ") if len(pieces.dictionary) else [])
        which, number = pieces.indices.to_numpy(), pc.list_value_length(cut).to_numpy()
        flat = gathered(flat, (np.cumsum(size) - size)[which], size[which])
        # Each word's ids: of plain ones those of its cuts, of others what the library says.
        edges = np.concatenate([[0], np.cumsum(size[which])])[np.concatenate([[0], np.cumsum(number)])]
        more, more_size = self.ids_of(self.others, words.filter(odd).to_pylist())
        is_odd = odd.to_numpy(zero_copy_only=False)
        word_size = np.empty(len(words), np.int64)
        word_size[~is_odd], word_size[is_odd] = np.diff(edges), more_size
        word_start = np.empty(len(words), np.int64)
        word_start[~is_odd], word_start[is_odd] = edges[:-1], len(flat) + np.cumsum(more_size) - more_size
        ids = gathered(np.concatenate([flat, more]), word_start[place], word_size[place])
        upto = np.concatenate([[0], np.cumsum(word_size[place])])
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])])


def encoder(sent: dict):
    """texts -> their ids in a row and how many each has; a worker process keeps it, and so what it remembers, from task to
    task."""
    if "encode" not in sent:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, kind = Tokenizer.from_str(sent["json"]), sent["kind"]

        def whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            found = [np.array(e.ids, kind) for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, kind), *found]), np.array([len(f) for f in found], np.int64)

        sent["encode"] = Words(tokenizer, sent["json"], kind).encode if sent["by_words"] else whole
    return sent["encode"]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code (0: never used), at most ``limit``, of the least total size: package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    if len(used) <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64) if counts.sum() >= 1 << 62 else counts[order].astype(np.int64)
    is_leaf, items = [], weights
    for level in range(limit):
        if level:
            even = len(items) // 2 * 2
            both = np.concatenate([weights, items[0:even:2] + items[1:even:2]])
            place = np.argsort(both, kind="stable")
            items = both[place]
            is_leaf.append(place < len(weights))
        else:
            is_leaf.append(np.ones(len(weights), bool))
    wanted = 2 * len(weights) - 2
    for leaves in reversed(is_leaf):
        n = int(leaves[:wanted].sum())
        out[order[:n]] += 1
        wanted = 2 * (wanted - n)
    return out


class Code:
    """Canonical codes of the given lengths: shorter ones first, equal ones in order of their symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.limit = max(1, int(lengths.max(initial=1)))
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        spans = (1 << (self.limit - lengths[order].astype(np.int64))).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(spans)])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (starts[:-1] >> (self.limit - lengths[order].astype(np.int64))).astype(np.uint64)
        # A single symbol leaves half of the table unused.
        self.symbols = np.zeros(1 << self.limit, np.uint32)
        self.bits = np.ones(1 << self.limit, np.uint8)
        self.symbols[: starts[-1]] = np.repeat(order, spans)
        self.bits[: starts[-1]] = np.repeat(self.lengths[order], spans)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of ``ids`` in a row, and the bits of each stretch of STRIDE ids."""
        if not len(ids):
            return b"", np.zeros(0, np.uint16)
        size = self.lengths[ids].astype(np.int64)
        end = np.cumsum(size)
        start = end - size
        word = start >> 5
        value = self.codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
        out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: int(end[-1] + 7) // 8], np.add.reduceat(size, np.arange(0, len(ids), STRIDE)).astype(np.uint16)

    def unpack(self, data: bytes, stretches: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block: all stretches at once, an id of each at a time."""
        place = np.concatenate([[0], np.cumsum(stretches.astype(np.int64))])[:-1]
        padded = np.frombuffer(data + bytes(STRIDE * 2 + 4), np.uint8).astype(np.uint32)
        window = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
        out = np.empty((min(STRIDE, n), len(place)), np.uint32)
        drop, mask = 24 - self.limit, (1 << self.limit) - 1
        for row in out:
            at = (window[place >> 3] >> (drop - (place & 7))) & mask
            row[:] = self.symbols[at]
            place += self.bits[at]
        return out.T.ravel()[:n]


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, by_words: bool) -> DataFrame:
    """part, block, doc_ids, sizes, ids: documents in blocks, blocks in the order of the ids by (part, block)."""
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as file:
        data = file.read()
    kind = "<u2" if Tokenizer.from_str(data).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({"json": data, "kind": kind, "by_words": by_words})
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    order = ("doc_id", "hash", "row")
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches):
        encode, width, end = encoder(sent.value), np.dtype(kind).itemsize, np.array([end_id], kind)
        part, block, ids, sizes, parts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, block, width, ids, sizes, b"".join(parts)), schema, strict=True)], schema=schema)

        for some in in_bulk(batches, BULK_BYTES):
            found, lengths = encode(some.column("text"))
            at = 0
            for doc_id, length in zip(some.column("doc_id").to_pylist(), lengths.tolist(), strict=True):
                parts += (found[at : at + length].tobytes(), end.tobytes())
                ids.append(doc_id)
                sizes.append(length + 1)
                held, at = held + length + 1, at + length
                if held >= BLOCK_TOKENS:
                    yield made()
                    block, ids, sizes, parts, held = block + 1, [], [], [], 0
        if ids:
            yield made()

    return stored(map_batches(rows, run, "part int, block long, width int, doc_ids array<bigint>, sizes array<bigint>, ids binary"), "tokens")


def id_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; one row per id in use comes to the driver."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for width, ids in zip(batch.column("width").to_pylist(), batch.column("ids"), strict=True):
                total += np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    found = map_batches(blocks.select("width", "ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return counts


def write_files(blocks: DataFrame, lengths: np.ndarray, folder: str) -> DataFrame:
    """path, part, block, tokens, documents of each file below ``folder``, which holds neighbouring blocks of a part."""
    sent = blocks.sparkSession.sparkContext.broadcast(lengths.astype(np.uint8).tobytes())

    def run(batches):
        from pyarrow import fs as file_systems

        fs, base = file_systems.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        code, table = Code(np.frombuffer(sent.value, np.uint8)), zlib.compress(sent.value)
        done, out, index, expected = [], None, [], None

        def close():
            out.write(tail := json.dumps(index).encode())
            out.write(struct.pack("<Q", len(tail)) + MAGIC)
            out.close()
            done[-1] += (sum(b[3] for b in index), sum(b[2] for b in index))

        for batch in batches:
            for part, block, width, doc_ids, sizes, ids in zip(*(batch.column(c) for c in ("part", "block", "width", "doc_ids", "sizes", "ids")), strict=True):
                here = (part.as_py(), block.as_py())
                if out is not None and (here != expected or at >= FILE_BYTES):
                    close()
                    out = None
                if out is None:
                    path, index = f"{base.rstrip('/')}/{uuid.uuid4().hex}.tok", []
                    out = fs.open_output_stream(path, compression=None)
                    out.write(MAGIC + struct.pack("<Q", len(table)) + table)
                    at = 16 + len(table)
                    done.append((path, *here))
                doc_ids, sizes = doc_ids.as_py(), np.array(sizes.as_py(), "<u8")
                packed, stretches = code.pack(np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}"))
                missing = np.packbits([i is None for i in doc_ids]).tobytes()
                head = zlib.compress(missing + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + sizes.tobytes())
                data = struct.pack("<QQ", len(head), len(stretches)) + head + stretches.astype("<u2").tobytes() + packed
                out.write(data)
                index.append((at, len(data), len(doc_ids), int(sizes.sum())))
                at, expected = at + len(data), (here[0], here[1] + 1)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["path", "part", "block", "tokens", "documents"])

    return checkpointed(map_batches(blocks, run, "path string, part int, block long, tokens long, documents long"))


def write_tokens(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, by_words: bool = True
) -> DataFrame:
    """The manifest of the files that hold the ids of ``docs``: path, tokens, documents and start (ids in files before it)."""
    from tokenizers import Tokenizer

    blocks = tokenized(docs, id_col, text_col, tokenizer, end_id, by_words)
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    files = write_files(blocks, code_lengths(id_counts(blocks, size)), folder)
    before = F.sum("tokens").over(W.orderBy("part", "block").rowsBetween(W.unboundedPreceding, -1))  # one row per file
    return files.select("path", "tokens", "documents", F.coalesce(before, F.lit(0)).alias("start"))


def read_index(file) -> tuple[bytes, list]:
    """Code lengths and (offset, bytes, documents, tokens) of each block."""
    size = file.size()
    file.seek(size - 16)
    length, magic = struct.unpack("<Q8s", file.read(16))
    if magic != MAGIC:
        raise ValueError("not a token file, or cut off")
    file.seek(size - 16 - length)
    index = json.loads(file.read(length))
    file.seek(8)
    (length,) = struct.unpack("<Q", file.read(8))
    return zlib.decompress(file.read(length)), index


def ranges(manifest: DataFrame, folder: str) -> DataFrame:
    """path, first, last, start: neighbouring blocks that one task reads."""

    def run(batches):
        from pyarrow import fs as file_systems

        fs, _ = file_systems.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(path) as file:
                    _, index = read_index(file)
                first = size = 0
                for k, block in enumerate(index):
                    size += block[1]
                    if size >= RANGE_BYTES or k == len(index) - 1:
                        rows.append((path, first, k + 1, start))
                        start += sum(b[3] for b in index[first : k + 1])
                        first, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "first", "last", "start"])

    return map_batches(manifest.select("path", "start"), run, "path string, first long, last long, start long")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers) of every document in the files."""

    def run(batches):
        from pyarrow import fs as file_systems

        fs, _ = file_systems.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first, last, start in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "last", "start")), strict=True):
                with fs.open_input_file(path) as file:
                    lengths, index = read_index(file)
                    code = Code(np.frombuffer(lengths, np.uint8))
                    for offset, size, documents, tokens in index[first:last]:
                        file.seek(offset)
                        data = file.read(size)
                        head, stretches = struct.unpack_from("<QQ", data)
                        table, body = zlib.decompress(data[16 : 16 + head]), 16 + head + 2 * stretches
                        flags = -(-documents // 8)
                        missing = np.unpackbits(np.frombuffer(table, np.uint8, flags))[:documents].astype(bool)
                        doc_ids = np.frombuffer(table, "<i8", documents, flags)
                        sizes = np.frombuffer(table, "<i8", documents, flags + 8 * documents)
                        ids = code.unpack(data[body:], np.frombuffer(data, "<u2", stretches, 16 + head), tokens)
                        edges = np.concatenate([[0], np.cumsum(sizes)])
                        raw = pa.py_buffer(ids.astype("<u4").tobytes())
                        values = pa.Array.from_buffers(pa.large_binary(), documents, [None, pa.py_buffer((edges * 4).astype(np.int64).tobytes()), raw]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=missing), pa.array(start + edges[:-1]), pa.array(sizes), values], ["doc_id", "start", "n_tokens", "ids"])
                        start += tokens

    parts = ranges(manifest, folder).repartition(partitions(manifest.sparkSession))
    return map_batches(parts, run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Ids of ``docs`` written to files and read back."""
    folder = folder or new_folder(spark, "token-files")
    return read_tokens(write_tokens(docs, folder, **options), folder)
