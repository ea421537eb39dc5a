"""SentencePiece encoding and decoding: shared-prefix dynamic programming over the distinct marked words of each batch.

Text is normalised as the model says: a leading space, and every space becomes the mark U+2581. No piece goes on
past the place where a mark begins or beside a line feed, so the units between them ("marked words") are encoded by
themselves. The distinct units of a batch of documents are sorted; sorted order walks their trie depth first, and a stack of
forward states, one for each character of the current path, is kept as far as the next word shares its beginning.

The forward state depends on the model's kind.

* Unigram: the best sum of scores of any segmentation of the prefix, and its last piece (Viterbi).
* Byte-pair: the last piece of the prefix's own encoding. A sequence is the encoding of its text exactly when every two
  neighbours are the encoding of theirs, so of the pieces that end here just one goes with the state it starts from.
  Summing scores, as for unigram models, would give other pieces than the model's merges; its scores only rank merges.

Characters without a piece become byte pieces if the model has them, else the unknown piece.

Null texts give null ids; empty texts give no ids. Whole texts are encoded; memory is bounded by the batch and by a bounded
memory of words. Nothing is shuffled. Repeated rows are encoded each. A text in which the mark itself stands decodes to a
space there (``round_trip`` is false), as with the public library.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from watchfloor.llm.common import Memory, in_bulk, map_batches

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BULK_BYTES = 4 << 20  # of texts whose words are sorted together
WORDS_KEPT = 200_000  # words of a generation; two are kept
PAIRS_KEPT = 500_000
# Fixed values of the public model format: kinds of model and of piece.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces, their scores and the few settings that matter, read from a .model file's bytes."""

    def __init__(self, data: bytes):
        self.texts, self.scores, self.kinds = [], [], []
        trainer, normalizer = b"", b""
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.texts.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = value
            elif number == 3:
                normalizer = value
        settings, rules = dict(fields(trainer)), dict(fields(normalizer))
        self.kind = settings.get(3, UNIGRAM)
        self.prefix = bool(rules.get(3, 1))
        self.squeeze = bool(rules.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or rules.get(2) or settings.get(24):
            raise ValueError("only unigram and byte-pair models without a character map and with marks in front are known")
        self.finish()

    def finish(self) -> None:
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k in (NORMAL, USER, UNUSED)}
        self.bytes = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.longest = max(map(len, self.ids))
        lines = any("\n" in t for t in self.ids)
        after = any(MARK in t.lstrip(MARK) for t in self.ids)
        self.units = re.compile("(?s).+" if after else f"{MARK}*[^{MARK}]+|{MARK}+" if lines else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        # What each piece stands for; high bytes are put together later.
        self.surface = [
            "" if k in (CONTROL, UNUSED) else " ⁇ " if k == UNKNOWN else chr(int(t[1:-1], 16)) if k == BYTE and int(t[1:-1], 16) < 128 else t.replace(MARK, " ")
            for t, k in zip(self.texts, self.kinds, strict=True)
        ]
        self.high = {i: b for b, i in self.bytes.items() if b > 127}

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode()) if self.bytes else (self.unknown,)

    def decode(self, ids) -> str:
        if not self.high or self.high.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in self.high:
                    run.append(self.high[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(self.surface[i])
            text = "".join([*out, run.decode("utf-8", "replace")])
        return text[1:] if self.prefix and text.startswith(" ") else text


def merged(model: Model, text: str) -> list[str]:
    """The pieces of ``text`` by the rule itself: merge the neighbours with the best score, the leftmost of equals."""
    parts = list(text)
    while len(parts) > 1:
        best = None
        for i in range(len(parts) - 1):
            at = model.ids.get(parts[i] + parts[i + 1])
            if at is not None and (best is None or model.scores[at] > best[0]):
                best = (model.scores[at], i)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def common_prefix(a: str, b: str) -> int:
    """How many characters both begin with."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    n = 0
    while a[n] == b[n]:
        n += 1
    return n


class Encoder:
    def __init__(self, model: Model):
        self.model, self.words, self.pairs = model, Memory(WORDS_KEPT), {}
        # Pieces by their characters from the last to the first: char -> (piece that begins there or -1, further chars).
        root: dict = {}
        for text, at in model.ids.items():
            node = [-1, root]
            for char in reversed(text):
                node = node[1].setdefault(char, [-1, {}])
            node[0] = at
        self.endings = root

    def together(self, a: str, b: str) -> bool:
        """Do pieces ``a`` and ``b`` stay as they are side by side?"""
        return merged(self.model, a + b) == [a, b]

    def fits(self, word: str, start: int, end: int, before: int | None) -> bool:
        """Does the piece word[start:end] go with the encoding of word[:start], whose last piece is ``before``?"""
        piece = word[start:end]
        if not start:
            return merged(self.model, piece) == [piece]
        return self.together(word[start - 1] if before is None else self.model.texts[before], piece)

    def last_piece(self, word: str, end: int, last: list) -> int | None:
        """The piece that goes with the state it starts from; None: the character has no piece."""
        further, found, start, pairs = self.endings, [], end, self.pairs
        while start:
            node = further.get(word[start - 1])
            if node is None:
                break
            start -= 1
            at, further = node
            if at >= 0:
                found.append((start, at))
        single = end - 1
        while found:
            start, at = found.pop()
            if start == single:
                return at
            key = (last[start], at, start and 1)
            known = pairs.get(key)
            if known is None:
                known = self.fits(word, start, end, last[start])
                if last[start] is not None or not start:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    pairs[key] = known
            if known:
                return at
        return None

    def best_piece(self, word: str, end: int, best: list[float], penalty: float) -> tuple[float, int | None]:
        """The best score of the prefix up to ``end`` and its last piece."""
        further, start, top, chosen = self.endings, end, best[end - 1] + penalty, None
        while start and (node := further.get(word[start - 1])) is not None:
            start -= 1
            at, further = node
            if at >= 0 and (chosen is None or best[start] + self.model.scores[at] > top):
                top, chosen = best[start] + self.model.scores[at], at
        return top, chosen

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Sorted distinct words with their ids. last[i] is the last piece of the encoding of the first i characters of the
        current path (None: a character without a piece), best[i] its score."""
        model, viterbi = self.model, self.model.kind == UNIGRAM
        lengths = [len(t) for t in model.texts]
        penalty = min(model.scores, default=0.0) - 10.0
        last: list[int | None] = [None]
        best, before = [0.0], ""
        for word in words:
            shared = common_prefix(before, word)
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if viterbi:
                    top, chosen = self.best_piece(word, end, best, penalty)
                    best.append(top)
                else:
                    chosen = self.last_piece(word, end, last)
                last.append(chosen)
            before, out, at = word, [], len(word)
            while at:
                piece = last[at]
                if piece is None:
                    out.append(model.fallback(word[at - 1]))
                    at -= 1
                else:
                    out.append((piece,))
                    at -= lengths[piece]
            yield word, tuple(chain.from_iterable(reversed(out)))

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        units = [None if t is None else self.model.units.findall(self.model.normalised(t)) for t in texts]
        new = self.words.new(set(chain.from_iterable(u for u in units if u)))
        self.words.update(self.encode_sorted(sorted(new)))
        return [None if u is None else list(chain.from_iterable(map(self.words.__getitem__, u))) for u in units]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, check: bool = False) -> DataFrame:
    """doc_id, ids, n_tokens; with ``check`` also round_trip: do the ids decode to the text?"""
    sent = docs.sparkSession.sparkContext.broadcast({"model": read_model(model)})

    def run(batches):
        if "encoder" not in sent.value:  # a worker process keeps its copy, and so its memory of words, from task to task
            sent.value["encoder"] = Encoder(Model(sent.value["model"]))
        encoder = sent.value["encoder"]
        known = encoder.model
        for batch in in_bulk(batches, BULK_BYTES):
            texts = batch.column("text").to_pylist()
            ids = encoder.encode(texts)
            lengths = np.array([0, *[len(i or ()) for i in ids]], np.int64).cumsum()
            flat = np.fromiter(chain.from_iterable(i or () for i in ids), np.int32, int(lengths[-1]))
            missing = pa.array([i is None for i in ids])
            lists = pa.ListArray.from_arrays(pa.array(lengths.astype(np.int32)), pa.array(flat), mask=missing)
            columns = [batch.column("doc_id"), lists, pa.array([None if i is None else len(i) for i in ids], pa.int64())]
            names = ["doc_id", "ids", "n_tokens"]
            if check:
                columns.append(pa.array([None if i is None else known.decode(i) == t for i, t in zip(ids, texts, strict=True)], pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>, n_tokens long"
    return map_batches(rows, run, schema + ", round_trip boolean" * check)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id, text of arrays of ids. Ids outside the vocabulary are an error; null arrays give null texts."""
    sent = tokens.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches):
        known = Model(sent.value)
        for batch in batches:
            texts = [None if i is None else known.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = tokens.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids")
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string")
