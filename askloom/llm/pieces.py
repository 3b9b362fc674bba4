"""SentencePiece encoding and decoding with a given vocabulary file.

An Aho-Corasick automaton over the pieces reads a text once; at each position it follows its output links, and every piece that ends
there relaxes the best score of the position (Viterbi). No piece holds a space mark after another character, so the best path
never crosses the begin of a run of spaces, and a run with the word after it is worked out once and remembered.

In a unigram model the path with the best sum of scores is the encoding. In a byte-pair model scores only order merges, so a sum
says nothing; there a piece relaxes a position only if it and the piece before it stay as they are when their text is merged on its own. A sequence
is the encoding exactly if all neighbours do, so one path is left, with the ids that merging the whole text gives.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm.common import SLICE_BYTES

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD_BYTES = 256 << 20
"""Memory of a task for words it has met, about; it is emptied when it is full, which only costs time."""
LONGEST_REMEMBERED = 64
PAIRS_REMEMBERED = 500_000

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model format
_UNIT = re.compile(r" *[^ ]+| +")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = 8 if kind == 1 else 4 if kind == 5 else None
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def is_byte_pair(data: bytes) -> bool:
    """Whether the model's trainer settings name byte-pair merging (fixed values: fields 2 and 3, type 2)."""
    return any(n == 2 and dict(_fields(v)).get(3, 1) == 2 for n, v in _fields(data))


def parse_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id from the bytes of a model file."""
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            found = dict(_fields(value))
            pieces.append((found[1].decode(), float(np.frombuffer(found.get(2, b"\0\0\0\0"), "<f4")[0]), found.get(3, _NORMAL)))
    return pieces


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, data: bytes, splits: dict[int, tuple[int, int]] | None = None):
        pieces = parse_model(data)
        self.automaton = ahocorasick.Automaton()
        self.spelled: list[bytes] = []
        self.bytes = {}
        self.unknown = 0
        for i, (piece, score, kind) in enumerate(pieces):
            self.spelled.append(b"" if kind in (_CONTROL, _UNKNOWN) else piece.replace(MARK, " ").encode())
            if kind == _BYTE:
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.spelled[i] = bytes([value])
            elif kind in (_NORMAL, _USER):
                # a mark stands for a space; the automaton reads spaces themselves
                self.automaton.add_word(piece.replace(MARK, " "), (len(piece), score, i))
            elif kind == _UNKNOWN:
                self.unknown = i
        self.automaton.make_automaton()
        if any(" " in p.replace(MARK, " ").lstrip(" ") for p, _, k in pieces if k in (_NORMAL, _USER)):
            raise ValueError("pieces with a space mark inside are not supported")
        if not {c for w in self.automaton.keys() for c in w} <= set(self.automaton.keys()):
            raise ValueError("every character of a piece needs a piece of its own")
        self.words: dict[str, list[int]] = {}
        self.word_bytes = 0
        self.pairs: dict[tuple[int, int], bool] = {}
        self.text_of = {v[2]: w for w, v in self.automaton.items()}
        self.splits = splits
        self.chars = {w for w in self.automaton.keys() if len(w) == 1}
        self.joined = {w[i:i + 2] for w in self.automaton.keys() for i in range(len(w) - 1)}
        # place of each piece's merge in the order of merges; single characters are there from the start
        merged = sorted((w for w in self.automaton.keys() if len(w) > 1), key=lambda w: -self.automaton.get(w)[1])
        self.rank = {w: i for i, w in enumerate(merged, 1)}

    def fits(self, before: int, piece: int) -> bool:
        """Whether ``piece`` stays as it is behind the piece ``before`` (-1: none, or a character without piece) when both are merged.

        Both are taken apart again from the latest merge to the earliest. They stay apart unless, at some time, the
        parts that meet at the border could have been merged earlier than the merge just undone; of equal merges the left one is first.
        """
        if piece not in self.splits:
            return False
        if before < 0:
            return True
        found = self.pairs.get((before, piece))
        if found is None:
            if len(self.pairs) >= PAIRS_REMEMBERED:
                self.pairs.clear()
            found = self.pairs[before, piece] = self._apart(before, piece)
        return found

    def _apart(self, before: int, piece: int) -> bool:
        rank, splits, text_of = self.rank, self.splits, self.text_of
        left, right, limit = before, piece, len(rank) + 1
        while True:
            joint = rank.get(text_of[left] + text_of[right])
            if joint is not None and joint < limit:
                return False
            of_left, of_right = rank.get(text_of[left], 0), rank.get(text_of[right], 0)
            if not of_left and not of_right:
                return True
            if of_left > of_right:
                left, limit = splits[left][1], of_left
            else:
                right, limit = splits[right][0], of_right + (of_left != of_right or of_right > 0)

    def _one_path(self, text: str) -> list[int]:
        """The path of a byte-pair model through characters that all have pieces: each position keeps the one piece that may end there."""
        n = len(text)
        last, begin = [-1] * (n + 1), [-1] * (n + 1)
        begin[0] = 0
        pairs, splits = self.pairs, self.splits
        for end, (size, _, piece) in self.automaton.iter(text):
            end += 1
            start = end - size
            if begin[end] >= 0 or begin[start] < 0:
                continue
            before = last[start]
            good = piece in splits if before < 0 else pairs.get((before, piece))
            if good is None:
                good = self.fits(before, piece)
            if good:
                last[end], begin[end] = piece, start
        ids = []
        while n:
            ids.append(last[n])
            n = begin[n]
        ids.reverse()
        return ids

    def _best_path(self, text: str) -> list[int]:
        """The path of a unigram model with the best sum of scores; of equal ones the one whose last piece is longest."""
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for end, (size, score, piece) in self.automaton.iter(text):
            start = end + 1 - size
            total = best[start] + score
            if total > best[end + 1] or (total == best[end + 1] and start < back[end + 1][0]):
                best[end + 1], back[end + 1] = total, (start, piece)
        ids = []
        while n:
            n, piece = back[n]
            ids.append(piece)
        ids.reverse()
        return ids

    def viterbi(self, text: str) -> list[int]:
        """Ids of one run of text. A character without a piece parts the paths on its sides and becomes its bytes.

        Two characters that no piece holds side by side part the paths as well, so that a word is remembered without its punctuation.
        """
        path = self._best_path if self.splits is None else self._one_path
        if text[1:].isalpha() and self.chars.issuperset(text):
            return path(text)
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.joined]
        if not cuts:
            if text in self.chars or len(text) > 1:
                return path(text)
            return [self.bytes.get(b, self.unknown) for b in text.encode("utf-8", "surrogatepass")]
        ids: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            ids += self._remembered(text[a:b])
        return ids

    def _remembered(self, unit: str) -> list[int]:
        ids = self.words.get(unit)
        if ids is None:
            ids = self.viterbi(unit)
            if len(unit) <= LONGEST_REMEMBERED:
                if self.word_bytes >= WORD_BYTES:
                    self.words.clear()
                    self.word_bytes = 0
                self.words[unit] = ids
                self.word_bytes += 250 + len(unit) + 8 * len(ids)
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of ``text`` behind one added space; a text that is empty has none. A space mark in the text itself is spelled in bytes."""
        if not text:
            return []
        words, out = self.words, []
        for unit in _UNIT.findall(" " + text):
            out += words.get(unit) or self._remembered(unit)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text whose encoding ``ids`` is."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")[1:]


def merge_splits(data: bytes) -> dict[int, tuple[int, int]] | None:
    """For a byte-pair model, the two pieces whose merge made each piece; a single character is made of itself twice.

    A piece that merging its own text does not give is left out, it is never used. None for a unigram model.
    """
    if not is_byte_pair(data):
        return None
    known = {p.replace(MARK, " "): (s, i) for i, (p, s, k) in enumerate(parse_model(data)) if k in (_NORMAL, _USER)}
    out = {}
    for text, (_, number) in known.items():
        symbols, last = list(text), (text, text)
        while len(symbols) > 1:
            best = max(((known[a + b][0], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in known), default=None)
            if best is None:
                break
            i = -best[1]
            last = (symbols[i], symbols[i + 1])
            symbols[i:i + 2] = [last[0] + last[1]]
        if len(symbols) == 1 and all(part in known for part in last):
            out[number] = (known[last[0]][1], known[last[1]][1])
    return out


def model_bytes(path: str = MODEL) -> bytes:
    """The vocabulary file, read once by the driver and sent with the job (0.5 MB), so that executors need no copy."""
    with open(path, "rb") as f:
        return f.read()


def _shared(spark: SparkSession, path: str):
    data = model_bytes(path)
    return spark.sparkContext.broadcast({"data": data, "splits": merge_splits(data)})


def _codec(shared) -> Codec:
    """The codec of a broadcast model; it stays with the broadcast value, so later tasks of a Python worker remember its words."""
    held = shared.value
    if "codec" not in held:
        held["codec"] = Codec(held["data"], held["splits"])
    return held["codec"]


def _parts(batches: Iterator[pa.RecordBatch], column: str, width: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``SLICE_BYTES`` of ``column`` (``width`` bytes per character or list item), at least one row each."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)) if width == 1 else pc.list_value_length(batch.column(column)), 0)
        sizes = np.cumsum(np.asarray(lengths, np.int64) * width + 1)
        start = 0
        while start < len(batch):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _with_column(part: pa.RecordBatch, kept: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], values], names=[*kept, name])


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", path: str = MODEL) -> DataFrame:
    """``docs`` with its text's piece ids as the column ``ids_col`` (a column of that name is replaced).

    A null text gives null, an empty one an empty array. Whole texts are encoded, a slice of bounded bytes at a time; decoding gives each text back exactly.
    """
    model = _shared(docs.sparkSession, path)
    kept = [c for c in docs.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(model)
        for part in _parts(batches, text_col, 1):
            texts = part.column(part.schema.get_field_index(text_col))
            flat, offsets = array("i"), [0]
            for text in texts:
                if text.is_valid:
                    flat.extend(c.encode(text.as_py()))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)), mask=texts.is_null())
            yield _with_column(part, kept, ids_col, ids)

    return docs.mapInArrow(run, T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ids_col: str = "piece_ids", text_col: str = "decoded", path: str = MODEL) -> DataFrame:
    """``encoded`` with the decoded text as the column ``text_col``; null ids give null, no ids the empty text."""
    model = _shared(encoded.sparkSession, path)
    kept = [c for c in encoded.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(model)
        for part in _parts(batches, ids_col, 4):
            texts = [None if not ids.is_valid else c.decode(ids.as_py()) if len(ids) else "" for ids in part.column(part.schema.get_field_index(ids_col))]
            yield _with_column(part, kept, text_col, pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, T.StructType([*encoded.select(*[F.col(f"`{c}`") for c in kept]).schema, T.StructField(text_col, T.StringType())]))


def encode_and_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """(``id_col``, n_pieces, piece_ids, exact): the encoding of every row and whether decoding it gave the text back.

    A null text counts as empty: no pieces, exact. Every row gives one row, repeated ones too.
    """
    model = _shared(docs.sparkSession, path)
    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(1).to_pylist()
                rows = [c.encode(t) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.array([c.decode(r) == t for r, t in zip(rows, texts, strict=True)], pa.bool_())],
                    [id_col, "n_pieces", "piece_ids", "exact"])

    return base.mapInArrow(run, f"`{id_col}` long, n_pieces long, piece_ids array<int>, exact boolean")

