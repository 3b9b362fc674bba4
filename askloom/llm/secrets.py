"""Secret scan: Aho-Corasick finds keywords, anchored patterns run at their hits only, checksums decide on tokens that embed one.

Long runs of hexadecimal digits have no keyword. They are found as runs in the bytes of a whole slice of texts at once.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import slices

KINDS = ("assign", "access", "hex", "github", "npm")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

# fixed values: the patterns of the contract and the public formats of tokens that carry a checksum
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_GITHUB_STARTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True


def keyword_automaton() -> ahocorasick.Automaton:
    """Every keyword in every mixture of cases where case is free; the value is (kind, length)."""
    found = ahocorasick.Automaton()
    for word in _ASSIGN_WORDS:
        for spelled in itertools.product(*[{c.lower(), c.upper()} for c in word]):
            found.add_word("".join(spelled), ("assign", len(word)))
    found.add_word("AKIA", ("access", 4))
    for start in _GITHUB_STARTS:
        found.add_word(start, ("github", 4))
    found.add_word("npm_", ("npm", 4))
    found.make_automaton()
    return found


def checksum_holds(body: str) -> bool:
    """Whether the last six characters of a token's body are the CRC-32 of the ones before, in base 62."""
    value, digits = zlib.crc32(body[:-6].encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return digits.rjust(6, "0") == body[-6:]


def keyword_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost matches of a kind that do not overlap; a match that fails its test still hides what it covers."""
    spans, free = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in automaton.iter(text))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            match = _ASSIGN.match(text, start)
            good = match and match.end() - match.start(2) >= LEAST_VALUE
        elif kind == "access":
            match = _ACCESS.match(text, start)
            good = match and match.end() - start >= LEAST_ACCESS
        else:
            match = (_GITHUB if kind == "github" else _NPM).match(text, start)
            good = match and checksum_holds(match[1])
        if match:
            free[kind] = match.end()
            if good:
                spans.append((start, match.end(), kind))
    return spans


def hex_runs(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Byte spans of the runs of at least 24 hexadecimal digits in each text."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = _HEX_BYTE[joined]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= LEAST_HEX
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        i = int(np.searchsorted(begin, a, "right")) - 1
        found[i].append((a - int(begin[i]), b - int(begin[i])))
    return found


def _in_points(text: bytes, at: int) -> int:
    return at if text.isascii() else len(text[:at].decode("utf-8", "replace"))


def scan_texts(texts: list[bytes], automaton: ahocorasick.Automaton) -> list[list[tuple[int, int, str]]]:
    """All spans of each text in code points, by start and then by kind as listed."""
    out = []
    for raw, runs in zip(texts, hex_runs(texts), strict=True):
        spans = keyword_spans(raw.decode("utf-8", "replace"), automaton)
        spans += [(_in_points(raw, a), _in_points(raw, b), "hex") for a, b in runs]
        out.append(sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, secrets): for every row the spans (kind, start, end), by start and then by kind.

    Kinds ``assign``, ``access`` and ``hex`` follow their patterns alone; ``github`` and ``npm`` tokens count only if their embedded checksum
    holds. Spans are code points, end exclusive. A null or empty text has none. Every row gives one row. Whole texts are searched.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keyword_automaton()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                spans = [[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in scan_texts(texts, automaton)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(spans, pa.list_(kind))], ["doc_id", "secrets"])

    return base.mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:long,end:long>>").withColumnRenamed("doc_id", id_col)


def redact(texts_with_spans: DataFrame, text_col: str = "text", spans_col: str = "secrets") -> DataFrame:
    """``text_col`` with every span replaced by ``[KIND]``; of overlapping spans the first, then the longest, is written."""
    @F.pandas_udf("string")
    def run(texts, spans):
        def one(text, found):
            if text is None or found is None:
                return text
            parts, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
                    at = s["end"]
                elif s["end"] > at:
                    at = s["end"]
            return "".join([*parts, text[at:]])
        return type(texts)([one(t, s) for t, s in zip(texts, spans, strict=True)])

    return texts_with_spans.withColumn(text_col, run(F.col(text_col), F.col(spans_col)))

