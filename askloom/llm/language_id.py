"""Language identification with a linear-chain conditional random field over words.

Affix, n-gram and lexicon features of each word and learned transitions between neighbouring words give the marginal probability of
every language at every word by forward-backward, so a text may switch languages. A document gets the language of the largest mean
marginal.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.llm.common import mix, release_memory

SAMPLE_DOCUMENTS = 150
"""Most different labelled texts per language that the field is fitted on, chosen by a hash of the text."""
SAMPLE_WORDS = 120
"""Words of each sampled document, a run at a place chosen by the same hash."""
SAMPLE_TOTAL, LEAST_DOCUMENTS = 9600, 10
"""Texts of all languages, which are shared out if there are many languages, and the fewest of a language; every labelled language is learnt."""
FEATURES = 1 << 16
LONGEST = 10
"""Letters of a word; longer runs are cut to pieces of that many."""
LISTED = 2
PER_WORD = 24 + LISTED
"""The word itself, 6 affixes, 9 bigrams, 8 trigrams, and up to two lexica, which few words are in at once."""
LEXICON = 300
EPOCHS = 6
REMEMBERED = 200_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_GROUP_CELLS = 1 << 19
_MANY = 64
"""Languages from which on fewer words are worked on and remembered at once."""


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, long ones in pieces; empty if the text has no letter."""
    found = _WORD.findall(text.lower())
    if not any(any(map(str.isalpha, w)) for w in found):
        return []
    if max(map(len, found)) > LONGEST:
        found = [p for w in found for p in ((w,) if len(w) <= LONGEST else [w[i:i + LONGEST] for i in range(0, len(w), LONGEST)])]
    return found


def feature_table(words: list[str], lexicon: dict[str, list[int]]) -> np.ndarray:
    """Numbers of each word's features, 0 being none: the word, affixes of up to three letters, n-grams, lexica that list it."""
    count = len(words)
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.zeros((count, LONGEST), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(count), lengths)
    letters[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    out = np.zeros((count, PER_WORD), np.int32)

    def number(kind: int, columns: list[np.ndarray]) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.full(count, kind, np.uint64)
            for c in columns:
                total = total * np.uint64(0x100000001B3) + c
            return (mix(total) % np.uint64(FEATURES - 1)).astype(np.int32) + 1

    out[:, 0] = number(1, [letters[:, j] for j in range(LONGEST)])
    at = 1
    for k in (1, 2, 3):
        out[:, at] = np.where(lengths >= k, number(10 + k, [letters[:, j] for j in range(k)]), 0)
        ends = [np.take_along_axis(letters, np.maximum(lengths - k + j, 0)[:, None], 1)[:, 0] for j in range(k)]
        out[:, at + 1] = np.where(lengths >= k, number(20 + k, ends), 0)
        at += 2
    for k in (2, 3):
        for i in range(LONGEST - k + 1):
            out[:, at] = np.where(lengths >= i + k, number(30 + k, [letters[:, i + j] for j in range(k)]), 0)
            at += 1
    for i, word in enumerate(words):
        listed = lexicon.get(word)
        if listed:
            out[i, at:at + LISTED] = (listed + [0] * LISTED)[:LISTED]
    return out


@dataclass
class Field:
    """A fitted field: languages in order, weights per feature and language, transition and start scores."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, list[int]]


def marginals(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (time, sequence, label) of padded sequences and, per transition, its expected count; padding gives zeros."""
    steps, count, labels = emission.shape
    potential = np.exp(emission - emission.max(2, keepdims=True))
    move = np.exp(transitions)
    live = np.arange(steps)[:, None] < lengths[None, :]
    forward = np.empty_like(potential)
    scale = np.ones((steps, count, 1))
    now = np.exp(start) * potential[0]
    for t in range(steps):
        if t:
            now = (now @ move) * potential[t]
        scale[t] = now.sum(1, keepdims=True)
        now = now / scale[t]
        forward[t] = now
    backward = np.ones((count, labels))
    out = np.zeros_like(potential)
    pairs = np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            weight = np.where(live[t + 1][:, None], potential[t + 1] * backward / scale[t + 1], 0.0)
            pairs += (forward[t].T @ weight) * move
            backward = np.where(live[t + 1][:, None], weight @ move.T, 1.0)
        out[t] = np.where(live[t][:, None], forward[t] * backward, 0.0)
    return out, pairs


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Field:
    """Fit a field to (language, text) rows. Runs of words of different languages are spliced, so that switches are learned too."""
    languages = sorted({lang for lang, _ in samples})
    parts = {lang: [] for lang in languages}
    for lang, text in samples:
        words = words_of(text)
        if words:
            parts[lang].append(words)
    languages = [lang for lang in languages if parts[lang]]
    counts = {lang: Counter(w for words in parts[lang] for w in words) for lang in languages}
    every = sum(counts.values(), Counter())
    whole = sum(every.values())
    lexicon: dict[str, list[int]] = {}
    for i, lang in enumerate(languages):
        own = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))
        total = sum(counts[lang].values())
        rest = max(1, whole - total)
        listed = [w for w, n in own if n / total > 4 * (every[w] - n) / rest][:LEXICON]
        for word in listed:
            lexicon.setdefault(word, []).append(1 + zlib.crc32(f"lexicon {i}".encode()) % (FEATURES - 1))
    rng = np.random.default_rng(seed)
    label_of = {lang: i for i, lang in enumerate(languages)}
    segments = [(label_of[lang], words[a:a + 24]) for lang in languages for words in parts[lang] for a in range(0, len(words), 24)]
    field = Field(languages, np.zeros((FEATURES, max(1, len(languages))), np.float32), np.zeros((len(languages),) * 2), np.zeros(len(languages)), lexicon)
    if len(languages) < 2:
        return field
    vocabulary = sorted({w for _, words in segments for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    table = feature_table(vocabulary, lexicon)
    squares = np.full(field.weights.shape, 1e-3, np.float32)
    move_squares, start_squares = np.full(field.transitions.shape, 1e-3), np.full(field.start.shape, 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(segments))
        sequences = [order[a:a + 2] for a in range(0, len(order), 2)]
        for at in range(0, len(sequences), 64):
            batch = [[(segments[i][0], number[w]) for i in s for w in segments[i][1]] for s in sequences[at:at + 64]]
            lengths = np.array([len(b) for b in batch])
            steps = int(lengths.max())
            ids, truth = np.zeros((steps, len(batch)), np.int64), np.zeros((steps, len(batch)), np.int64)
            for j, b in enumerate(batch):
                truth[:len(b), j], ids[:len(b), j] = zip(*b, strict=True)
            live = np.arange(steps)[:, None] < lengths[None, :]
            features = table[ids]
            out, pairs = marginals(field.weights[features].sum(2).astype(float), lengths, field.transitions, field.start)
            gap = (np.eye(len(languages))[truth] - out) * live[:, :, None]
            both = live[1:]
            seen = np.zeros_like(pairs)
            np.add.at(seen, (truth[:-1][both], truth[1:][both]), 1.0)
            used = features[live].ravel()
            touched, where = np.unique(used, return_inverse=True)
            step = np.zeros((len(touched), len(languages)), np.float32)
            np.add.at(step, where, np.repeat(gap[live], PER_WORD, 0).astype(np.float32))
            step -= 1e-4 * field.weights[touched]
            step[touched == 0] = 0
            squares[touched] += step ** 2
            field.weights[touched] += 0.2 * step / np.sqrt(squares[touched])
            for value, grown, change in ((field.transitions, move_squares, seen - pairs), (field.start, start_squares, gap[0].sum(0))):
                grown += change ** 2
                value += 0.2 * change / np.sqrt(grown)
    return field


def sample(docs: DataFrame, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """The bounded training sample: different texts of each labelled language, a run of words of each.

    Which texts are taken depends on their hashes alone, not on how often a text is repeated.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.withColumn("key", F.xxhash64("text"))
    keys = known.select("lang", "key").distinct()
    share = min(SAMPLE_DOCUMENTS, max(LEAST_DOCUMENTS, SAMPLE_TOTAL // max(1, keys.select("lang").distinct().count())))
    chosen = keys.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("key"))).filter(
        F.col("rank") <= share).select("lang", "key")
    ranked = known.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    cut = F.split("text", r"\s+")
    begin = F.pmod("key", F.greatest(F.lit(1), F.size("words") - SAMPLE_WORDS)).cast("int") + 1
    rows = ranked.withColumn("words", cut).select(
        "lang", F.array_join(F.slice("words", begin, F.lit(SAMPLE_WORDS)), " ").alias("text"))
    return sorted((r.lang, r.text) for r in rows.collect())


class Labeller:
    """Marginals for the words of texts; emissions of words are remembered within a task."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(field.languages)), np.float32)

    def _ids(self, documents: list[list[str]]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED * _MANY // max(_MANY, len(self.field.languages)):
            known.clear()
            self.rows = self.rows[:0]
        fresh = list(dict.fromkeys(w for words in documents for w in words if w not in known))
        if fresh:
            for w in fresh:
                known[w] = len(known)
            added = [self.field.weights[feature_table(fresh[a:a + 4096], self.field.lexicon)].sum(1) for a in range(0, len(fresh), 4096)]
            self.rows = np.concatenate((self.rows, *added))
        return np.array([known[w] for words in documents for w in words], np.int64)

    def means(self, documents: list[list[str]], keep: bool = False):
        """Mean marginals per document (all with words), or with ``keep`` the marginals of every word instead."""
        ids = self._ids(documents)
        sizes = np.array([len(d) for d in documents])
        begin = np.concatenate(([0], np.cumsum(sizes)))
        order = np.argsort(sizes, kind="stable")
        cells = _GROUP_CELLS * _MANY // max(_MANY, len(self.field.languages))
        out: list = [None] * len(documents)
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and (upto - at + 1) * sizes[order[upto]] <= cells and upto - at < 4096:
                upto += 1
            group = order[at:upto]
            steps = int(sizes[group[-1]])
            place = begin[group][None, :] + np.minimum(np.arange(steps)[:, None], sizes[group][None, :] - 1)
            found, _ = marginals(self.rows[ids[place]].astype(float), sizes[group], self.field.transitions, self.field.start)
            total = found.sum(0) / sizes[group][:, None]
            for j, i in enumerate(group.tolist()):
                out[i] = found[:sizes[i], j] if keep else total[j]
            at = upto
        return out


def identify(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced), from the text alone.

    lang_pred is ``und`` with score 0 for a null text, a text without letters, or if the field knows no language. Ties go to the
    first language by name. Every row is kept; whole texts are read.
    """
    model = docs.sparkSession.sparkContext.broadcast((field.languages, field.weights, field.transitions, field.start, field.lexicon))

    @F.pandas_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(Field(*model.value))
        names = labeller.field.languages
        for texts in batches:
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            held, where, size = [], [], 0

            def flush():
                for i, mean in zip(where, labeller.means(held), strict=True):
                    best = int(mean.argmax())
                    langs[i], scores[i] = names[best], min(1.0, float(mean[best]))

            for i, text in enumerate(texts):
                words = words_of(text) if text and names else []
                if words:
                    held.append(words)
                    where.append(i)
                    size += len(words)
                if size > 400_000:
                    flush()
                    held, where, size = [], [], 0
            if held:
                flush()
            yield pd.DataFrame({"lang": langs, "score": scores})
        del labeller
        release_memory()

    run_col = run(F.col(text_col).cast("string"))
    return docs.withColumn("_found", run_col).withColumn("lang_pred", F.col("_found.lang")).withColumn("score", F.col("_found.score")).drop("_found")


def label_words(texts: list[str], field: Field) -> list[list[tuple[str, str, float]]]:
    """(word, language, probability) for the words of some texts: the labels behind :func:`identify`."""
    labeller = Labeller(field)
    documents = [words_of(t) for t in texts]
    full = [d for d in documents if d]
    found = iter(labeller.means(full, keep=True) if full else [])
    return [[(w, field.languages[int(p.argmax())], float(p.max())) for w, p in zip(d, next(found), strict=True)] if d else [] for d in documents]


def fit_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Field:
    """A field fitted to the bounded sample of ``docs``; rows without language or letters teach nothing."""
    return fit(sample(docs, text_col, lang_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id leaves 2 when divided by 4."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2
