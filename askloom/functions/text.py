"""Text columns: cleaning, token counts, terms, splitting. Column in, Column out, all JVM side."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns, separators and budgets that decide the results ----
BLANKS = "".join(map(chr, range(0x21)))
CONTROL_CHARS = r"[\x00-\x1F\x7F-\x9F]"
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
# Letters and digits but Han characters, in a form whose test is short: Latin-1 one by one, which Java keeps as bits, then what no other category holds.
LATIN_WORD = "".join(rf"\x{i:02X}" for i in range(256) if unicodedata.category(chr(i))[0] in "LN")
WORD_CHARS = rf"{LATIN_WORD}[\x{{100}}-\x{{10FFFF}}&&[^{HAN}\p{{M}}\p{{Z}}\p{{S}}\p{{P}}\p{{C}}]]"
WORD = rf"[{WORD_CHARS}]+"
CONTROLS = "".join(rf"\x{i:02X}" for i in range(256) if unicodedata.category(chr(i)) == "Cc")
# A word run with the control characters inside it and the blanks after it, or blanks alone; what it does not match is a token by itself.
COUNTED = rf"([{WORD_CHARS}])[{CONTROLS}{WORD_CHARS}]*+[{CONTROLS}\x20]*+|[{CONTROLS}\x20]++"
TOKEN = rf"[{HAN}]|{WORD}|[^\s\p{{L}}\p{{N}}]"
TERM = rf"[{HAN}]+|{WORD}"
SEPARATORS = ("\n\n", "\n", "。", "，")
SENTENCE_ENDS = "。！？!?"
SPECIAL_TOKENS = 2
SHINGLE = 10
MIN_HARD_CUT = 20
HEADING_STYLE = r"(?:heading|标题)\s*(\d)"
CITATION = r"\[(\d+)]"
# ---- end of fixed values ----


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_controls(c: Column) -> Column:
    """Strip blanks and control characters from both ends, as a document product trims."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(trim_controls(c)) == 0, F.lit(True))


def sanitize(c: Column) -> Column:
    """Drop control characters, newlines and tabs included."""
    return F.regexp_replace(c, CONTROL_CHARS, "")


def pretokenize(c: Column, lower: bool = True) -> Column:
    """Han characters, letter/digit runs and other visible characters, in order."""
    clean = sanitize(c)
    return F.regexp_extract_all(F.lower(clean) if lower else clean, F.lit(TOKEN), F.lit(0))


def count_tokens(c: Column) -> Column:
    """Tokens of a text with the two special tokens; 0 for empty or null.

    In one pass every word run is replaced by its first letter while spaces and control characters are dropped, so the length is the
    number of tokens; no token array is built.
    """
    n = F.length(F.regexp_replace(c, COUNTED, "$1"))
    return F.when(c.isNull() | (F.length(c) == 0), F.lit(0)).otherwise(n + F.lit(SPECIAL_TOKENS))


def segment_terms(c: Column) -> Column:
    """Search terms: lower-cased letter/digit runs; a Han run gives its characters and its bigrams."""
    def parts(run: Column) -> Column:
        n = F.length(run)
        chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                                          lambda i: F.substring(run, i, F.lit(2)))).otherwise(
            F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{HAN}]"), F.concat(chars, pairs)).otherwise(F.array(run))

    def terms(clean: Column) -> Column:
        runs = F.regexp_extract_all(clean, F.lit(TERM), F.lit(0))
        # a text without Han characters has its runs for terms
        return F.when(clean.rlike(f"[{HAN}]"), F.flatten(F.transform(runs, parts))).otherwise(runs)

    return let(F.lower(F.coalesce(sanitize(c), F.lit(""))), terms)


def snippet(c: Column, n: int) -> Column:
    """Whitespace collapsed, trimmed, cut to ``n`` characters with an ellipsis."""
    return let(trim_controls(F.regexp_replace(c, r"\s+", " ")),
               lambda s: F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n), F.lit("…"))))


def shingles(c: Column, n: int = SHINGLE) -> Column:
    """Distinct character n-grams of the text without its whitespace; empty when shorter than ``n``.

    One pass of a look-ahead match finds them all; cutting by position would scan the text once per gram.
    """
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    return F.array_distinct(F.regexp_extract_all(flat, F.lit(rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{n - 1}}}))"), F.lit(1)))


def coverage(a: Column, b: Column) -> Column:
    """Share of the smaller shingle set found in the larger one; 0 when one is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def keep_separator_split(c: Column, sep: str) -> Column:
    return F.split(c, r"(?<=\Q" + sep + r"\E)", -1)


def counted(parts: Column) -> Column:
    """Array of texts to array of struct(text, tokens) without the blank ones."""
    return F.transform(F.filter(parts, lambda t: ~is_blank(t)),
                       lambda t: F.struct(t.alias("text"), count_tokens(t).alias("tokens")))


def split_to_budget(text: Column, budget: int, separators: Sequence[str] = SEPARATORS, tokens: Column | None = None) -> Column:
    """Parts of at most ``budget`` tokens, as array of struct(text, tokens): each separator in turn on what is
    still too long, then cuts of equal width. A part is counted once, the whole text not at all if its ``tokens`` are given."""
    def refine(sep: str) -> Callable[[Column], Column]:
        return lambda t: F.when(t["tokens"] <= budget, F.array(t)).otherwise(
            counted(keep_separator_split(t["text"], sep)))

    parts = counted(F.array(text)) if tokens is None else F.filter(
        F.array(F.struct(text.alias("text"), tokens.alias("tokens"))), lambda t: ~is_blank(t["text"]))
    for sep in separators:
        parts = F.flatten(F.transform(parts, refine(sep)))
    return F.flatten(F.transform(parts, lambda t: F.when(t["tokens"] <= budget, F.array(t)).otherwise(
        counted(hard_cut(t["text"], t["tokens"], budget)))))


def windows(text: Column, step: Column, width: Column) -> Column:
    """Cuts of ``width`` characters that start every ``step`` characters, found in one pass over the text."""
    pattern = F.concat(F.lit("(?s)(?=(.{1,"), width.cast("string"), F.lit("})).{1,"), step.cast("string"), F.lit("}"))
    return F.regexp_extract_all(text, pattern, F.lit(1))


def hard_cut(text: Column, tokens: Column, budget: int) -> Column:
    """Cuts of one width in characters, the width estimated from characters per token."""
    width = F.greatest((F.length(text).cast("double") / F.greatest(tokens, F.lit(1)) * budget).cast("int"),
                       F.lit(MIN_HARD_CUT))
    return let(width, lambda w: windows(text, w, w))


def tail_sentences(text: Column, budget: int, sentence_ends: str = SENTENCE_ENDS) -> Column:
    """Last whole sentences of ``text`` within ``budget`` tokens: struct(text, tokens)."""
    sentences = F.reverse(F.filter(F.transform(F.split(text, f"(?<=[{sentence_ends}])", -1), trim_controls),
                                   lambda s: F.length(s) > 0))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("tokens"), F.lit(False).alias("full"))

    def back(acc: Column, s: Column) -> Column:
        stop = F.struct(acc["text"].alias("text"), acc["tokens"].alias("tokens"), F.lit(True).alias("full"))
        return F.when(acc["full"], acc).otherwise(let(count_tokens(s), lambda n: F.when(
            acc["tokens"] + n > budget, stop).otherwise(F.struct(
                F.concat(s, acc["text"]).alias("text"), (acc["tokens"] + n).alias("tokens"),
                F.lit(False).alias("full")))))

    return F.aggregate(sentences, start, back)


def heading_style_level(style: Column) -> Column:
    """Level named by a paragraph style, at most 4; 0 when the style is no heading."""
    digit = F.regexp_extract(F.lower(F.coalesce(style, F.lit(""))), HEADING_STYLE, 1)
    return F.when(digit == "", F.lit(0)).otherwise(F.least(digit.cast("int"), F.lit(4)))


def base_name(name: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "/", -1)


def extension(name: Column) -> Column:
    """Lower-case extension of a base name; null when it has none."""
    return F.nullif(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.lit(""))


def citation_numbers(answer: Column) -> Column:
    """All ``[n]`` marks of an answer in order, repeats kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1)),
                       lambda d: d.cast("bigint"))
