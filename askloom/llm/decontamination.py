"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Only built-in column functions run. A window counts as many words as an item and is laid at every place of a document where it covers
as many shingles of five words from items of that length as the wanted similarity takes, in whatever order they stand. Equal windows of
all documents are one window. A window and an item whose 64-bit SimHashes differ in at most ``RADIUS`` bits agree up to ``RADIUS // BLOCKS`` bits in at
least one of ``BLOCKS`` blocks; items are listed under every value that near of each block, so a window finds all of them by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import SHINGLE_WORDS, store

SIMILARITY = 0.8
BLOCKS = 8
RADIUS = 23
"""Two texts of weighted similarity 0.8 differ in 9.7 bits on average, with a standard deviation of 2.9."""
BROADCAST_ROWS = 1_000_000
"""Most item shingles (at 24 bytes) that are sent to all tasks; a larger benchmark is joined by shuffling."""

_WHITE = r"[ \t\n\x0B\f\r]+"
_WIDTH = 64 // BLOCKS


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WHITE), lambda w: w != "")


def shingle_tuples(w: Column) -> Column:
    """Array of the runs of five words; empty for fewer words."""
    n = F.greatest(F.size(w) - (SHINGLE_WORDS - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(w, j + 1, n).alias(f"w{j}") for j in range(SHINGLE_WORDS)])


def tuple_hash(t: Column) -> Column:
    return F.xxhash64(*[t[f"w{j}"] for j in range(SHINGLE_WORDS)])


def _hashes(w: Column) -> Column:
    return F.transform(shingle_tuples(w), tuple_hash)


def simhash(column: str) -> Column:
    """64-bit SimHash of an array of hashes; a hash that occurs more often weighs more."""
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(if(
        aggregate({column}, 0, (s, h) -> s + if((shiftrightunsigned(h, b) & 1L) = 1L, 1, -1)) > 0, 1L, 0L), b))""")


def _near_values() -> list[int]:
    """Bit masks of at most ``RADIUS // BLOCKS`` bits in a block."""
    return [m for m in range(1 << _WIDTH) if m.bit_count() <= RADIUS // BLOCKS]


def _block(fingerprint: str, block: str) -> str:
    return f"CAST(shiftrightunsigned({fingerprint}, {block} * {_WIDTH}) & {(1 << _WIDTH) - 1}L AS INT)"


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of the smaller over the sum of the larger counts of two arrays of hashes."""
    common = f"""aggregate(array_intersect({a}, {b}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"""
    return F.expr(f"CAST({common} AS DOUBLE) / (size({a}) + size({b}) - {common})")


def _in_step(a: str, b: str) -> dict[str, Column]:
    """Whether a hash of ``a`` stands in ``b`` at the same place, there or later, there or earlier."""
    some = f"exists(sequence(0, size({a}) - 1), j -> %s)"
    return {"level": F.expr(some % f"j < size({b}) AND {b}[j] = {a}[j]"), "ahead": F.expr(some % f"array_contains(slice({b}, j + 1, size({b})), {a}[j])"),
            "behind": F.expr(some % f"array_contains(slice({b}, 1, j + 1), {a}[j])")}


def _least_common() -> Column:
    """Fewest shingles that a window of ``m`` words shares with an item of ``n`` words at the wanted similarity."""
    return F.greatest(F.lit(1), F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("m") - 2 * (SHINGLE_WORDS - 1)) - 1e-6).cast("int"))


def _starts() -> Column:
    """Every start of ``m`` words, of ``size`` in the text, over ``least`` of the ascending ``places`` or more; ascending and distinct."""
    last = "least(places[i], size - m)"
    first = f"greatest(0, places[i + least - 1] - (m - {SHINGLE_WORDS}), if(i > 0, least(places[i - 1], size - m) + 1, 0))"
    return F.expr(f"""flatten(transform(sequence(0, size(places) - least),
        i -> if({first} <= {last}, sequence({first}, {last}), CAST(array() AS ARRAY<INT>))))""")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(``id_col``, ``item_col``, similarity, start_word, n_words): every document with a window like an item, its best window.

    Every window of an item's length is considered. Of equally similar windows the first of those is named that begin where the item would, counted
    from a shingle of both (or as near as the text allows), else the first. Words are lower-cased and parted by ASCII white space. A null or empty text or item and
    an item of fewer than five words match nothing. Rows that repeat an id are one document with several texts; items that repeat
    an id likewise. Null ids are left out. Other columns are ignored. An empty table on either side gives no rows.
    """
    items = store(benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w")).filter(
        F.col("item").isNotNull() & (F.size("w") >= SHINGLE_WORDS)).distinct().select(
        "item", F.size("w").alias("n"), _hashes(F.col("w")).alias("item_hashes")).withColumn(
        "item_print", simhash("item_hashes")).withColumn("item_key", F.xxhash64("item", "item_hashes")), "benchmark")
    marks = items.select("n", F.explode("item_hashes").alias("hash")).distinct()
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    text = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"), words(F.col(text_col)).alias("w")).filter(F.col("doc").isNotNull())
    at = text.select("doc", "text_key", F.size("w").alias("size"), F.posexplode(shingle_tuples(F.col("w"))).alias("pos", "run"))
    hits = at.select("doc", "text_key", "size", "pos", tuple_hash(F.col("run")).alias("hash")).join(marks, "hash")
    held = hits.groupBy("doc", "text_key", "size", "n").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    held = held.withColumn("m", F.least("n", "size")).withColumn("least", _least_common()).filter(F.size("places") >= F.col("least"))
    placed = store(held.select("doc", "text_key", "n", _starts().alias("starts")).filter(F.size("starts") > 0), "window-places")
    laid = text.join(placed, ["doc", "text_key"]).select("doc", "n", F.explode(F.expr(
        "transform(starts, s -> struct(s AS start, s >= size(w) - n AS last, array_join(slice(w, s + 1, n), ' ') AS content))")).alias("window"))
    laid = laid.select("doc", "n", "window.*")
    laid = laid.groupBy("doc", "n", "start", "last", "content").agg(F.count("*").alias("_hits")).drop("_hits")
    laid = store(laid.withColumn("window_key", F.xxhash64("content", F.lit(1))), "windows")

    windows = laid.groupBy("n", "content").agg(F.first("window_key").alias("window_key")).select(
        "n", "window_key", _hashes(F.split("content", " ")).alias("hashes")).withColumn("print", simhash("hashes"))
    windows = store(windows, "window-prints")
    listed = items.select("item_key", "item_print", "n", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")).select(
        "item_key", "item_print", "n", "block", F.explode(F.array(*[F.lit(m) for m in _near_values()])).alias("mask")).select(
        "item_key", "item_print", "n", "block", (F.expr(_block("item_print", "block")).bitwiseXOR(F.col("mask"))).alias("value"))
    probes = windows.select("window_key", "print", "n", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")).select(
        "window_key", "print", "n", "block", F.expr(_block("print", "block")).alias("value"))
    near = probes.join(listed, ["n", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    near = near.select("window_key", "n", "item_key").distinct()
    checked = near.join(items.select("item_key", "item", "item_hashes"), "item_key").join(
        windows.select("window_key", "n", "hashes"), ["window_key", "n"]).withColumn(
        "similarity", weighted_similarity("hashes", "item_hashes")).filter(F.col("similarity") >= SIMILARITY)
    checked = checked.select("window_key", "n", "item", "similarity", *[c.alias(name) for name, c in _in_step("hashes", "item_hashes").items()])
    in_step = F.col("level") | (F.col("start") == 0) & F.col("ahead") | F.col("last") & F.col("behind")
    best = laid.join(checked, ["window_key", "n"]).groupBy("doc", "item").agg(
        F.max(F.struct("similarity", in_step.alias("in_step"), (-F.col("start")).alias("back"), "n")).alias("best"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("best.similarity").alias("similarity"),
                       (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.n").cast("long").alias("n_words"))
