"""Ranking and join helpers that keep hot keys spread over many tasks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


TERM_GROWTH = 32
"""Bytes of term rows per stored byte of text, for size checks below an explode."""


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. The filter on the rank lets Spark cut each input partition to ``n`` rows
    per key before the shuffle, so a hot key costs no more than ``n`` rows per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def nth_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, keep: Sequence[str]) -> DataFrame:
    """The ``n``-th row per key, for keys that have that many; same partial cut as :func:`top_n`."""
    return top_n(df.select(*keys, *keep), keys, order, n, "_rank").filter(F.col("_rank") == n).drop("_rank")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; very large when unknown."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bytes_of(size: str) -> int:
    """Bytes of a Spark size setting such as ``10485760``, ``256k``, ``100MB`` or ``-1``."""
    found = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", size.strip().lower())
    if not found:
        raise ValueError(f"not a size: {size}")
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ")


def broadcast_limit(df: DataFrame) -> int:
    return bytes_of(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, growth: int = 1, salts: int = 16) -> DataFrame:
    """Inner equi-join with hot keys in ``big``.

    ``small`` is broadcast when its estimated size times ``growth`` (rows an explode in it adds, which the estimate
    does not know) is below the session's broadcast threshold. Otherwise both sides are shuffled: a key of ``big``
    is cut into ``salts`` shares by a hash of ``spread`` and ``small`` is repeated once per share.
    """
    if estimated_bytes(small) * growth <= broadcast_limit(big):
        return big.join(F.broadcast(small), list(on))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [*on, "_salt"]).drop("_salt")


BLOOM_BITS = 1 << 23
"""One megabyte: a million different values are let through wrongly in one of twenty cases. More values only let more through."""
_BLOOM_SHIFTS = (0, 32)


def bloom_filter(df: DataFrame, value: Column, bits: int = BLOOM_BITS) -> Column:
    """The set of ``value`` in ``df`` as a bitmap of ``bits`` (a power of two, 64 at least), to be used with :func:`might_hold` in a filter. Spark computes it once,
    adding up partial words per task; it is of fixed size whatever the table's."""
    spots = F.array(*[_bloom_spot(value, shift, bits) for shift in _BLOOM_SHIFTS])
    words = df.select(F.explode(spots).alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("held"))
    every = df.sparkSession.range(bits >> 6).withColumnRenamed("id", "word").join(words, "word", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("held", F.lit(0).cast("bigint")).alias("held"))))["held"].alias("bitmap")).scalar()


def _bloom_spot(value: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), shift).bitwiseAND(F.lit(bits - 1).cast("bigint"))


def might_hold(bitmap: Column, value: Column, bits: int = BLOOM_BITS) -> Column:
    """False only for values that are not in the set. Values are tested as rows, as a subquery cannot stand inside an array function."""
    tests = [F.get(bitmap, F.shiftright(spot, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(F.lit(63)).cast("int"))) != 0
             for spot in (_bloom_spot(value, shift, bits) for shift in _BLOOM_SHIFTS)]
    return tests[0] & tests[1]


def asked_only(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of ``postings`` whose (kb_id, term) occurs in ``terms``; dropped map-side as long as the different terms can be broadcast."""
    asked = terms.select("kb_id", "term").distinct()
    if estimated_bytes(asked) * TERM_GROWTH <= broadcast_limit(asked):
        asked = F.broadcast(asked)
    return postings.join(asked, ["kb_id", "term"], "left_semi")
