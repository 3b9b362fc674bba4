"""Audit of how filters interact: one stored id table per filter, joined with left-anti and left-semi joins.

Which documents survive a prefix of an order depends only on the set of its filters. So with k filters there are 2^k prefix sets, and k * 2^(k-1)
pairs of a prefix set and a next filter; every order is read off these. All pairs are answered by one join each: the ids that fail the next filter, spread over
the prefix sets without it, left-anti (left-semi) the ids that fail a filter of the set are the removals (redundancies). Spreading happens behind the
exchange by id, so each id table is shuffled once whatever the number of filters.

Rows. A document is identified by its id and text (null: empty); rows that repeat both are counted with their multiplicity. Null ids are documents like
others, but are no copy of, and have no copy in, any other row, as no id is smaller or larger than null. A null part is the empty string.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm.common import store

# ---- fixed values ----
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
JUNK = "[#$%&*|]"
# ---- end of fixed values ----

MOST_FILTERS = 6
"""Orders are listed in full: 720 of six filters for each part."""
ID_BYTES = 16


def document_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits that tell rows apart by id and text (null text: empty)."""
    return F.substring(F.unhex(F.sha2(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))), 256)), 1, ID_BYTES)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text: too few words, too many repeated words, too many capitals, junk characters."""
    words = F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(JUNK),
    }


def later_copies(rows: DataFrame, doc_id: str = "doc_id", text_key: str = "text_key") -> DataFrame:
    """Rows whose text a smaller id has: all with an id but the first of their text.

    The firsts are taken away by text and id together, so the rows of a text with a third of all copies are spread by their ids.
    """
    firsts = rows.groupBy(text_key).agg(F.min(doc_id).alias(doc_id))
    return rows.filter(F.col(doc_id).isNotNull()).join(firsts, [text_key, doc_id], "left_anti")


def failing_tables(documents: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All ids (id, doc_id, part, n) and per filter the stored table of those that fail it; texts are read once, in the first pass."""
    text = F.coalesce("text", F.lit(""))
    judged = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).select(
        document_id().alias("id"), "doc_id", "part", F.substring(F.unhex(F.sha2("text", 256)), 1, ID_BYTES).alias("text_key"),
        *[fails.alias(f) for f, fails in text_filters(F.col("text")).items()])
    letters = judged.columns[4:]
    rows = store(judged.groupBy(*judged.columns).agg(F.count(F.lit(1)).alias("n")), "audit-ids")
    ids = ["id", "doc_id", "part", "n"]
    tables = {f: store(rows.filter(f).select(*ids), f"audit-fails-{f}") for f in letters}
    tables["E"] = store(later_copies(rows).select(*ids), "audit-fails-E")
    return rows.select(*ids), tables


def labelled_tables(fails: Mapping[str, DataFrame], labels: Mapping[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """Per label and filter the failing ids that carry the label; ``labels`` are tables of doc_id."""
    return {name: {f: ids.join(chosen, "doc_id", "left_semi") for f, ids in fails.items()} for name, chosen in labels.items()}


def audit(ids: DataFrame, fails: Mapping[str, DataFrame], labels: Mapping[str, DataFrame]) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, one ``<label>_lost`` per label, shapley.

    ``ids`` and every table of ``fails`` have (id, doc_id, part, n), one row per id and part; a failing id is one of ``ids``. Every part of ``ids`` has all its rows,
    zeros included; an empty table has none. ``shapley`` is the number of removals by the step's filter, summed over all orders.
    """
    letters = list(fails)
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} filters can be audited")
    bits = {f: 1 << i for i, f in enumerate(letters)}
    full = (1 << len(letters)) - 1

    def tagged(tables: Mapping[str, DataFrame], kind: str) -> DataFrame:
        parts = [t.select("id", "part", "n", F.lit(bits[f]).alias("bit"), F.lit(kind).alias("kind")) for f, t in tables.items()]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        return whole

    every = tagged(fails, "all")
    blocks = every.select("id", F.col("bit").alias("blocked")).repartition("id").alias("b")

    def met(rows: DataFrame, how: str) -> DataFrame:
        """Rows (id, prefix, ...) that no filter (left_anti) or some filter (left_semi) of the prefix set removes."""
        return rows.alias("r").join(blocks, (F.col("r.id") == F.col("b.id")) & (F.col("r.prefix").bitwiseAND(F.col("b.blocked")) != 0), how)

    def spread(rows: DataFrame, without: Column) -> DataFrame:
        """Every row once per prefix set that holds no filter of ``without``; behind the exchange by id."""
        return rows.repartition("id").withColumn("prefix", F.explode(F.filter(F.array(*[F.lit(p) for p in range(full + 1)]),
                                                                             lambda p: p.bitwiseAND(without) == 0)))

    candidates = every
    for name, tables in labelled_tables(fails, labels).items():
        candidates = candidates.unionByName(tagged(tables, name))
    removed = met(spread(candidates, F.col("bit")), "left_anti").groupBy("part", "prefix", "bit", "kind").agg(F.sum("n").alias("n"))
    redundant = met(spread(every, F.col("bit")), "left_semi").groupBy("part", "prefix", "bit").agg(F.sum("n").alias("n"))
    touched = every.repartition("id").groupBy("id", "part").agg(F.max("n").alias("n"))
    survivors = met(spread(touched, F.lit(0)), "left_anti").groupBy("part", "prefix").agg(F.sum("n").alias("n"))
    untouched = ids.join(every.select("id"), "id", "left_anti").groupBy("part").agg(F.sum("n").alias("n"))

    figures = (removed.select("part", "kind", "prefix", "bit", "n")
               .unionByName(redundant.select("part", F.lit("redundant").alias("kind"), "prefix", "bit", "n"))
               .unionByName(survivors.select("part", F.lit("kept").alias("kind"), "prefix", F.lit(0).alias("bit"), "n"))
               .unionByName(untouched.select("part", F.lit("untouched").alias("kind"), F.lit(0).alias("prefix"), F.lit(0).alias("bit"), "n"))
               .unionByName(ids.select("part", F.lit("none").alias("kind"), F.lit(0).alias("prefix"), F.lit(0).alias("bit"), F.lit(0).cast("long").alias("n")).distinct()))
    known = figures.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "prefix", "bit").alias("key"), "n"))).alias("known"))

    def figure(kind: str, prefix: Column, bit: Column) -> Column:
        key = F.struct(F.lit(kind).alias("kind"), prefix.alias("prefix"), bit.alias("bit"))
        return F.coalesce(F.try_element_at("known", key), F.lit(0).cast("long"))

    steps = [{"filter_order": "".join(order), "step": i + 1, "prefix": sum(bits[f] for f in order[:i]), "bit": bits[f]}
             for order in permutations(letters) for i, f in enumerate(order)]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,prefix:int,bit:int>>")
    prefix, bit, none = F.col("s.prefix"), F.col("s.bit"), F.lit(0)
    rows = known.select("part", "known", F.explode(listed).alias("s")).select(
        "part", "s.filter_order", "s.step", bit.alias("_bit"),
        (figure("untouched", none, none) + figure("kept", prefix + bit, none)).alias("kept"),
        figure("all", prefix, bit).alias("removed"), figure("redundant", prefix, bit).alias("redundant"),
        figure("all", F.lit(full) - bit, bit).alias("unique_fails"), *[figure(name, prefix, bit).alias(f"{name}_lost") for name in labels])
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_bit"))).drop("_bit")


def audit_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``documents``; a document is good or toxic if any row of ``labels`` says so of its id."""
    ids, fails = failing_tables(documents)
    chosen = {"good": labels.filter("quality = 1").select("doc_id").distinct(), "toxic": labels.filter("toxic = 1").select("doc_id").distinct()}
    return audit(ids, fails, chosen)
