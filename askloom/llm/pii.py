"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation-maximisation
estimates how reliable each labeler is, and a logistic span classifier is trained on the resulting probabilities.

Built-in column functions only. Texts are searched where they lie; candidates are few, and the votes are counted by pattern before
anything reaches the driver: at most 7 kinds, 3^4 vote patterns and 4 lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.llm.common import store

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "local_phone", "ssn", "iban")
LABELERS = ("regex", "gazetteer", "context", "border")
CONTEXT = 48
"""Code points on either side of a candidate that the labelers see."""
ACCEPT = 0.5
ROUNDS = 30

# fixed values: the base patterns of the contract; possessive forms and look-behinds only keep long runs linear
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
}
# fixed values: public gazetteers
_TOP_DOMAINS = "com org net edu gov int info biz io eu de fr es it nl at ch be pl uk us ca au jp cn in br ru".split()
_CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420 421".split()
_IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR".split()
_CONTEXT_WORDS = {
    "email": r"e-?mail|mail|contact|kontakt|correo|courriel|reach|write", "ip": r"\bip\b|address|adresse|host|server|login|client",
    "card": r"card|visa|master|credit|karte|carte|tarjeta|payment", "phone": r"phone|tel|call|mobile|fax|handy|numéro|teléfono",
    "local_phone": r"phone|tel|call|mobile|fax|handy|numéro|teléfono", "ssn": r"ssn|social|security|sozial|sécu|seguro",
    "iban": r"iban|account|konto|compte|cuenta|bank",
}
_AGAINST = r"version|isbn|issn|order|invoice|sku|serial|part\s*no|example\s*id|rechnung|facture|pedido"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + _luhn_digit(F.get(places, i - 1).cast("int"), i))
    return total % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.coalesce(F.when(i % 2 == 0, doubled).otherwise(d), F.lit(0))


def iban_remainder(text: Column) -> Column:
    """Remainder modulo 97 of an IBAN without spaces, letters counting 10 to 35."""
    turned = F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(signs, F.lit(0), lambda s, c: F.when(F.ascii(c) >= 65, s * 100 + _place(c)).otherwise(s * 10 + _place(c)) % 97)


def _place(c: Column) -> Column:
    return F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (F.when(kind == "email", F.lit(True))
            .when(kind == "ip", match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(8, 15))
            .when(kind == "iban", iban_remainder(F.regexp_replace(match, " ", "")) == 1)
            .otherwise(True))


def _found(text: Column, kind: str) -> Column:
    """The matches of one kind with the text before each and a piece of the text behind."""
    pattern = _PATTERNS[kind]
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n = F.size(matches)
    zipped = F.arrays_zip(F.slice(pieces, 1, n).alias("before"), F.slice(pieces, 2, n).alias("behind"), matches.alias("match"))
    rows = F.transform(zipped, lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("number"), F.length(z["before"]).alias("gap"), z["match"].alias("match"),
        F.substring(z["before"], -CONTEXT, CONTEXT).alias("left"), F.substring(z["behind"], 1, CONTEXT).alias("right")))
    return F.when(n > 0, rows)


_QUICK = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
          "local_phone": r"[0-9]{3}[.-][0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a row by id and text; rows that agree in both have the same spans."""
    parts = [F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull()]
    return [F.xxhash64(*parts).alias("key1"), F.hash(F.reverse(F.col(text_col).cast("string")), F.col(id_col)).alias("key2")]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key1, key2, kind, start, end, match, left, right): spans that pass their kind's test; a failing match hides what it covers.

    A span of a further kind that overlaps one of a base kind is left out.
    """
    digit = F.col("text").rlike("[0-9@]")
    base = docs.select(*_keys(id_col, text_col), F.col(text_col).cast("string").alias("text")).filter(digit)
    found = [F.when(F.col("text").rlike(_QUICK[k]), _found(F.col("text"), k)) for k in KINDS]
    rows = base.select("key1", "key2", F.flatten(F.filter(F.array(*found), lambda a: a.isNotNull())).alias("all")).filter(F.size("all") > 0)
    rows = rows.dropDuplicates(["key1", "key2"]).select("key1", "key2", F.explode("all").alias("c")).select("key1", "key2", "c.*")
    order = W.partitionBy("key1", "key2", "kind").orderBy("number")
    length = F.length("match")
    end = F.sum(F.col("gap") + length).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - length).filter(_valid(F.col("kind"), F.col("match")))
    is_base = F.col("kind").isin(*BASE_KINDS)
    by_place = W.partitionBy("key1", "key2").orderBy("start", "end")
    reach = F.max(F.when(is_base, F.col("end"))).over(by_place.rowsBetween(W.unboundedPreceding, W.currentRow))
    back = W.partitionBy("key1", "key2").orderBy(F.desc("end"), F.desc("start"))
    next_start = F.min(F.when(is_base, F.col("start"))).over(back.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("reach", reach).withColumn("next", next_start)
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    return rows.filter(is_base | free).select("key1", "key2", "kind", "start", "end", "match", "left", "right")


def votes(spans: DataFrame) -> DataFrame:
    """``spans`` with one column per labeler: 1 for personal data, -1 against, 0 for no opinion; and the length class ``long``."""
    kind, match, digits = F.col("kind"), F.col("match"), _digits(F.col("match"))

    def either(good: Column) -> Column:
        return F.when(good, 1).otherwise(-1)

    regex = (F.when(kind == "email", either(match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$")))
             .when(kind == "ip", either(~match.rlike(r"(?:^|\.)0[0-9]")))
             .when(kind == "card", either(match.rlike(r"^[0-9]{16,19}$|^[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}$")))
             .when(kind == "ssn", either(~match.rlike(r"^(?:000|666|9)|-00-|-0000$")))
             .when(kind == "phone", either(digits.rlike(r"^[1-9][0-9]{7,14}$"))).otherwise(1))
    gazetteer = (F.when(kind == "email", either(F.lower(F.regexp_extract(match, r"\.([A-Za-z0-9-]+)$", 1)).isin(*_TOP_DOMAINS)))
                 .when(kind == "ip", F.when(match.rlike(r"^(?:0|127|255)\."), -1).otherwise(0))
                 .when(kind == "card", either(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)")))
                 .when(kind == "phone", either(digits.rlike("^(?:" + "|".join(_CALLING) + ")")))
                 .when(kind == "iban", either(F.substring(match, 1, 2).isin(*_IBAN_COUNTRIES))).otherwise(0))
    near = F.lower(F.concat_ws(" ", "left", "right"))
    context = F.when(F.lower("left").rlike(_AGAINST), -1)
    for k in KINDS:
        context = context.when((kind == k) & near.rlike(_CONTEXT_WORDS[k]), 1)
    border = F.when(F.col("left").rlike(r"[A-Za-z0-9]$") | F.col("right").rlike(r"^[A-Za-z0-9@]"), -1).otherwise(1)
    size = F.least(F.floor(F.length(match) / 8), F.lit(3)).cast("int")
    return spans.withColumns({"regex": regex, "gazetteer": gazetteer, "context": context.otherwise(0), "border": border, "long": size})


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict[str, float], list[dict[tuple[bool, int], float]]]:
    """Prior per kind and, per labeler, the probability of each vote given the truth, by expectation-maximisation over pattern counts."""
    prior = {k: 0.8 for k, _, _ in counts}
    table = [{(True, 1): 0.7, (True, 0): 0.2, (True, -1): 0.1, (False, 1): 0.2, (False, 0): 0.3, (False, -1): 0.5} for _ in LABELERS]
    for _ in range(ROUNDS):
        weight = [{key: 1.0 for key in t} for t in table]
        yes, total = {k: 4.0 for k in prior}, {k: 5.0 for k in prior}
        for kind, vote, n in counts:
            p = posterior(prior[kind], table, vote)
            yes[kind] += n * p
            total[kind] += n
            for j, v in enumerate(vote):
                weight[j][True, v] += n * p
                weight[j][False, v] += n * (1 - p)
        prior = {k: yes[k] / total[k] for k in prior}
        table = [{(t, v): w[t, v] / sum(w[t, u] for u in (1, 0, -1)) for t, v in w} for w in weight]
    return prior, table


def posterior(prior: float, table: list[dict[tuple[bool, int], float]], vote: tuple[int, ...]) -> float:
    yes = math.log(prior) + sum(math.log(t[True, v]) for t, v in zip(table, vote, strict=True))
    no = math.log(1 - prior) + sum(math.log(t[False, v]) for t, v in zip(table, vote, strict=True))
    return 1 / (1 + math.exp(min(700.0, no - yes)))


def features(kind: str, vote: tuple[int, ...], size: int) -> list[str]:
    return ["bias", f"kind {kind}", f"long {size}", *[f"{name} {v}" for name, v in zip(LABELERS, vote, strict=True)]]


def fit_classifier(rows: list[tuple[str, tuple[int, ...], int, int]]) -> dict[str, float]:
    """Weights of the span classifier from (kind, votes, length class, count), with the labelers' joint probability as the target."""
    merged: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, vote, _, n in rows:
        merged[kind, vote] = merged.get((kind, vote), 0) + n
    prior, table = reliabilities([(k, v, n) for (k, v), n in sorted(merged.items())])
    weights = {name: 0.0 for kind, vote, size, _ in rows for name in features(kind, vote, size)}
    total = sum(n for *_, n in rows) or 1
    squares = dict.fromkeys(weights, 1e-6)
    cases = [(features(k, v, s), posterior(prior[k], table, v), n / total) for k, v, s, n in rows]
    for _ in range(300):
        gradient = {name: 1e-4 * w for name, w in weights.items()}
        for names, target, share in cases:
            gap = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[x] for x in names))))) - target
            for x in names:
                gradient[x] += share * gap
        for x, g in gradient.items():
            squares[x] += g * g
            weights[x] -= 0.3 * g / math.sqrt(squares[x])
    return weights


def scored_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key1, key2, pii) of the rows that have spans."""
    voted = store(votes(candidates(docs, id_col, text_col)), "pii-votes")
    counted = voted.groupBy("kind", *LABELERS, "long").count().collect()
    weights = fit_classifier(sorted((r["kind"], tuple(r[x] for x in LABELERS), r["long"], r["count"]) for r in counted))
    listed = F.create_map(*[x for name, w in sorted(weights.items()) for x in (F.lit(name), F.lit(w))]) if weights else F.create_map(F.lit(""), F.lit(0.0))
    names = [F.lit("bias"), F.concat(F.lit("kind "), F.col("kind")), F.concat(F.lit("long "), F.col("long")),
             *[F.concat(F.lit(f"{x} "), F.col(x)) for x in LABELERS]]
    logit = sum((F.coalesce(F.element_at(listed, n), F.lit(0.0)) for n in names), F.lit(0.0))
    scored = voted.withColumn("score", F.round(1 / (1 + F.exp(-logit)), 6)).filter(F.col("kind").isin(*BASE_KINDS) | (F.col("score") >= ACCEPT))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    grouped = scored.groupBy("key1", "key2").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "score"))).alias("all"))
    return grouped.select("key1", "key2", F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                                                  s["end"].alias("end"), s["score"].alias("score"))).alias("pii"))


_EMPTY = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, pii): for every row the spans (kind, start, end, score), by kind as listed and then by start.

    Spans of the base kinds (email, ip, card, phone) always stay and carry the classifier's score; spans of further kinds (local_phone,
    ssn, iban) are added where the classifier gives at least ``ACCEPT``. Code points, end exclusive. A null or empty text has no spans.
    Every row gives one row, repeated ones too. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col), *_keys(id_col, text_col))
    return rows.join(scored_spans(docs, id_col, text_col), ["key1", "key2"], "left").select(id_col, F.coalesce("pii", F.array().cast(_EMPTY)).alias("pii"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; of overlapping spans the one that begins first is written.

    Rows and columns stay as they are otherwise; a null text stays null.
    """
    spans = F.sort_array(F.transform(F.col("_pii"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def add(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        parts = F.when(inside, state["parts"]).otherwise(F.concat(state["parts"], F.array(
            F.substring(F.col(text_col), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")),
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))
        return F.struct(parts.alias("parts"), F.greatest(state["at"], -s["back"]).alias("at"))

    def close(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(F.col(text_col), (state["at"] + 1).cast("int"), 2147483647))

    keyed = docs.select("*", *[k.alias(f"_{n}") for k, n in zip(_keys(id_col, text_col), ("key1", "key2"), strict=True)])
    found = scored_spans(docs, id_col, text_col).withColumnsRenamed({"key1": "_key1", "key2": "_key2", "pii": "_pii"})
    joined = keyed.join(found, ["_key1", "_key2"], "left")
    clean = F.when(F.col("_pii").isNull(), F.col(text_col)).otherwise(F.aggregate(spans, start, add, close))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
