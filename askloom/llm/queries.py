"""One query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import (
    ann, decontamination, filter_audit, html_text, language_id, line_dedup, merkle, ngram_join, paragraph_dedup, pieces, pii, secrets, warc,
)
from askloom.llm.common import read
from askloom.llm.registry import query

_OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
linked AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, root) AS (SELECT a, a FROM (SELECT DISTINCT a FROM linked) UNION SELECT l.b, r.root FROM reach r JOIN linked l ON l.a = r.doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.root), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s"""


@query("op4_ngram_jaccard_join", _OP4_SQL)
def _(spark, sf):
    return ngram_join.ngram_components(read(spark, sf, "documents"))


@query("op6_paragraph_dedup")
def _(spark, sf):
    return paragraph_dedup.duplicate_paragraphs(read(spark, sf, "documents"), any_beginning=True)


_OP8_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
i AS MATERIALIZED (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5),
dt AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS t FROM dp),
ip AS (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS p FROM i WHERE len(w) >= 5),
it AS MATERIALIZED (SELECT item_id, len(w) AS n, p, array_to_string(w[p + 1:p + 5], ' ') AS t FROM ip),
laid AS MATERIALIZED (
  SELECT DISTINCT doc_id, item_id, n, greatest(0, least(dt.p - it.p, len(d.w) - n)) AS start
  FROM dt JOIN it USING (t) JOIN d USING (doc_id)),
wc AS (SELECT l.doc_id, l.item_id, l.start, l.n, dt.t, count(*) AS c FROM laid l JOIN dt ON dt.doc_id = l.doc_id AND dt.p BETWEEN l.start AND l.start + l.n - 5
       GROUP BY ALL),
ic AS (SELECT item_id, t, count(*) AS c FROM it GROUP BY ALL),
met AS (SELECT wc.doc_id, wc.item_id, wc.start, wc.n, sum(least(wc.c, ic.c)) AS common FROM wc JOIN ic USING (item_id, t) GROUP BY ALL),
scored AS (
  SELECT m.doc_id, m.item_id, m.start, m.n, common::DOUBLE / ((SELECT sum(c) FROM ic WHERE ic.item_id = m.item_id)
         + (SELECT sum(c) FROM wc WHERE wc.doc_id = m.doc_id AND wc.item_id = m.item_id AND wc.start = m.start) - common) AS similarity FROM met m)
SELECT doc_id, item_id, similarity, start AS start_word, n AS n_words FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""


@query("op8_benchmark_decontamination", _OP8_SQL)
def _(spark, sf):
    return decontamination.leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def span_digest(found: DataFrame, spans_col: str, base: tuple[str, ...]) -> DataFrame:
    """doc_id, one count per base kind, base_sha256 and spans from an array of (kind, start, end) in its listed order."""
    spans = F.col(spans_col)
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    of_base = F.filter(spans, lambda s: s["kind"].isin(*base))
    base_text = F.transform(of_base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    counts = [F.size(F.filter(spans["kind"], F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base_text, ","), 256).alias("base_sha256"), F.array_join(text, ",").alias("spans"))


@query("op2_secret_scan")
def _(spark, sf):
    return span_digest(secrets.find_secrets(read(spark, sf, "documents")), "secrets", ("assign", "access", "hex"))


_OP5_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
bits AS (SELECT page_id, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(hex, i, 1)) - 1), 4, '0')),
         lambda a, b: concat(a, b)) AS b FROM d),
coded AS (SELECT page_id, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + list_reduce(list_transform(range(1, 6), lambda j: CAST(substr(b, i * 5 + j, 1) AS INTEGER)), lambda x, y: x * 2 + y), 1)),
          lambda x, y: concat(x, y)) AS payload_digest FROM bits)
SELECT d.page_id, d.payload_bytes, c.payload_digest,
       CASE WHEN d.page_id = min(d.page_id) OVER (PARTITION BY d.hex) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> min(d.page_id) OVER (PARTITION BY d.hex) THEN min(d.page_id) OVER (PARTITION BY d.hex) END AS refers_to
FROM d JOIN coded c USING (page_id)"""


@query("op5_warc_normaliser", _OP5_SQL)
def _(spark, sf):
    archives = warc.write_archives(warc.with_record_types(read(spark, sf, "pages")))
    return warc.read_records(warc.normalise_archives(archives)).drop("url")


@query("op9_sentencepiece")
def _(spark, sf):
    return pieces.encode_and_check(read(spark, sf, "documents"))


@query("op10_language_id")
def _(spark, sf):
    docs = read(spark, sf, "documents")
    kept_out = F.coalesce(language_id.held_out(), F.lit(False))
    field = language_id.fit_documents(docs.filter(~kept_out))
    return language_id.identify(docs.select("doc_id", "text"), field).select("doc_id", kept_out.alias("held_out"), "lang_pred", "score")


@query("op7_pii")
def _(spark, sf):
    return span_digest(pii.find_pii(read(spark, sf, "documents")), "pii", pii.BASE_KINDS)


@query("op3_ann_search")
def _(spark, sf):
    vectors = read(spark, sf, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query("op1_html_text")
def _(spark, sf):
    return html_text.extract(read(spark, sf, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
judged AS MATERIALIZED (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS fails FROM words),
marked AS (
  SELECT part, fails, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS bad FROM judged),
groups AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM marked GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
  WHERE b.letter <> a.letter AND c.letter NOT IN (a.letter, b.letter) AND d.letter NOT IN (a.letter, b.letter, c.letter)
    AND e.letter NOT IN (a.letter, b.letter, c.letter, d.letter)),
steps AS (
  SELECT filter_order, step, f.bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(filter_order, g.letter) < step)::INTEGER AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s, f WHERE substr(filter_order, step, 1) = f.letter),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & (before + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n_good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n_bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM groups, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted"""


@query("op11_filter_audit", _OP11_SQL)
def _(spark, sf):
    return filter_audit.audit_documents(read(spark, sf, "documents"), read(spark, sf, "labels"))


_OP12_SQL = r"""
WITH RECURSIVE shown AS (
  SELECT doc_id, lang, doc_id::VARCHAR AS a, source AS b, n_chars::VARCHAR AS d, text AS e,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
led AS (
  SELECT *, coalesce(octet_length(encode(a))::VARCHAR || ':' || a, '-') || coalesce(octet_length(encode(b))::VARCHAR || ':' || b, '-')
         || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-') || coalesce(octet_length(encode(d))::VARCHAR || ':' || d, '-') AS head FROM shown),
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(head || coalesce(octet_length(encode(e))::VARCHAR || ':' || e, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(low))::VARCHAR || ':' || low, '-')) AS other FROM led),
bits AS (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
         FROM (SELECT unnest(range(0, 256)) AS i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits),
checked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
         lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM hashed, crc_table),
leaves AS MATERIALIZED (
  SELECT doc_id, g, leaf, CASE WHEN coalesce(crc % 3 = 0, false) THEN other ELSE leaf END AS changed,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM checked),
nodes AS (
  SELECT 0 AS lev, g, pos, total, leaf AS node FROM leaves
  UNION ALL
  SELECT lev + 1, g, pos // 8, any_value((total + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE total > 1 GROUP BY lev, g, pos // 8),
tops AS MATERIALIZED (SELECT g, node AS top, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS total FROM nodes WHERE total = 1),
upper AS (
  SELECT 0 AS lev, pos, total, top AS node FROM tops
  UNION ALL
  SELECT lev + 1, pos // 8, any_value((total + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE total > 1 GROUP BY lev, pos // 8),
steps AS MATERIALIZED (
  SELECT lev, g, pos, coalesce(string_agg(node, '') OVER (PARTITION BY lev, g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (PARTITION BY lev, g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes WHERE total > 1),
upper_steps AS MATERIALIZED (
  SELECT lev, pos, coalesce(string_agg(node, '') OVER (PARTITION BY lev, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (PARTITION BY lev, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM upper WHERE total > 1),
climbed AS (
  SELECT v.doc_id, v.g, v.pos, s.lev AS lev, s.l, s.r FROM leaves v JOIN steps s ON s.g = v.g AND s.pos = v.pos // CAST(power(8, s.lev) AS BIGINT)
  UNION ALL
  SELECT v.doc_id, v.g, v.pos, 1000 + u.lev, u.l, u.r FROM leaves v JOIN tops t ON t.g = v.g JOIN upper_steps u ON u.pos = t.pos // CAST(power(8, u.lev) AS BIGINT)),
walks AS (SELECT g, pos, list(l ORDER BY lev) AS ls, list(r ORDER BY lev) AS rs, string_agg(l || r, '' ORDER BY lev) AS proof FROM climbed GROUP BY g, pos),
whole AS (
  SELECT v.doc_id, v.leaf, t.top AS subroot, (SELECT node FROM upper WHERE total = 1) AS root, coalesce(w.proof, '') AS proof,
         list_reduce(list_prepend(v.changed, range(1, coalesce(len(w.ls), 0) + 1)::VARCHAR[]), lambda node, i: sha256(w.ls[i::INTEGER] || node || w.rs[i::INTEGER])) AS folded_root
  FROM leaves v JOIN tops t USING (g) LEFT JOIN walks w ON w.g = v.g AND w.pos = v.pos)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM whole"""


@query("op12_merkle_manifest", _OP12_SQL)
def _(spark, sf):
    return merkle.manifest(read(spark, sf, "documents"))


_OP13_SQL = r"""
WITH lines AS (
  SELECT row, doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
judged AS (SELECT row, doc_id, pos, line, length(key) >= 10 AND doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY row, doc_id"""


@query("op13_line_dedup", _OP13_SQL)
def _(spark, sf):
    docs = read(spark, sf, "documents")
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
