"""Queries over sources, elements and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.functions.arrays import rows_of
from askloom.operators import chunking, elements as el, indexing, pagelayout
from askloom.plans import tables as t
from askloom.plans.registry import query
from askloom.sources import corpus as src

# ---------------------------------------------------------------- sources


@query("s1_scan_corpus", "SELECT doc_id, source, lang, n_chars, length(text) AS text_chars FROM documents")
def _(spark, sf):
    return src.scan_parquet(spark, f"{sf}/documents.parquet", "doc_id", "source", "lang", "n_chars", "text").select(
        "doc_id", "source", "lang", "n_chars", F.length("text").cast("bigint").alias("text_chars"))


_JUDGED = r"""
SELECT n.doc_id, n.kb_id, n.base AS base_name, n.size_bytes,
       CASE WHEN c.at IS NOT NULL AND {'t': n.created_at, 'i': n.doc_id} > c.at THEN 'limit' WHEN n.ext IS NULL THEN 'no_extension'
            WHEN n.ext NOT IN ('pdf', 'docx', 'md', 'markdown') THEN 'type' WHEN n.size_bytes > 52428800 THEN 'size' END AS reason,
       CASE WHEN n.ext = 'markdown' THEN 'md' ELSE n.ext END AS file_type
FROM named n LEFT JOIN (
  SELECT kb_id, {'t': created_at, 'i': doc_id} AS at FROM (
    SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY created_at, doc_id) AS rn FROM named
    WHERE ext IN ('pdf', 'docx', 'md', 'markdown') AND size_bytes <= 52428800) WHERE rn = 100) c USING (kb_id)"""
t.cte("named", r"""
SELECT *, nullif(lower(regexp_extract(base, '\.([^.]+)$', 1)), '') AS ext
FROM (SELECT *, regexp_extract(replace(file_name, '\', '/'), '([^/]*)$', 1) AS base FROM manifest)""", "manifest")
t.cte("judged", _JUDGED, "named")


@query("s2_admit_documents", "SELECT doc_id, kb_id, base_name, size_bytes, file_type, reason, CAST(CASE WHEN reason = 'size' THEN 413 WHEN reason IS NOT NULL THEN 400 END AS INTEGER) AS code FROM judged", ("judged",))
def _(spark, sf):
    return src.judge_uploads(t.manifest(spark, sf)).select("doc_id", "kb_id", "base_name", "size_bytes", "file_type", "reason", "code")


@query("s3_file_name_parts", "SELECT doc_id, base AS base_name, ext FROM named", ("named",))
def _(spark, sf):
    return src.file_name_parts(t.manifest(spark, sf)).select("doc_id", "base_name", "ext")


# ---------------------------------------------------------------- text and elements
@query("e1_sanitize", r"SELECT doc_id, regexp_replace(text, '[\x00-\x1F\x7F-\x9F]', '', 'g') AS clean FROM documents")
def _(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", tx.sanitize(F.col("text")).alias("clean"))


_ELEMENT_COLUMNS = ["pos", "type", "text", "level", "page_no"]


@query("e2_markdown_elements", "SELECT doc_id, pos, type, text, level, page_no FROM elements", ("elements",))
def _(spark, sf):
    return el.explode_elements(t.elements(spark, sf), "doc_id")


@query("e3_html_elements", "SELECT page_id, pos, type, text, level, page_no FROM page_elements", ("page_elements",))
def _(spark, sf):
    return el.explode_elements(t.page_elements(spark, sf), "page_id")


@query("e4_table_rows_to_markdown", """
SELECT l_orderkey AS table_id, string_agg('| ' || p || ' | ' || q || ' | ' || f || ' |', chr(10) ORDER BY row_no) AS text
FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS p, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, l_returnflag || ' ' || l_linestatus AS f,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no FROM lineitem)
GROUP BY l_orderkey""")
def _(spark, sf):
    line = t.read(spark, sf, "lineitem")
    cells = line.select(
        F.col("l_orderkey").alias("table_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("row_no"),
        F.posexplode(F.array(F.concat(F.lit(" "), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("bigint").cast("string"),
                             F.concat("l_returnflag", F.lit("\n"), "l_linestatus"))).alias("col_no", "text"))
    return el.table_rows_to_markdown(cells, ["table_id"])


@query("e5_style_to_heading_level", """
SELECT o_orderkey AS par_id, CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE least(CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 4) END AS INTEGER) AS level FROM orders""")
def _(spark, sf):
    digit = F.substring("o_orderpriority", 1, 1)
    style = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Heading "), digit)).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("标题"), digit)).otherwise("Normal")
    return el.style_to_heading_level(t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("par_id"), style.alias("style"))).drop("style")


t.cte("runs", """
SELECT l_suppkey AS doc_id, l_linenumber AS page, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_quantity, l_orderkey, l_partkey, l_extendedprice) AS k,
       l_quantity * 0.9::DOUBLE AS y, round(8 + l_discount * 100) AS font, l_returnflag || l_linestatus AS text FROM lineitem""")
t.cte("run_lines", """
SELECT doc_id, page, k, y AS anchor, 0::BIGINT AS line FROM runs WHERE k = 1
UNION ALL
SELECT r.doc_id, r.page, r.k, CASE WHEN abs(r.y - l.anchor) <= 2.5 THEN l.anchor ELSE r.y END, CASE WHEN abs(r.y - l.anchor) <= 2.5 THEN l.line ELSE l.line + 1 END
FROM run_lines l JOIN runs r ON r.doc_id = l.doc_id AND r.page = l.page AND r.k = l.k + 1""", "runs")


@query("e6_cluster_lines", """
SELECT doc_id, page, CAST(line AS INTEGER) AS page_line, max(font) AS max_font, string_agg(text, '' ORDER BY k) AS text
FROM run_lines JOIN runs USING (doc_id, page, k) GROUP BY doc_id, page, line""", ("run_lines",))
def _(spark, sf):
    runs = t.read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.struct("l_quantity", "l_orderkey", "l_partkey", "l_extendedprice").alias("seq"),
        (F.col("l_quantity") * 0.9).alias("y"), F.round(8 + F.col("l_discount") * 100).alias("font"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return pagelayout.cluster_lines(runs)


t.cte("body_font", """
SELECT doc_id, CASE WHEN font = 0 THEN 10 ELSE font END AS body_font FROM (
  SELECT doc_id, font, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, reached) AS r FROM (
    SELECT doc_id, CAST(floor(max_font + 0.5) AS INTEGER) AS font, count(*) AS n, max(line_no) AS reached FROM full_lines GROUP BY ALL)) WHERE r = 1""", "full_lines")
t.cte("full_lines", f"SELECT * FROM page_lines WHERE {t.sql_trim('text')} <> ''", "page_lines")
t.cte("edges", r"""
SELECT doc_id, page_count, line_no, text, regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '\s+', '', 'g') AS norm FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS b FROM full_lines) WHERE a = 1
UNION BY NAME
SELECT doc_id, page_count, line_no, text, regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '\s+', '', 'g') AS norm FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS b FROM full_lines) WHERE b = 1""".replace("UNION BY NAME", "UNION ALL BY NAME"), "full_lines")
t.cte("dropped", rf"""
SELECT DISTINCT e.doc_id, e.line_no FROM edges e JOIN (SELECT doc_id, norm, count(*) AS n FROM edges GROUP BY ALL) c USING (doc_id, norm)
WHERE n >= greatest(2, ceil(page_count * 0.6)) OR (length({t.sql_trim('text')}) <= 8 AND regexp_matches({t.sql_trim('text')}, '^[0-9ivxIVX\-–—/ .]+$'))""", "edges")
_TOC = r"(regexp_matches(text, '^.*[.·…]{2,}\s*\d{1,4}\s*$') AND length(text) <= 80)"
t.cte("heading_lines", r"""
SELECT f.*, body_font, max_font > body_font * 1.15::DOUBLE AND length(text) <= 40 AND length(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g')) >= length(text) * 0.5
       AND (length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) >= 2 OR (length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) >= 4
            AND NOT regexp_matches(text, '[=+×÷^~≤≥∈∫∑|&]'))) AS is_heading
FROM full_lines f JOIN body_font USING (doc_id) ANTI JOIN dropped d ON d.doc_id = f.doc_id AND d.line_no = f.line_no""".replace("ANTI JOIN dropped d ON d.doc_id = f.doc_id AND d.line_no = f.line_no", "WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.doc_id = f.doc_id AND d.line_no = f.line_no)"), "body_font", "dropped")
t.cte("levels", """
SELECT doc_id, max_font, least(CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY max_font DESC) AS INTEGER), 4) AS level
FROM (SELECT DISTINCT doc_id, max_font FROM heading_lines WHERE is_heading)""", "heading_lines")
t.cte("para_lines", rf"""
SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM (
  SELECT *, CASE WHEN is_heading OR coalesce(lag(is_heading OR regexp_matches(text, '[。！？；：!?;:.]$')) OVER (PARTITION BY doc_id ORDER BY line_no), TRUE) THEN 1 ELSE 0 END AS starts
  FROM heading_lines WHERE NOT {_TOC})""", "heading_lines")


@query("e7_body_font_mode", "SELECT doc_id, body_font FROM body_font", ("body_font",))
def _(spark, sf):
    lines = t.page_lines(spark, sf)
    return pagelayout.body_font_mode(lines.filter(~tx.is_blank(F.col("text"))))


@query("e8_running_header_footer", "SELECT doc_id, line_no FROM dropped", ("dropped",))
def _(spark, sf):
    return pagelayout.running_header_footer(t.page_lines(spark, sf).filter(~tx.is_blank(F.col("text"))))


@query("e9_drop_toc_entries", f"SELECT doc_id, line_no, text FROM page_lines WHERE NOT {_TOC}", ("page_lines",))
def _(spark, sf):
    return pagelayout.drop_toc_entries(t.page_lines(spark, sf)).select("doc_id", "line_no", "text")


@query("e10_is_heading_line", "SELECT doc_id, line_no, is_heading FROM heading_lines", ("heading_lines",))
def _(spark, sf):
    return pagelayout.classify_lines(t.page_lines(spark, sf)).select("doc_id", "line_no", "is_heading")


@query("e11_heading_levels", "SELECT doc_id, line_no, text, level FROM heading_lines JOIN levels USING (doc_id, max_font) WHERE is_heading", ("levels",))
def _(spark, sf):
    return pagelayout.classify_lines(t.page_lines(spark, sf)).filter("is_heading").select("doc_id", "line_no", "text", "level")


@query("e12_merge_paragraphs", r"""
SELECT doc_id, CAST(block - 1 AS INTEGER) AS pos, CASE WHEN bool_or(is_heading) THEN 'HEADING' ELSE 'PARAGRAPH' END AS type,
       string_agg(CASE WHEN prev IS NULL THEN text WHEN regexp_matches(prev, '[A-Za-z0-9]$') AND regexp_matches(text, '^[A-Za-z0-9]') THEN ' ' || text ELSE text END, '' ORDER BY line_no) AS text,
       CAST(max(CASE WHEN is_heading THEN coalesce(level, 4) ELSE 0 END) AS INTEGER) AS level, arg_min(page, line_no) AS page_no
FROM (SELECT p.*, l.level, lag(text) OVER (PARTITION BY p.doc_id, block ORDER BY line_no) AS prev FROM para_lines p LEFT JOIN levels l USING (doc_id, max_font)) GROUP BY doc_id, block""",
       ("para_lines", "levels"))
def _(spark, sf):
    return pagelayout.layout_elements(t.page_lines(spark, sf))


@query("e13_element_type_counts", """
SELECT doc_id, count(*) FILTER (type = 'HEADING') AS heading, count(*) FILTER (type = 'PARAGRAPH') AS paragraph, count(*) FILTER (type = 'TABLE') AS "table",
       count(*) FILTER (type = 'LIST') AS list, count(*) FILTER (type = 'CODE') AS code FROM elements GROUP BY doc_id""", ("elements",))
def _(spark, sf):
    return el.element_type_counts(t.elements(spark, sf))


@query("e14_empty_document_guard", """
SELECT page_id, CASE WHEN e.n > 0 THEN 'READY' ELSE 'FAILED' END AS status, CASE WHEN e.n IS NULL THEN 'no text found in the document' END AS error_msg
FROM pages LEFT JOIN (SELECT page_id, count(*) AS n FROM page_elements GROUP BY ALL) e USING (page_id)""", ("page_elements",))
def _(spark, sf):
    return el.empty_document_status(t.page_elements(spark, sf), "page_id")


# ---------------------------------------------------------------- tokens and splitting
@query("c1_count_tokens", f"SELECT doc_id, CAST({t.sql_tokens('text')} AS INTEGER) AS tokens FROM documents")
def _(spark, sf):
    return t.spread(t.read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tx.count_tokens(F.col("text")).alias("tokens"))


_WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


@query("c2_pretokenize", rf"""
SELECT doc_id, CAST(len(ts) AS INTEGER) AS n, md5(array_to_string(ts, ' ')) AS tokens_md5, ts[1] AS first, ts[-1] AS last FROM (
  SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[\x00-\x1F\x7F-\x9F]', '', 'g')), '{_WORD}') AS ts FROM documents)""")
def _(spark, sf):
    docs = t.read(spark, sf, "documents").select("doc_id", tx.pretokenize(F.col("text")).alias("ts"))
    return docs.select("doc_id", F.size("ts").alias("n"), F.md5(F.array_join("ts", " ").cast("binary")).alias("tokens_md5"), F.get("ts", F.lit(0)).alias("first"), F.try_element_at("ts", F.lit(-1)).alias("last"))


@query("c3_section_path", "SELECT doc_id, pos, type, section_path, page_no FROM paths_all", ("paths_all",))
def _(spark, sf):
    return chunking.section_path(t.elements(spark, sf)).drop("text")


_CHUNK_SQL = "SELECT doc_id, strategy, chunk_index, kind, parent_index, content, token_count, section_path, page_no, is_table FROM "


@query("c4_fixed_chunks", _CHUNK_SQL + "fixed_chunks", ("fixed_chunks",))
def _(spark, sf):
    return chunking.fixed_chunks(t.elements(spark, sf))


@query("c5_split_to_budget", f"""
SELECT doc_id, CAST(n - 1 AS INTEGER) AS pos, part, CAST({t.sql_tokens('part')} AS INTEGER) AS tokens
FROM (SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS n FROM (SELECT doc_id, {t.sql_split('text', t.SEPARATORS, 64)} AS ps FROM documents))""")
def _(spark, sf):
    docs = t.spread(t.read(spark, sf, "documents").select("doc_id", "text"))
    return rows_of(docs, tx.split_to_budget(F.col("text"), 64, t.SEPARATORS), "doc_id").select(
        "doc_id", "pos", F.col("item.text").alias("part"), F.col("item.tokens").alias("tokens"))


@query("c6_hard_cut", f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INTEGER) AS pos, substr(text, b, w) AS part
FROM (SELECT doc_id, text, w, unnest(range(1, length(text) + 1, w)) AS b
      FROM (SELECT doc_id, text, greatest(CAST(floor(length(text)::DOUBLE / greatest({t.sql_tokens('text')}, 1) * 320) AS BIGINT), 20) AS w FROM documents))""")
def _(spark, sf):
    docs = t.spread(t.read(spark, sf, "documents").select("doc_id", "text"))
    return rows_of(docs, tx.hard_cut(F.col("text"), tx.count_tokens(F.col("text")), 320), "doc_id", item="part")


t.cte("line_pieces", f"""
SELECT doc_id AS grp, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, text, CAST({t.sql_tokens('text')} AS BIGINT) AS tokens, NULL::VARCHAR AS section, 1::INTEGER AS page
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE {t.sql_trim('text')} <> ''""")
t.cte("line_pack", t.sql_pack("line_pieces").replace("@SELF@", "line_pack"), "line_pieces")
t.cte("line_packed", t.sql_packed("line_pack"), "line_pack")


@query("c7_pack_pieces", "SELECT grp AS doc_id, CAST(c - 1 AS INTEGER) AS pos, content, CAST(tokens AS INTEGER) AS tokens FROM line_packed", ("line_packed",))
def _(spark, sf):
    docs = t.spread(t.read(spark, sf, "documents").select("doc_id", "text"))
    pieces = F.transform(tx.counted(F.split("text", "\n", -1)), lambda p: F.struct(
        p["text"].alias("text"), p["tokens"].alias("tokens"), F.lit(None).cast("string").alias("section"), F.lit(1).alias("page")))
    return rows_of(docs, chunking.pack_pieces(pieces, sentence_ends=t.SENTENCE_ENDS), "doc_id").select(
        "doc_id", "pos", F.col("item.text").alias("content"), F.col("item.tokens").alias("tokens"))


@query("c8_tail_sentences", f"SELECT doc_id, tail, CAST(tail_n AS INTEGER) AS tokens FROM ({t.sql_tail('SELECT doc_id, text FROM documents', 'text')})")
def _(spark, sf):
    docs = t.spread(t.read(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tx.tail_sentences(F.col("text"), 48, t.SENTENCE_ENDS).alias("s")).select(
        "doc_id", F.col("s.text").alias("tail"), F.col("s.tokens").alias("tokens"))


@query("c9_recursive_chunks", _CHUNK_SQL + "recursive_chunks", ("recursive_chunks",))
def _(spark, sf):
    return t.CHUNKERS["RECURSIVE"](t.elements(spark, sf))


@query("c10_parent_blocks", """
SELECT doc_id, CAST(parent_index AS INTEGER) AS parent_index, content, section AS section_path, page AS page_no FROM doc_parents""", ("doc_parents",))
def _(spark, sf):
    return rows_of(t.elements(spark, sf), chunking.parents_of(F.col("elements")), "doc_id", pos="parent_index").select(
        "doc_id", "parent_index", F.col("item.content").alias("content"), F.col("item.section").alias("section_path"), F.col("item.page").alias("page_no"))


@query("c11_atomic_blocks", f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, kind, content, CAST({t.sql_tokens('content')} AS INTEGER) AS token_count, is_table FROM (
  SELECT o_custkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN 'int v = ' || o_orderkey ELSE '| ' || o_orderpriority || ' | ' || o_orderkey || ' |' END AS content, o_orderstatus <> 'P' AS is_table FROM orders),
  (VALUES ('parent'), ('child')) k(kind)""")
def _(spark, sf):
    order = t.read(spark, sf, "orders")
    code = F.col("o_orderstatus") == "P"
    text = F.when(code, F.concat(F.lit("int v = "), F.col("o_orderkey").cast("string"))).otherwise(
        F.concat(F.lit("| "), "o_orderpriority", F.lit(" | "), F.col("o_orderkey").cast("string"), F.lit(" |")))
    rows = order.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.when(code, "CODE").otherwise("TABLE").alias("type"),
                        text.alias("text"), F.lit(0).alias("level"), F.lit(1).alias("page_no"))
    return chunking.structure_chunks(el.nest_elements(rows)).select("doc_id", "kind", "content", "token_count", "is_table")


@query("c12_structure_chunks", _CHUNK_SQL + "doc_chunks", ("doc_chunks",))
def _(spark, sf):
    return t.CHUNKERS["STRUCTURE_AWARE"](t.elements(spark, sf))


@query("c12_structure_chunks_html", _CHUNK_SQL.replace("doc_id", "page_id") + "page_chunks", ("page_chunks",))
def _(spark, sf):
    return t.CHUNKERS["STRUCTURE_AWARE"](t.page_elements(spark, sf), key="page_id")


@query("c13_chunk_corpus", _CHUNK_SQL + """ all_chunks JOIN (SELECT doc_id, CASE lang WHEN 'de' THEN 'FIXED' WHEN 'en' THEN 'RECURSIVE' ELSE 'STRUCTURE_AWARE' END AS strategy FROM corpus) USING (doc_id, strategy)""",
       ("all_chunks", "corpus"))
def _(spark, sf):
    named = F.when(F.col("lang") == "de", "FIXED").when(F.col("lang") == "en", "RECURSIVE").when(F.col("lang") == "es", "SEMANTIC").otherwise("STRUCTURE_AWARE")
    return chunking.chunk_corpus(t.elements(spark, sf).withColumn("chunk_strategy", named), chunkers=t.CHUNKERS)


@query("c14_preview_chunks", """
SELECT doc_id, kind, chunk_index, token_count, section_path, page_no, CASE WHEN length(content) <= 500 THEN content ELSE substr(content, 1, 500) || '…' END AS content
FROM doc_chunks WHERE chunk_index < 150""", ("doc_chunks",))
def _(spark, sf):
    return chunking.preview_chunks(t.chunks(spark, sf, "STRUCTURE_AWARE"))


@query("c14_preview_header", """
SELECT doc_id, count(*) FILTER (kind = 'parent') AS parent_count, count(*) FILTER (kind = 'child') AS child_count,
       CAST(coalesce(sum(token_count) FILTER (kind = 'child'), 0) AS BIGINT) AS child_tokens, count(*) FILTER (kind = 'parent') >= 150 OR count(*) > 150 AS truncated
FROM doc_chunks GROUP BY doc_id""", ("doc_chunks",))
def _(spark, sf):
    return chunking.preview_header(t.chunks(spark, sf, "STRUCTURE_AWARE"))


@query("c15_document_token_total", "SELECT doc_id, CAST(sum(token_count) AS BIGINT) AS token_count FROM doc_chunks WHERE kind = 'child' GROUP BY doc_id", ("doc_chunks",))
def _(spark, sf):
    return chunking.document_token_total(t.chunks(spark, sf, "STRUCTURE_AWARE"))


# ---------------------------------------------------------------- index
_SLOT = "('0x' || substr(md5(term), 1, 8))::BIGINT % 512"


@query("i1_embed", f"""
SELECT doc_id, chunk_index, 512 AS dim, CAST(count(*) AS INTEGER) AS used, CAST(arg_max(slot, (x, -slot)) AS INTEGER) AS top_slot, round(max(x) / sqrt(sum(x * x)), 5) AS top_value,
       round(sum(x * (slot + 1)) / sqrt(sum(x * x)), 3) AS checksum
FROM (SELECT doc_id, chunk_index, {_SLOT} AS slot, count(*)::DOUBLE AS x FROM (
  SELECT doc_id, chunk_index, unnest({t.sql_terms('content')}) AS term FROM doc_chunks WHERE kind = 'child') GROUP BY ALL) GROUP BY doc_id, chunk_index
UNION ALL SELECT doc_id, chunk_index, 512, 0, 0, 0, 0 FROM doc_chunks WHERE kind = 'child' AND len({t.sql_terms('content')}) = 0""", ("doc_chunks",))
def _(spark, sf):
    rows = indexing.embed(t.chunks(spark, sf, "STRUCTURE_AWARE"), indexing.hashed_embedder(element="double"))
    top = F.array_max("vector")
    return rows.select("doc_id", "chunk_index", F.size("vector").alias("dim"), F.size(F.filter("vector", lambda x: x > 0)).alias("used"), (F.array_position("vector", top) - 1).cast("int").alias("top_slot"),
                       F.round(top, 5).alias("top_value"), F.round(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3).alias("checksum"))


@query("i2_mean_pool_normalize", """
SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(x / sqrt(greatest(sum(x * x) OVER (PARTITION BY label), 1e-12)), 6) + 0 AS value
FROM (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL)""")
def _(spark, sf):
    hidden = t.read(spark, sf, "embeddings").withColumn("mask", F.lit(1))
    pooled = indexing.mean_pool_normalize(hidden, "label", "embedding")
    return pooled.select("label", F.posexplode("vector").alias("dim", "x")).select("label", "dim", (F.round("x", 6) + 0).alias("value"))


@query("i3_segment_terms", f"""
SELECT doc_id, CAST(n - 1 AS INTEGER) AS pos, term FROM (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS n FROM (SELECT doc_id, {t.sql_terms('text')} AS ts FROM documents))""")
def _(spark, sf):
    docs = t.spread(t.read(spark, sf, "documents").select("doc_id", "text"))
    return rows_of(docs, tx.segment_terms(F.col("text")), "doc_id", item="term")


@query("i4_build_postings", f"""
SELECT chunk_id, term, count(*) AS tf, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS positions
FROM (SELECT chunk_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS n FROM (SELECT chunk_id, {t.sql_terms('content')} AS ts FROM store WHERE kind = 'child')) GROUP BY ALL""", ("store",))
def _(spark, sf):
    return indexing.build_postings(t.store(spark, sf), "chunk_id").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("i5_attach_parent", """
SELECT c.doc_id, c.chunk_index, c.parent_index, p.token_count AS parent_tokens, md5(p.content) AS parent_md5
FROM doc_chunks c LEFT JOIN doc_chunks p ON p.doc_id = c.doc_id AND p.kind = 'parent' AND p.chunk_index = c.parent_index WHERE c.kind = 'child'""", ("doc_chunks",))
def _(spark, sf):
    return indexing.attach_parent(t.chunks(spark, sf, "STRUCTURE_AWARE")).select(
        "doc_id", "chunk_index", "parent_index", "parent_tokens", F.md5(F.col("parent_content").cast("binary")).alias("parent_md5"))
