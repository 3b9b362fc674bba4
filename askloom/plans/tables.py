"""The product's tables, derived by Spark from the given tables, next to the same derivations in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions.arrays import rows_of
from askloom.operators import chunking, indexing, recall, retrieval
from askloom.operators.elements import parse_html, parse_markdown
from askloom.plans.registry import cte
from askloom.schemas import GRADES_JSON
from askloom.session import materialize
from askloom.sources.corpus import spread

# Latin-script corpus: sentence and clause marks join the default separators.
SEPARATORS = ("\n\n", "\n", "。", "，", ". ", ", ")
SENTENCE_ENDS = "。！？!?."
PAGE_LINES = 30


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- SQL helpers
def sql_tokens(x: str) -> str:
    clean = rf"regexp_replace({x}, '[\x00-\x1F\x7F-\x9F]', '', 'g')"
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 0 ELSE "
            rf"length(replace(regexp_replace({clean}, '[\p{{L}}\p{{N}}]+', 'a', 'g'), ' ', '')) + 2 END)")


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def sql_terms(x: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace({x}, '[\x00-\x1F\x7F-\x9F]', '', 'g')), '[\p{{L}}\p{{N}}]+')"


def sql_snippet(x: str, n: int) -> str:
    s = sql_trim(rf"regexp_replace({x}, '\s+', ' ', 'g')")
    return f"(CASE WHEN length({s}) <= {n} THEN {s} ELSE substr({s}, 1, {n}) || '…' END)"


def sql_grams(x: str) -> str:
    flat = rf"regexp_replace({x}, '\s+', '', 'g')"
    return f"(SELECT list(DISTINCT substr({flat}, i, 10)) FROM range(1, length({flat}) - 8) r(i))"


def sql_split(t: str, seps: tuple[str, ...], budget: int = 320) -> str:
    """List of texts: separator after separator on what is over budget (the corpus needs no hard cut)."""
    expr = f"[{t}]"
    for sep in seps:
        s = "chr(10) || chr(10)" if sep == "\n\n" else "chr(10)" if sep == "\n" else f"'{sep}'"
        kept = (f"list_transform(string_split(t, {s}), lambda x, i: CASE WHEN i < len(string_split(t, {s})) "
                f"THEN x || {s} ELSE x END)")
        expr = (f"flatten(list_transform({expr}, lambda t: CASE WHEN {sql_tokens('t')} <= {budget} THEN [t] ELSE "
                f"list_filter({kept}, lambda y: {sql_trim('y')} <> '') END))")
    width = f"greatest(CAST(floor(length(t)::DOUBLE / greatest({sql_tokens('t')}, 1) * {budget}) AS BIGINT), 20)"
    cut = (f"list_filter(list_transform(range(1, length(t) + 1, {width}), lambda b: substr(t, b, {width})), "
           f"lambda y: {sql_trim('y')} <> '')")
    return f"flatten(list_transform({expr}, lambda t: CASE WHEN {sql_tokens('t')} <= {budget} THEN [t] ELSE {cut} END))"


def sql_tail(source: str, text: str, when: str = "TRUE", budget: int = 48) -> str:
    """``source`` with the columns tail and tail_n: the last whole sentences of ``text`` within budget and their tokens.

    A sentence counts three tokens or more, so only the last 17 can fit.
    """
    return f"""
SELECT * EXCLUDE (sents, toks, first), array_to_string(sents[first:], '') AS tail, coalesce(list_sum(toks[first:]), 0) AS tail_n
FROM (SELECT *, coalesce(list_min(list_filter(range(1, len(toks) + 1), lambda i: list_sum(toks[i:]) <= {budget})), len(toks) + 1) AS first
      FROM (SELECT *, list_transform(sents, lambda s: {sql_tokens('s')}) AS toks
            FROM (SELECT *, CASE WHEN {when} THEN list_filter(list_transform(regexp_extract_all({text}, '[^。！？!?.]*[.。！？!?]?'),
                                lambda s: {sql_trim('s')}), lambda s: s <> '')[-17:] ELSE [] END AS sents FROM ({source}))))"""


# ---------------------------------------------------------------- corpus and elements
def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as Markdown: source and language as headings, short lines as list items. A document labelled
    toxic failed its ingest. One knowledge base holds them all."""
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    flags = read(spark, sf, "labels").select("doc_id", "toxic")
    # the texts move once: the join finds them dealt out by document
    return as_markdown(spread(docs, "doc_id").join(flags, "doc_id", "left")).select(
        "doc_id", F.lit(1).cast("bigint").alias("kb_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"),
        F.when(F.col("toxic") == 1, "FAILED").otherwise("READY").alias("status"), "lang", "source",
        "text")


def as_markdown(docs: DataFrame) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace("text", r"(?m)^(.{1,60})$", "- $1"), "\n", "\n\n")
    return docs.withColumn("text", F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n\n"), body))


cte("corpus", r"""
SELECT d.doc_id, CAST(1 AS BIGINT) AS kb_id, 'doc' || d.doc_id || '.md' AS file_name,
       CASE WHEN l.toxic = 1 THEN 'FAILED' ELSE 'READY' END AS status, d.lang, d.source,
       '# ' || d.source || chr(10) || chr(10) || '## ' || d.lang || chr(10) || chr(10) ||
       replace(regexp_replace(d.text, '(?m)^(.{1,60})$', '- \1', 'g'), chr(10), chr(10) || chr(10)) AS text
FROM documents d LEFT JOIN labels l USING (doc_id)""")

cte("md_lines", r"""
SELECT doc_id, n, line,
       CASE WHEN regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)') THEN 'H'
            WHEN regexp_matches(line, '^ {0,3}([-*+]|\d{1,9}[.)])[ \t]') THEN 'L' ELSE 'P' END AS kind
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS n FROM corpus)
WHERE regexp_replace(line, '[\x00-\x20]+', '', 'g') <> ''""", "corpus")

cte("md_blocks", r"""
SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY n) AS block
FROM (SELECT *, n - lag(n) OVER w AS gap,
             CASE WHEN lag(n) OVER w IS NULL OR kind = 'H' OR lag(kind) OVER w = 'H' THEN 1
                  WHEN n > lag(n) OVER w + 1 AND NOT (kind = 'L' AND lag(kind) OVER w = 'L') THEN 1
                  WHEN kind = 'L' AND lag(kind) OVER w = 'P' THEN 1 ELSE 0 END AS starts
      FROM md_lines WINDOW w AS (PARTITION BY doc_id ORDER BY n))""", "md_lines")

cte("elements", rf"""
SELECT doc_id, CAST(block - 1 AS INTEGER) AS pos,
       CASE kind WHEN 'H' THEN 'HEADING' WHEN 'L' THEN 'LIST' ELSE 'PARAGRAPH' END AS type,
       CASE WHEN kind = 'H' THEN {sql_trim(r"regexp_replace(body, '^\s*#{1,6}', '')")} ELSE {sql_trim('body')} END AS text,
       CAST(CASE WHEN kind = 'H' THEN length(regexp_extract(body, '^\s*(#{{1,6}})', 1)) ELSE 0 END AS INTEGER) AS level,
       CAST(1 AS INTEGER) AS page_no
FROM (SELECT doc_id, block, arg_min(kind, n) AS kind,
             string_agg(CASE WHEN starts = 1 THEN line ELSE repeat(chr(10), gap) || line END, '' ORDER BY n) AS body
      FROM md_blocks GROUP BY doc_id, block)""", "md_blocks")


def elements(spark: SparkSession, sf: str) -> DataFrame:
    return parse_markdown(corpus(spark, sf)).drop("text")


def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    return parse_html(spread(read(spark, sf, "pages").select("page_id", "html")))


_ENTITIES = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


def sql_html_text(x: str) -> str:
    return sql_trim(rf"regexp_replace({_ENTITIES.format(x=f'regexp_replace({x}, {chr(39)}(?s)<[^>]*>{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, '\s+', ' ', 'g')")


_HTML_BODY = ("regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<nav\\b.*?</nav>|<head\\b.*?</head>|"
              "<footer\\b.*?</footer>|<!--.*?-->', '', 'g')")
cte("page_elements", rf"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS pos, type, text, level, CAST(1 AS INTEGER) AS page_no
FROM (SELECT page_id, n, tag, CASE WHEN tag LIKE 'h%' THEN 'HEADING' WHEN tag = 'p' THEN 'PARAGRAPH' ELSE 'LIST' END AS type,
             CASE WHEN tag IN ('ul', 'ol') THEN (SELECT string_agg('- ' || {sql_html_text('li')}, chr(10) ORDER BY k)
                       FROM (SELECT unnest(regexp_extract_all(part, '(?is)<li\b[^>]*>(.*?)</li>', 1)) AS li,
                                    generate_subscripts(regexp_extract_all(part, '(?is)<li\b[^>]*>(.*?)</li>', 1), 1) AS k))
                  ELSE {sql_html_text('part')} END AS text,
             CAST(CASE WHEN tag LIKE 'h%' THEN substr(tag, 2, 1) ELSE '0' END AS INTEGER) AS level
      FROM (SELECT *, lower(regexp_extract(part, '(?i)^<(h[1-6]|p|ul|ol|table|pre)\b', 1)) AS tag
            FROM (SELECT page_id, unnest(string_split(m, chr(1))) AS part, generate_subscripts(string_split(m, chr(1)), 1) AS n
                  FROM (SELECT page_id, regexp_replace(regexp_replace({_HTML_BODY},
                               '(?i)(<(h[1-6]|p|ul|ol|table|pre)\b[^>]*>)', chr(1) || '\1', 'g'),
                               '(?i)(</(h[1-6]|p|ul|ol|table|pre)>)', '\1' || chr(1), 'g') AS m FROM pages))))
WHERE tag <> '' AND coalesce(text, '') <> ''""")


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as printed pages of 30 lines: running header, body, one contents entry, page number; short
    lines are set larger."""
    docs = spread(read(spark, sf, "documents").select("doc_id", "text", "source"))
    lines = F.split("text", "\n", -1)
    pages = F.ceil(F.size(lines) / PAGE_LINES).cast("int")
    body = rows_of(docs.withColumn("page_count", pages), lines, "doc_id", "page_count", pos="n", item="text").select(
        "doc_id", "page_count", (F.floor(F.col("n") / PAGE_LINES) + 1).cast("int").alias("page"), (F.col("n") % PAGE_LINES + 1).alias("k"),
        F.when(F.length("text") <= 40, 14 + F.length("text") % 5).otherwise(11).cast("double").alias("max_font"), "text")
    one = F.get(lines, F.lit(0))
    extra = rows_of(docs, F.flatten(F.transform(F.sequence(F.lit(1), pages), lambda p: F.array(
        F.struct(p.alias("page"), F.lit(0).alias("k"), F.lit(9.0).alias("max_font"), F.concat(F.lit("Source "), "source", F.lit(" "), p.cast("string")).alias("text")),
        F.struct(p.alias("page"), F.lit(98).alias("k"), F.lit(11.0).alias("max_font"), F.concat(F.substring(one, 1, 30), F.lit(" ..... "), p.cast("string")).alias("text")),
        F.struct(p.alias("page"), F.lit(99).alias("k"), F.lit(9.0).alias("max_font"), p.cast("string").alias("text"))))),
        "doc_id", pages.alias("page_count")).select("doc_id", "page_count", "item.*")
    return body.unionByName(extra).withColumn("line_no", (F.col("page") * 100 + F.col("k")).cast("int")).drop("k")


cte("page_lines", f"""
SELECT doc_id, page_count, page, CAST(page * 100 + k AS INTEGER) AS line_no, CAST(max_font AS DOUBLE) AS max_font, text FROM (
  WITH src AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
       pc AS (SELECT *, CAST(ceil(len(ls) / {PAGE_LINES}.0) AS INTEGER) AS page_count FROM src)
  SELECT doc_id, page_count, CAST((n - 1) // {PAGE_LINES} + 1 AS INTEGER) AS page, (n - 1) % {PAGE_LINES} + 1 AS k,
         CASE WHEN length(text) <= 40 THEN 14 + length(text) % 5 ELSE 11 END AS max_font, text
  FROM (SELECT doc_id, page_count, unnest(ls) AS text, generate_subscripts(ls, 1) AS n FROM pc)
  UNION BY NAME SELECT doc_id, page_count, page, 0 AS k, 9 AS max_font, 'Source ' || source || ' ' || page AS text
                FROM (SELECT *, CAST(unnest(range(1, page_count + 1)) AS INTEGER) AS page FROM pc)
  UNION BY NAME SELECT doc_id, page_count, page, 98 AS k, 11 AS max_font, substr(ls[1], 1, 30) || ' ..... ' || page AS text
                FROM (SELECT *, CAST(unnest(range(1, page_count + 1)) AS INTEGER) AS page FROM pc)
  UNION BY NAME SELECT doc_id, page_count, page, 99 AS k, 9 AS max_font, CAST(page AS VARCHAR) AS text
                FROM (SELECT *, CAST(unnest(range(1, page_count + 1)) AS INTEGER) AS page FROM pc))""")


# ---------------------------------------------------------------- chunks
def sql_paths(source: str, key: str, max_chars: int | None) -> str:
    """Body elements of ``source`` with section path and segment number, by the last heading of each level."""
    limit = "" if max_chars is None else f" AND length(text) <= {max_chars}"
    last = ", ".join(f"max(CASE WHEN type = 'HEADING' AND level = {i}{limit} THEN pos END) OVER w AS p{i}, "
                     f"arg_max(text, pos) FILTER (type = 'HEADING' AND level = {i}{limit}) OVER w AS t{i}" for i in range(1, 7))
    live = ", ".join(f"CASE WHEN p{i} > coalesce(greatest({', '.join(['-1'] + [f'coalesce(p{j}, -1)' for j in range(1, i)])}), -1) THEN t{i} END"
                     for i in range(1, 7))
    return f"""
SELECT {key}, pos, type, text, page_no, segment, nullif(concat_ws(' > ', {live}), '') AS section_path
FROM (SELECT *, {last}, sum(CASE WHEN type = 'HEADING' THEN 1 ELSE 0 END) OVER w AS segment
      FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY pos))
WHERE type <> 'HEADING'"""


cte("paths_all", sql_paths("elements", "doc_id", None), "elements")
cte("paths_40", sql_paths("elements", "doc_id", 40), "elements")

cte("fixed_raw", f"""
SELECT doc_id, t, CAST(floor(320 * (length(t)::DOUBLE / {sql_tokens('t')})) AS BIGINT) AS w
FROM (SELECT doc_id, string_agg(text || chr(10), '' ORDER BY pos) AS t FROM elements GROUP BY doc_id)
WHERE {sql_trim('t')} <> ''""", "elements")
cte("fixed_chunks", f"""
SELECT doc_id, 'FIXED' AS strategy, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, 'child' AS kind,
       CAST(NULL AS INTEGER) AS parent_index, content, CAST({sql_tokens('content')} AS INTEGER) AS token_count,
       CAST(NULL AS VARCHAR) AS section_path, CAST(1 AS INTEGER) AS page_no, FALSE AS is_table
FROM (SELECT doc_id, i, {sql_trim('substr(t, i * step + 1, width)')} AS content
      FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((length(t) - width) / step::DOUBLE) AS BIGINT), 0) + 1)) AS i
            FROM (SELECT doc_id, t, greatest(CAST(floor(w * 0.85::DOUBLE) AS BIGINT), 1) AS step, greatest(w, 50) AS width FROM fixed_raw)))
WHERE content <> ''""", "fixed_raw")


def sql_pack(pieces: str) -> str:
    """Recursive packing of ``pieces`` (grp, k, text, tokens, section, page): rows (grp, k, emitted text, tokens, section, page)."""
    joined = f"""SELECT s.grp, p.k, p.text, p.tokens, p.section AS p_section, p.page AS p_page, s.cur, s.n, s.section, s.page, s.last_k,
             s.n > 0 AND s.n + p.tokens > 368 AS over FROM @SELF@ s JOIN {pieces} p ON p.grp = s.grp AND p.k = s.k + 1"""
    return f"""
SELECT grp, 0::BIGINT AS k, '' AS cur, 0::BIGINT AS n, NULL::VARCHAR AS section, NULL::INTEGER AS page, NULL::VARCHAR AS done,
       0::BIGINT AS done_n, NULL::VARCHAR AS done_section, NULL::INTEGER AS done_page, max(k) AS last_k FROM {pieces} GROUP BY grp
UNION ALL
SELECT grp, k, CASE WHEN over THEN tail ELSE cur END || text || chr(10), CAST(CASE WHEN over THEN tail_n ELSE n END + tokens AS BIGINT),
       CASE WHEN n = 0 OR over THEN p_section ELSE section END, CASE WHEN n = 0 OR over THEN p_page ELSE page END,
       CASE WHEN over THEN cur END, n, section, page, last_k
FROM ({sql_tail(joined, 'cur', 'over')})"""


def sql_packed(name: str) -> str:
    """Emitted chunks of a recursive packing, in order."""
    return f"""
SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY k, final) AS c, content, tokens, section, page
FROM (SELECT grp, k, 0 AS final, {sql_trim('done')} AS content, done_n AS tokens, done_section AS section, done_page AS page
      FROM {name} WHERE done IS NOT NULL
      UNION BY NAME SELECT grp, k, 1 AS final, {sql_trim('cur')} AS content, n AS tokens, section, page FROM {name} WHERE k = last_k)
WHERE content <> ''"""


cte("rec_pieces", f"""
SELECT doc_id AS grp, row_number() OVER (PARTITION BY doc_id ORDER BY pos, j) AS k, text, CAST({sql_tokens('text')} AS BIGINT) AS tokens, section, page
FROM (SELECT doc_id, pos, unnest(ps) AS text, generate_subscripts(ps, 1) AS j, section_path AS section, page_no AS page
      FROM (SELECT *, {sql_split('text', SEPARATORS)} AS ps FROM paths_all))""", "paths_all")
cte("rec_pack", sql_pack("rec_pieces").replace("@SELF@", "rec_pack"), "rec_pieces")
cte("rec_packed", sql_packed("rec_pack"), "rec_pack")
cte("recursive_chunks", """
SELECT grp AS doc_id, 'RECURSIVE' AS strategy, CAST(c - 1 AS INTEGER) AS chunk_index, 'child' AS kind, CAST(NULL AS INTEGER) AS parent_index,
       content, CAST(tokens AS INTEGER) AS token_count, section AS section_path, page AS page_no, FALSE AS is_table FROM rec_packed""", "rec_packed")


def sql_structure(prefix: str, paths: str, key: str) -> None:
    """Named tables ``<prefix>_parents`` and ``<prefix>_chunks`` from body elements with paths (no tables or code)."""
    cte(f"{prefix}_body", f"""
SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS k, text, segment, section_path, page_no, {sql_tokens('text')} AS tokens FROM {paths}""", paths)
    cte(f"{prefix}_grp", f"""
SELECT {key}, k, 0::BIGINT AS parent_index, segment, CAST(tokens AS BIGINT) AS n FROM {prefix}_body WHERE k = 1
UNION ALL
SELECT b.{key}, b.k, CASE WHEN b.segment <> g.segment OR g.n > 1024 THEN g.parent_index + 1 ELSE g.parent_index END, b.segment,
       CASE WHEN b.segment <> g.segment OR g.n > 1024 THEN b.tokens ELSE g.n + b.tokens END
FROM {prefix}_grp g JOIN {prefix}_body b ON b.{key} = g.{key} AND b.k = g.k + 1""", f"{prefix}_body")
    cte(f"{prefix}_parents", f"""
SELECT {key}, parent_index, {sql_trim("string_agg(text, chr(10) || chr(10) ORDER BY k)")} AS content, arg_min(section_path, k) AS section,
       arg_min(page_no, k) AS page FROM {prefix}_grp JOIN {prefix}_body USING ({key}, k) GROUP BY {key}, parent_index""", f"{prefix}_grp")
    cte(f"{prefix}_pieces", f"""
SELECT {{'d': {key}, 'p': parent_index}} AS grp, row_number() OVER (PARTITION BY {key}, parent_index ORDER BY k0, j) AS k, text,
       CAST({sql_tokens('text')} AS BIGINT) AS tokens, section, page
FROM (SELECT {key}, parent_index, k AS k0, unnest(ps) AS text, generate_subscripts(ps, 1) AS j, section_path AS section, page_no AS page
      FROM (SELECT b.*, g.parent_index, {sql_split('b.text', SEPARATORS)} AS ps FROM {prefix}_grp g JOIN {prefix}_body b USING ({key}, k)))""",
        f"{prefix}_grp")
    cte(f"{prefix}_pack", sql_pack(f"{prefix}_pieces").replace("@SELF@", f"{prefix}_pack"), f"{prefix}_pieces")
    cte(f"{prefix}_packed", sql_packed(f"{prefix}_pack"), f"{prefix}_pack")
    cte(f"{prefix}_chunks", f"""
SELECT {key}, 'STRUCTURE_AWARE' AS strategy,
       CAST(row_number() OVER (PARTITION BY {key} ORDER BY kind DESC, o1, o2) - 1 AS INTEGER) AS chunk_index, kind,
       CAST(parent_index AS INTEGER) AS parent_index, content, CAST(token_count AS INTEGER) AS token_count, section_path,
       CAST(page_no AS INTEGER) AS page_no, FALSE AS is_table
FROM (SELECT {key}, 'parent' AS kind, parent_index AS o1, 0::BIGINT AS o2, NULL::BIGINT AS parent_index, content,
             {sql_tokens('content')} AS token_count, section AS section_path, page AS page_no FROM {prefix}_parents
      UNION BY NAME SELECT grp.d AS {key}, 'child' AS kind, grp.p AS o1, c AS o2, grp.p AS parent_index, content, tokens AS token_count,
             section AS section_path, page AS page_no FROM {prefix}_packed)""", f"{prefix}_parents", f"{prefix}_packed")


sql_structure("doc", "paths_40", "doc_id")
cte("page_paths", sql_paths("page_elements", "page_id", 40), "page_elements")
sql_structure("page", "page_paths", "page_id")

CHUNK_COLUMNS = "strategy, chunk_index, kind, parent_index, content, token_count, section_path, page_no, is_table"
cte("all_chunks", f"""
SELECT doc_id, {CHUNK_COLUMNS} FROM fixed_chunks UNION BY NAME SELECT doc_id, {CHUNK_COLUMNS} FROM recursive_chunks
UNION BY NAME SELECT doc_id, {CHUNK_COLUMNS} FROM doc_chunks""", "fixed_chunks", "recursive_chunks", "doc_chunks")

_ID = "(doc_id * 67108864 + CASE strategy WHEN 'FIXED' THEN 0 WHEN 'RECURSIVE' THEN 1 ELSE 2 END * 16777216"


def sql_store(chunks: str) -> str:
    return f"""
SELECT {_ID} + chunk_index) AS chunk_id, CASE WHEN parent_index IS NOT NULL THEN {_ID} + parent_index) END AS parent_id,
       doc_id, kb_id, file_name, status, lang, {CHUNK_COLUMNS} FROM {chunks} JOIN corpus USING (doc_id)"""


cte("store", sql_store("doc_chunks"), "corpus", "doc_chunks")
cte("full_store", sql_store("all_chunks"), "corpus", "all_chunks")

CHUNKERS = {
    "FIXED": chunking.fixed_chunks,
    "RECURSIVE": lambda d, **o: chunking.recursive_chunks(d, SEPARATORS, SENTENCE_ENDS, **o),
    "STRUCTURE_AWARE": lambda d, **o: chunking.structure_chunks(d, separators=SEPARATORS, sentence_ends=SENTENCE_ENDS, **o),
}


def chunks(spark: SparkSession, sf: str, *strategies: str) -> DataFrame:
    """Chunk rows of the corpus, each strategy over every document. For several strategies the documents are parsed once and their elements stored."""
    docs = elements(spark, sf)
    if len(strategies) > 1:
        docs = materialize(docs, "elements")
    out = None
    for s in strategies:
        part = CHUNKERS[s](docs)
        out = part if out is None else out.unionByName(part)
    return out


_WRITTEN: dict[tuple, DataFrame] = {}


def written(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the product, written to the shared folder on its first use in a session and read from there by
    every query after that."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialize(build(), name)
    return _WRITTEN[key]


def store(spark: SparkSession, sf: str, *strategies: str) -> DataFrame:
    """The chunk table of the given strategies, structure-aware by default."""
    names = strategies or ("STRUCTURE_AWARE",)
    return written(spark, sf, "store-" + "-".join(names), lambda: build_store(spark, sf, *names))


def vectors(spark: SparkSession, sf: str, *strategies: str) -> DataFrame:
    """The vector index of the searchable chunks (kb_id, strategy, chunk_id, vector)."""
    rows = searchable(spark, sf, *strategies).select("kb_id", "strategy", "chunk_id", "content")
    return written(spark, sf, "vectors-" + "-".join(strategies), lambda: EMBEDDER(rows, "content").drop("content"))


def postings(spark: SparkSession, sf: str, *strategies: str) -> DataFrame:
    """The term index of the searchable chunks (kb_id, strategy, chunk_id, term, tf)."""
    return written(spark, sf, "postings-" + "-".join(strategies), lambda: count_postings(spark, sf, *strategies))


def count_postings(spark: SparkSession, sf: str, *strategies: str) -> DataFrame:
    return indexing.term_counts(searchable(spark, sf, *strategies), "kb_id", "strategy", "chunk_id")


def term_blocks(spark: SparkSession, sf: str, *strategies: str) -> DataFrame:
    """The postings as an inverted index in blocks of chunks. It is packed from the counted terms; the postings by chunk are not written for it."""
    return written(spark, sf, "blocks-" + "-".join(strategies), lambda: recall.block_index(count_postings(spark, sf, *strategies)))


def build_store(spark: SparkSession, sf: str, *strategies: str) -> DataFrame:
    """Chunks with ids, parent ids and their document's fields."""
    rows = chunks(spark, sf, *(strategies or ("STRUCTURE_AWARE",)))
    docs = corpus(spark, sf).select("doc_id", "kb_id", "file_name", "status", "lang")

    def cid(index: str) -> Column:
        return chunking.chunk_id(F.col("doc_id"), F.col("strategy"), F.col(index))

    return rows.withColumn("chunk_id", cid("chunk_index")).withColumn(
        "parent_id", F.when(F.col("parent_index").isNotNull(), cid("parent_index"))).join(docs, "doc_id")


def lang_kb(c: Column) -> Column:
    return F.when(c == "de", 1).when(c == "en", 2).when(c == "es", 3).otherwise(4).cast("bigint")


SQL_LANG_KB = "CAST(CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS BIGINT)"


# ---------------------------------------------------------------- questions and retrieval stages
def questions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.lit(1).cast("bigint").alias("kb_id"), F.col("text").alias("question"))


cte("questions", "SELECT item_id AS q_id, CAST(1 AS BIGINT) AS kb_id, text AS question FROM benchmark")

EMBEDDER = indexing.hashed_embedder(element="double")


def searchable(spark: SparkSession, sf: str, *strategies: str) -> DataFrame:
    return store(spark, sf, *strategies).filter((F.col("kind") == "child") & (F.col("status") == "READY"))


def sql_recall(prefix: str, source: str) -> None:
    """Named tables <prefix>_vec, <prefix>_kw, <prefix>_fused, <prefix>_scored, <prefix>_top over ``source``."""
    slot = "('0x' || substr(md5(term), 1, 8))::BIGINT % 512"
    cte(f"{prefix}_terms", f"SELECT strategy, chunk_id, term, count(*) AS tf FROM (SELECT strategy, chunk_id, unnest({sql_terms('content')}) AS term FROM {source}) GROUP BY ALL", source)
    cte("q_terms_tf", f"SELECT q_id, term, count(*) AS tf FROM (SELECT q_id, unnest({sql_terms('question')}) AS term FROM questions) GROUP BY ALL", "questions")
    cte(f"{prefix}_cv", f"SELECT strategy, chunk_id, {slot} AS slot, sum(tf)::DOUBLE AS x FROM {prefix}_terms GROUP BY ALL", f"{prefix}_terms")
    cte("q_vec", f"SELECT q_id, {slot} AS slot, sum(tf)::DOUBLE AS x FROM q_terms_tf GROUP BY ALL", "q_terms_tf")
    cte(f"{prefix}_vec", f"""
SELECT strategy, q_id, chunk_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY strategy, q_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (
    SELECT a.strategy, b.q_id, a.chunk_id, round(coalesce(d.dot, 0) / sqrt(a.n2) / sqrt(b.n2), 6) + 0 AS score
    FROM (SELECT strategy, chunk_id, sum(x * x) AS n2 FROM {prefix}_cv GROUP BY ALL) a
    CROSS JOIN (SELECT q_id, sum(x * x) AS n2 FROM q_vec GROUP BY ALL) b
    LEFT JOIN (SELECT strategy, q_id, chunk_id, sum(c.x * q.x) AS dot FROM {prefix}_cv c JOIN q_vec q USING (slot) GROUP BY ALL) d
      ON d.strategy = a.strategy AND d.chunk_id = a.chunk_id AND d.q_id = b.q_id))
WHERE rank <= 50""", f"{prefix}_cv", "q_vec")
    cte(f"{prefix}_kw", f"""
SELECT strategy, q_id, chunk_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY strategy, q_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (
    SELECT strategy, q_id, chunk_id, round(sum(t.tf) * 0.1::DOUBLE, 6) AS score FROM {prefix}_terms t JOIN q_terms_tf q USING (term) GROUP BY ALL))
WHERE rank <= 50""", f"{prefix}_terms", "q_terms_tf")
    cte(f"{prefix}_fused", f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY strategy, q_id ORDER BY round(rrf_score, 12) DESC, chunk_id) AS INTEGER) AS rrf_rank
  FROM (SELECT coalesce(v.strategy, k.strategy) AS strategy, coalesce(v.q_id, k.q_id) AS q_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id,
               v.score AS vector_score, v.rank AS vector_rank, k.score AS fts_score, k.rank AS fts_rank,
               coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS rrf_score
        FROM {prefix}_vec v FULL OUTER JOIN {prefix}_kw k ON v.strategy = k.strategy AND v.q_id = k.q_id AND v.chunk_id = k.chunk_id))
WHERE rrf_rank <= 30""", f"{prefix}_vec", f"{prefix}_kw")
    cte(f"{prefix}_scored", f"""
SELECT f.*, round(1 / (1 + exp(-(8 * coalesce(m.n, 0)::DOUBLE / q.n - 4))), 6) AS rerank_score
FROM {prefix}_fused f JOIN (SELECT q_id, count(*) AS n FROM q_terms_tf GROUP BY ALL) q USING (q_id)
LEFT JOIN (SELECT strategy, q_id, chunk_id, count(*) AS n FROM {prefix}_terms JOIN q_terms_tf USING (term) GROUP BY ALL) m
  ON m.strategy = f.strategy AND m.q_id = f.q_id AND m.chunk_id = f.chunk_id
WHERE f.rrf_rank <= 10""", f"{prefix}_fused", f"{prefix}_terms")
    cte(f"{prefix}_top", f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY strategy, q_id ORDER BY rerank_score DESC, rrf_rank) AS INTEGER) AS rank FROM {prefix}_scored)
WHERE rank <= 8""", f"{prefix}_scored")


cte("ready", "SELECT * FROM store WHERE kind = 'child' AND status = 'READY'", "store")
cte("full_ready", "SELECT * FROM full_store WHERE kind = 'child' AND status = 'READY'", "full_store")
sql_recall("r", "ready")
sql_recall("f", "full_ready")


class Funnel:
    """The stages of the default retrieval for the whole question table. A stage that several later ones read is
    written once; it holds at most 50 rows per question."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self.questions = questions(spark, sf)
        self.store = store(spark, sf)
        self.chunks = searchable(spark, sf)

    @cached_property
    def vector(self) -> DataFrame:
        return materialize(retrieval.vector_topk(EMBEDDER(self.questions, "question"), vectors(self.spark, self.sf)), "vector")

    @cached_property
    def keyword(self) -> DataFrame:
        return materialize(retrieval.keyword_topk(retrieval.query_terms(self.questions), term_blocks(self.spark, self.sf)), "keyword")

    @cached_property
    def fused(self) -> DataFrame:
        return retrieval.rrf_fuse(self.vector, self.keyword)

    @cached_property
    def scored(self) -> DataFrame:
        return materialize(retrieval.score_pairs(self.fused, self.questions, self.chunks, retrieval.coverage_scorer()), "scored")

    @cached_property
    def reranked(self) -> DataFrame:
        return retrieval.rerank(self.scored)

    @property
    def parents(self) -> DataFrame:
        return self.store.filter(F.col("kind") == "parent").select(F.col("chunk_id").alias("parent_id"), F.col("token_count").alias("parent_tokens"))

    @cached_property
    def context(self) -> DataFrame:
        return retrieval.assemble_context(self.reranked, self.chunks, self.parents)


# ---------------------------------------------------------------- library, practice, logs
def kb(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("kb_id"), F.col("n_name").alias("name"),
                    F.upper(F.substring(F.md5(F.col("n_name").cast("binary")), 1, 6)).alias("share_code"),
                    F.concat(F.lit("v"), (F.col("n_nationkey") * 3).cast("string")).alias("created_by"),
                    F.timestamp_seconds(F.lit(1700000000) + F.col("n_nationkey") * 86400).alias("created_at"))


cte("kb", """
SELECT CAST(n_nationkey AS BIGINT) AS kb_id, n_name AS name, upper(substr(md5(n_name), 1, 6)) AS share_code, 'v' || (n_nationkey * 3) AS created_by,
       make_timestamp((1700000000 + n_nationkey * 86400)::BIGINT * 1000000) AS created_at FROM nation""")


def kb_visitor(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_nationkey").cast("bigint").alias("kb_id"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("visitor_id"))


cte("kb_visitor", "SELECT CAST(c_nationkey AS BIGINT) AS kb_id, 'v' || c_custkey AS visitor_id FROM customer")

_EXT = (("1-URGENT", ".PDF"), ("2-HIGH", ".docx"), ("3-MEDIUM", ".markdown"), ("4-NOT SPECIFIED", ".exe"))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads from the orders: knowledge base of the customer, size from the price, type from the priority."""
    o = read(spark, sf, "orders")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("kb_id"))
    ext = F.lit("")
    for p, e in _EXT:
        ext = F.when(F.col("o_orderpriority") == p, e).otherwise(ext)
    folder = F.when(F.col("o_orderstatus") == "P", "C:\\docs\\f").otherwise("up/load/f")
    status = F.when(F.col("o_orderstatus") == "F", "READY").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("PARSING")
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("doc_id"), "kb_id", F.concat(folder, F.col("o_orderkey").cast("string"), ext).alias("file_name"),
        F.floor(F.col("o_totalprice") * 150).cast("bigint").alias("size_bytes"), F.col("o_orderdate").alias("created_at"), status.alias("status"),
        F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("visitor_id"), F.lit(None).cast("string").alias("error_msg"))


cte("manifest", r"""
SELECT o_orderkey AS doc_id, CAST(c_nationkey AS BIGINT) AS kb_id,
       CASE WHEN o_orderstatus = 'P' THEN 'C:\docs\f' ELSE 'up/load/f' END || o_orderkey ||
       CASE o_orderpriority WHEN '1-URGENT' THEN '.PDF' WHEN '2-HIGH' THEN '.docx' WHEN '3-MEDIUM' THEN '.markdown' WHEN '4-NOT SPECIFIED' THEN '.exe' ELSE '' END AS file_name,
       CAST(floor(o_totalprice * 150) AS BIGINT) AS size_bytes, o_orderdate AS created_at,
       CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'PENDING' ELSE 'PARSING' END AS status, 'v' || o_custkey AS visitor_id,
       CAST(NULL AS VARCHAR) AS error_msg
FROM orders JOIN customer ON c_custkey = o_custkey""")


def attempt_items(spark: SparkSession, sf: str) -> DataFrame:
    l = read(spark, sf, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    question = F.struct(F.when(F.col("l_linestatus") == "O", "single").otherwise("short").alias("type"),
                        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("stem"), F.array(F.lit("A"), F.lit("N"), F.lit("R")).alias("options"),
                        F.col("l_returnflag").alias("answer"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("explanation"),
                        F.array("l_partkey").alias("sourceChunkIds"))
    return l.select(F.col("l_orderkey").alias("attempt_id"), order.alias("at"), question.alias("question"),
                    F.when(F.col("l_discount") > 0.05, F.concat(F.lit(" "), F.lower("l_returnflag"))).otherwise("x").alias("user_answer"),
                    F.least(F.lit(100), (F.col("l_quantity") * 2).cast("int")).alias("score"))


cte("attempt_items", """
SELECT l_orderkey AS attempt_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx,
       CASE WHEN l_linestatus = 'O' THEN 'single' ELSE 'short' END AS type, 'part ' || l_partkey AS stem, l_returnflag AS answer,
       'supplier ' || l_suppkey AS explanation, l_partkey, CASE WHEN l_discount > 0.05::DOUBLE THEN ' ' || lower(l_returnflag) ELSE 'x' END AS user_answer,
       least(100, CAST(l_quantity * 2 AS INTEGER)) AS score
FROM lineitem""")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Practice attempts: an order is an attempt, its few lines are the questions, stored as JSON."""
    items = attempt_items(spark, sf).groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("at", "question", "user_answer", "score"))).alias("xs"))
    grades = F.transform("xs", lambda x, i: F.struct(
        i.alias("index"), x["question"]["type"].alias("type"), (x["score"] >= 60).alias("correct"), x["score"].alias("score"),
        F.lit("graded").alias("comment"),
        F.when(x["score"] < 30, F.array(x["question"]["stem"], F.lit("line"))).otherwise(F.array().cast("array<string>")).alias("missedSentences"))).cast(GRADES_JSON)
    docs = manifest(spark, sf).select(F.col("doc_id").alias("attempt_id"), "kb_id", "visitor_id", "created_at")
    return items.join(docs, "attempt_id").select(
        "attempt_id", "kb_id", "visitor_id", "created_at", F.to_json(F.transform("xs", lambda x: x["question"])).alias("questions"),
        F.to_json(F.transform("xs", lambda x: x["user_answer"])).alias("answers"), F.to_json(grades).alias("grades"))


cte("attempts", """
SELECT a.attempt_id, m.kb_id, m.visitor_id, m.created_at, a.n, a.wrong, a.total
FROM (SELECT attempt_id, count(*) AS n, count(*) FILTER (score < 60) AS wrong, sum(score) AS total FROM attempt_items GROUP BY ALL) a
JOIN manifest m ON m.doc_id = a.attempt_id""", "attempt_items", "manifest")


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """Question log from the events; rows of type ``error`` carry broken JSON."""
    e = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    good = F.concat(F.lit('[{"chunkId":'), k, F.lit(',"rrfScore":0.5},{"chunkId":'), F.col("user_id").cast("string"), F.lit(',"rrfScore":0.25}]'))
    return e.select(
        F.col("event_id").alias("id"), F.length("event_type").cast("bigint").alias("kb_id"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("visitor_id"),
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("question"),
        F.when(F.col("event_type") == "error", "broken{").otherwise(good).alias("retrieved"), F.array(k.cast("bigint")).alias("chosen_ids"),
        F.when(F.col("value") >= 10, F.col("props")).alias("answer"), F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        F.concat(F.lit('{"fusedCount":'), k, F.lit("}")).alias("retrieval_meta"), F.col("ts").alias("created_at"))


cte("query_log", """
SELECT event_id AS id, CAST(length(event_type) AS BIGINT) AS kb_id, event_type, event_type || ' ' || user_id AS question, value >= 10 AS answered,
       CAST(floor(value * 10) AS BIGINT) AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, ts AS created_at FROM events""")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation heads: knowledge base from the length of the opening message's role and text, owner one visitor
    per knowledge base, last update at the opening."""
    first = read(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", (F.length("text") % 3).cast("bigint").alias("kb_id"), F.lit("v1").alias("visitor_id"),
                        F.substring("text", 1, 20).alias("title"), F.timestamp_seconds(F.lit(1700000000) + F.length("text")).alias("updated_at"))


cte("conv", """
SELECT conv_id, CAST(length(text) % 3 AS BIGINT) AS kb_id, 'v1' AS visitor_id, substr(text, 1, 20) AS title,
       make_timestamp((1700000000 + length(text))::BIGINT * 1000000) AS updated_at FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)""")
