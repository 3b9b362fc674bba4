"""Documents to ordered elements. The elements stay an array inside the document's row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.arrays import rows_of
from askloom.functions.text import heading_style_level, is_blank, let, trim_controls
from askloom.schemas import ELEMENT_TYPES, ELEMENTS

# ---- fixed values: block marks of the two document formats ----
FENCE = r"(?m)^ {0,3}(?:```|~~~)[^\n]*$"
QUOTE = r"(?m)^(?: {0,3}> ?)++"
HEADING_LINE = r"(?m)^( {0,3}#{1,6}(?:[ \t][^\n]*)?)$"
LIST_ITEM = r" {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]"
TABLE_HEAD = r"\A[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*+\|?[ \t]*(?:\n|\z)"
HTML_DROP = r"(?is)<(script|style|nav|head|footer)\b.*?</\1>|<!--.*?-->"
HTML_OPEN = r"(?i)<(h[1-6]|p|ul|ol|table|pre)\b[^>]*>"
HTML_CLOSE = r"(?i)</(h[1-6]|p|ul|ol|table|pre)>"
# ---- end of fixed values ----

_CUT = "\u0001"
_KEEP = "\u0002"


def _numbered(blocks: Column, page: Column) -> Column:
    """Array of struct(type, text, level) to the element array."""
    full = F.filter(blocks, lambda b: F.length(b["text"]) > 0)
    return F.transform(full, lambda b, i: F.struct(
        i.alias("pos"), b["type"].alias("type"), b["text"].alias("text"), b["level"].alias("level"),
        page.alias("page_no"))).cast(ELEMENTS)


def _block(kind: str, text: Column, level: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"),
                    (F.lit(0) if level is None else level).alias("level"))


def _markdown_blocks(part: Column) -> Column:
    """Blocks of a text without fences. Headings stand alone, blank lines end a block, a list item opens a list."""
    loose = F.regexp_replace(part, rf"(?m)(^{LIST_ITEM}[^\n]*)\n([ \t\n]*\n)(?={LIST_ITEM})", f"$1{_KEEP}$2{_KEEP}")
    loose = F.regexp_replace(loose, rf"{_KEEP}[ \t\n]*{_KEEP}", f"{_KEEP}{_KEEP}")
    marked = F.regexp_replace(loose, HEADING_LINE, f"{_CUT}$1{_CUT}")
    runs = F.filter(F.split(marked, rf"{_CUT}|\n[ \t\n]*\n", -1), lambda r: ~is_blank(r))

    def classify(run: Column) -> Column:
        return let(F.regexp_replace(run, r"\A\n+", ""), shape)

    def shape(body: Column) -> Column:
        hashes = F.regexp_extract(body, r"\A\s*(#{1,6})(?:[ \t]|\z)", 1)
        title = trim_controls(F.regexp_replace(F.regexp_replace(body, r"\A\s*#{1,6}", ""), r"[ \t]#+[ \t]*\z", ""))
        code = F.split(body, r"\n(?! {4}|\t)", 2)
        listed = F.split(body, rf"\n(?={LIST_ITEM})", 2)
        rest = F.when(F.size(listed) > 1, F.array(
            _block("PARAGRAPH", trim_controls(F.get(listed, F.lit(0)))),
            _block("LIST", trim_controls(F.get(listed, F.lit(1)))))).otherwise(
            F.array(_block("PARAGRAPH", trim_controls(body))))
        return (F.when(hashes != "", F.array(_block("HEADING", title, F.length(hashes))))
                .when(body.rlike(r"\A(?: {4}|\t)"), F.array(
                    _block("CODE", trim_controls(F.get(code, F.lit(0)))),
                    _block("PARAGRAPH", trim_controls(F.coalesce(F.get(code, F.lit(1)), F.lit(""))))))
                .when(body.rlike(rf"\A{LIST_ITEM}"), F.array(_block("LIST", trim_controls(body))))
                .when(body.rlike(TABLE_HEAD), F.array(_block("TABLE", trim_controls(body))))
                .otherwise(rest))

    blocks = F.flatten(F.transform(runs, classify))
    return F.transform(blocks, lambda b: F.struct(
        b["type"].alias("type"), F.regexp_replace(b["text"], rf"{_KEEP}{_KEEP}", "\n\n").alias("text"),
        b["level"].alias("level")))


def parse_markdown(docs: DataFrame, text: str = "text") -> DataFrame:
    """Markdown text to the ``elements`` array: headings, lists, tables, code and paragraphs, all on page 1.

    Fences cut the text first, so every second part is code; block quotes lose their marks.
    """
    parts = F.split(F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), QUOTE, ""), FENCE, -1)
    blocks = F.flatten(F.transform(parts, lambda p, i: F.when(
        i % 2 == 1, F.array(_block("CODE", trim_controls(p)))).otherwise(_markdown_blocks(p))))
    return docs.withColumn("elements", _numbered(blocks, F.lit(1)))


def _html_text(c: Column, keep_lines: bool = False) -> Column:
    t = F.regexp_replace(c, r"(?is)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                         ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return trim_controls(t if keep_lines else F.regexp_replace(t, r"\s+", " "))


def parse_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """HTML to the ``elements`` array: h1-h6, p, ul/ol, table and pre; navigation, scripts and loose text dropped."""
    body = F.regexp_replace(F.col(html), HTML_DROP, "")
    marked = F.regexp_replace(F.regexp_replace(body, HTML_OPEN, f"{_CUT}$0"), HTML_CLOSE, f"$0{_CUT}")
    parts = F.split(marked, _CUT, -1)

    def classify(part: Column) -> Column:
        tag = F.lower(F.regexp_extract(part, r"(?i)\A<(h[1-6]|p|ul|ol|table|pre)\b", 1))
        items = F.transform(F.regexp_extract_all(part, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)),
                            lambda li: F.concat(F.lit("- "), _html_text(li)))
        rows = F.transform(
            F.regexp_extract_all(part, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)),
            lambda tr: markdown_row(F.transform(
                F.regexp_extract_all(tr, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), lambda td: _html_text(td))))
        return (F.when(tag.rlike("^h[1-6]$"), _block("HEADING", _html_text(part), F.substring(tag, 2, 1).try_cast("int")))
                .when(tag == "p", _block("PARAGRAPH", _html_text(part)))
                .when(tag.isin("ul", "ol"), _block("LIST", F.array_join(items, "\n")))
                .when(tag == "table", _block("TABLE", F.array_join(rows, "\n")))
                .when(tag == "pre", _block("CODE", _html_text(part, keep_lines=True)))
                .otherwise(_block("PARAGRAPH", F.lit(""))))

    return pages.withColumn("elements", _numbered(F.transform(parts, classify), F.lit(1)))


def markdown_row(cells: Column) -> Column:
    """One table row as ``| a | b |`` from an array of cell texts."""
    clean = F.transform(cells, lambda c: trim_controls(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n", " ")))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def table_rows_to_markdown(cells: DataFrame, table_keys: list[str]) -> DataFrame:
    """Cells (table keys, row_no, col_no, text) to one text per table, a line per row, no separator row.

    The first grouping is per row, so a long table is put together from finished lines.
    """
    rows = (cells.groupBy(*table_keys, "row_no")
            .agg(F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("cells"))
            .select(*table_keys, "row_no", markdown_row(F.col("cells.text")).alias("line")))
    return (rows.groupBy(*table_keys)
            .agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("rows"))
            .select(*table_keys, F.array_join(F.col("rows.line"), "\n").alias("text")))


def style_to_heading_level(paragraphs: DataFrame, style: str = "style") -> DataFrame:
    return paragraphs.withColumn("level", heading_style_level(F.col(style)))


def explode_elements(docs: DataFrame, *keys: str) -> DataFrame:
    """One row per element."""
    return rows_of(docs, "elements", *keys, pos="_pos", item="e").select(*keys, "e.*")


def nest_elements(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """Element rows back to one array per document (a document is bounded by the admission size)."""
    return (elements.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "type", "text", "level", "page_no"))).alias("elements"))
            .withColumn("elements", F.col("elements").cast(ELEMENTS)))


def element_type_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of elements per type, a column per type, counted inside the row."""
    def counted(kind: str) -> Column:
        return F.size(F.filter("elements", lambda e: e["type"] == kind)).cast("bigint").alias(kind.lower())

    return docs.select(key, *[counted(t) for t in ELEMENT_TYPES])


def empty_document_status(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """READY, or FAILED with a message for a document without text, as rows instead of task failures."""
    has_text = F.exists("elements", lambda e: ~is_blank(e["text"]))
    return docs.select(
        key, F.when(has_text, F.lit("READY")).otherwise(F.lit("FAILED")).alias("status"),
        F.when(~has_text, F.lit("no text found in the document")).alias("error_msg"))
