"""Text runs and lines of paged documents to elements.

A page and a document are bounded by the admission size, so a document's lines fit one row: they are gathered once, and every step (fonts, running
headers, headings, levels, paragraphs) is an expression on the array, linear in its lines but for sorting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.arrays import rows_of
from askloom.functions.text import is_blank, let, trim_controls

# ---- fixed values: layout rules ----
LINE_Y_TOLERANCE = 2.5
HEADING_RATIO = 1.15
HEADING_MAX_CHARS = 40
EDGE_RATIO = 0.6
DEFAULT_BODY_FONT = 10
MAX_LEVEL = 4
PAGE_NUMBER = r"^[0-9ivxIVX\-–—/ .]+$"
PAGE_NUMBER_CHARS = 8
TOC_ENTRY = r"^.*[.·…]{2,}\s*\d{1,4}\s*$"
TOC_CHARS = 80
OPERATOR_SYMBOL = r"[=+×÷^~≤≥∈∫∑|&]"
SENTENCE_END = r"[。！？；：!?;:.]\z"
# ---- end of fixed values ----


def cluster_lines(runs: DataFrame, y_tol: float = LINE_Y_TOLERANCE) -> DataFrame:
    """Text runs (doc_id, page, seq, y, font, text) to lines (doc_id, page, page_line, max_font, text).

    A run joins the open line when it is within ``y_tol`` of that line's first run. Blank runs are skipped.
    The fold runs over one page at a time.
    """
    pages = (runs.filter(~is_blank(F.col("text")))
             .groupBy("doc_id", "page")
             .agg(F.array_sort(F.collect_list(F.struct("seq", "y", "font", "text"))).alias("runs")))
    empty = F.expr("cast(array() as array<struct<y:double,font:double,text:string>>)")

    def put(lines: Column, r: Column) -> Column:
        last = F.get(lines, F.size(lines) - 1)
        grown = F.struct(last["y"].alias("y"), F.greatest(last["font"], r["font"]).alias("font"),
                         F.concat(last["text"], r["text"]).alias("text"))
        fresh = F.struct(r["y"].cast("double").alias("y"), r["font"].cast("double").alias("font"), r["text"].alias("text"))
        joins = (F.size(lines) > 0) & (F.abs(r["y"] - last["y"]) <= y_tol)
        return F.when(joins, F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(grown))
                      ).otherwise(F.concat(lines, F.array(fresh)))

    return (pages.select("doc_id", "page", F.posexplode(F.aggregate("runs", empty, put)).alias("page_line", "l"))
            .select("doc_id", "page", "page_line", F.col("l.font").alias("max_font"),
                    trim_controls(F.col("l.text")).alias("text")))


def nest_lines(lines: DataFrame, *more: str) -> DataFrame:
    """One row per document with its lines in order as the array ``lines``: the only exchange of the steps below. Columns that ``lines`` lacks are null."""
    fields = [F.col(f) if f in lines.columns else F.lit(None).alias(f) for f in ("line_no", "page", "page_count", "max_font", "text", *more)]
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("lines"))


def _run_starts(items: Column, key: Callable[[Column], Column]) -> Column:
    """Positions in a sorted array at which another key begins."""
    return F.filter(F.transform(items, lambda x, i: F.when((i == 0) | (key(x) != key(F.get(items, i - 1))), i)), lambda i: i.isNotNull())


def _body_font(lines: Column) -> Column:
    """Most frequent rounded font of an array of lines; on a tie the one that reached the count first; 0 gives 10, no line null."""
    fonts = F.sort_array(F.transform(lines, lambda x: F.struct(F.floor(x["max_font"] + 0.5).cast("int").alias("font"), x["line_no"].alias("line_no"))))

    def best(fonts: Column) -> Column:
        def of(starts: Column) -> Column:
            runs = F.transform(starts, lambda at, i: let(F.coalesce(F.get(starts, i + 1), F.size(fonts)), lambda end: F.struct(
                (at - end).alias("n"), F.get(fonts, end - 1)["line_no"].alias("reached"), F.get(fonts, at)["font"].alias("font"))))
            return F.array_min(runs)["font"]
        return let(_run_starts(fonts, lambda x: x["font"]), of)

    return let(let(fonts, best), lambda font: F.when(font == 0, DEFAULT_BODY_FONT).otherwise(font))


def _running(lines: Column, ratio: float) -> Column:
    """Numbers of the lines that stand at page edges and repeat over pages, or are page numbers. First and last line of a page each count, also when they are one."""
    def edge(x: Column, i: Column) -> Column:
        ends = [(i == 0) | (F.get(lines, i - 1)["page"] != x["page"]), (i == F.size(lines) - 1) | (F.get(lines, i + 1)["page"] != x["page"])]
        trimmed = trim_controls(x["text"])
        norm = F.regexp_replace(F.regexp_replace(x["text"], r"\d+", "#"), r"\s+", "")
        number = (F.length(trimmed) <= PAGE_NUMBER_CHARS) & trimmed.rlike(PAGE_NUMBER)
        times = F.when(ends[0] & ends[1], 2).when(ends[0] | ends[1], 1).otherwise(0)
        return F.when(times > 0, F.struct(norm.alias("norm"), x["line_no"].alias("line_no"), number.alias("number"), times.alias("times")))

    def found(edges: Column) -> Column:
        least = F.greatest(F.lit(2), F.ceil(F.get(edges, F.lit(0))["page_count"] * ratio).cast("int"))
        norms = F.sort_array(F.flatten(F.transform(edges["e"], lambda e: F.array_repeat(e["norm"], e["times"]))))
        repeated = let(least, lambda m: let(norms, lambda all_norms: F.array_distinct(F.filter(
            F.transform(all_norms, lambda x, i: F.when(F.get(all_norms, i + m - 1) == x, x)), lambda x: x.isNotNull()))))
        return let(repeated, lambda known: F.transform(F.filter(edges["e"], lambda e: e["number"] | F.array_contains(known, e["norm"])), lambda e: e["line_no"]))

    marked = F.filter(F.transform(lines, lambda x, i: F.struct(x["page_count"].alias("page_count"), edge(x, i).alias("e"))), lambda x: x["e"].isNotNull())
    return let(marked, found)


def body_font_mode(lines: DataFrame) -> DataFrame:
    """(doc_id, body_font): the most frequent rounded font per document."""
    return nest_lines(lines).select("doc_id", _body_font(F.col("lines")).alias("body_font"))


def running_header_footer(lines: DataFrame, ratio: float = EDGE_RATIO) -> DataFrame:
    """Lines (doc_id, line_no) to drop: page edges that repeat over pages, and page numbers. ``lines`` carries ``page_count``."""
    return rows_of(nest_lines(lines), let(F.col("lines"), lambda x: F.array_distinct(_running(x, ratio))), "doc_id", item="line_no").drop("pos")


def is_toc_entry(text: Column) -> Column:
    return text.rlike(TOC_ENTRY) & (F.length(text) <= TOC_CHARS)


def drop_toc_entries(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_toc_entry(F.col("text")))


def is_heading_line(text: Column, font: Column, body: Column) -> Column:
    """Larger font, short, mostly letters or digits, and Han or Latin enough to be a title."""
    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    meaningful, han, latin = kept(r"[^\p{L}\p{Nd}]"), kept(r"[^\x{4E00}-\x{9FFF}]"), kept(r"[^a-zA-Z]")
    return ((font > body * HEADING_RATIO) & (F.length(text) <= HEADING_MAX_CHARS)
            & (meaningful >= F.length(text) * 0.5)
            & ((han >= 2) | ((latin >= 4) & ~text.rlike(OPERATOR_SYMBOL))))


def classified(lines: Column, ratio: float = EDGE_RATIO) -> Column:
    """Array of lines to the array of its non-blank lines without running headers and footers, with ``body_font``, ``is_heading`` and ``level``: heading fonts in
    falling order are levels 1 to 4, further fonts 4."""
    def judged(full: Column) -> Column:
        kept = let(_running(full, ratio), lambda gone: F.filter(full, lambda x: ~F.array_contains(gone, x["line_no"])))
        marked = let(_body_font(full), lambda body: F.transform(kept, lambda x: F.struct(
            *[x[f].alias(f) for f in ("line_no", "page", "page_count", "max_font", "text")], body.alias("body_font"),
            is_heading_line(x["text"], x["max_font"], body).alias("is_heading"))))
        return let(marked, ranked)

    def ranked(marked: Column) -> Column:
        return let(_heading_fonts(marked), lambda fonts: F.transform(marked, lambda x: F.struct(
            *[x[f].alias(f) for f in ("line_no", "page", "page_count", "max_font", "text", "body_font", "is_heading")],
            F.when(x["is_heading"], F.coalesce(F.nullif(F.array_position(fonts, x["max_font"]), F.lit(0)).cast("int"), F.lit(MAX_LEVEL))).otherwise(0).alias("level"))))

    return let(F.filter(lines, lambda x: ~is_blank(x["text"])), judged)


def _heading_fonts(marked: Column) -> Column:
    """The largest heading fonts, as many as there are levels, in falling order."""
    return F.slice(F.reverse(F.array_sort(F.array_distinct(F.transform(F.filter(marked, lambda x: x["is_heading"]), lambda x: x["max_font"])))), 1, MAX_LEVEL)


def classify_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines without running headers and footers, with ``body_font``, ``is_heading`` and ``level``, as rows."""
    return rows_of(nest_lines(lines), classified(F.col("lines")), "doc_id").select("doc_id", "item.*")


def heading_levels(lines: DataFrame) -> DataFrame:
    """(doc_id, max_font, level) of the heading fonts of classified lines: raw fonts in falling order are levels 1 to 4, further fonts 4."""
    fonts = lines.filter("is_heading").groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_set("max_font"))).alias("fonts"))
    return rows_of(fonts, "fonts", "doc_id", item="max_font").select("doc_id", "max_font", F.least(F.col("pos") + 1, F.lit(MAX_LEVEL)).alias("level"))


def paragraphs(lines: Column) -> Column:
    """Array of classified lines to the array of elements. A paragraph ends at a sentence mark or a heading and may cross pages; two Latin word ends get a space
    between them, other line ends none; the page is the first line's."""
    def glue(acc: Column, line: Column) -> Column:
        words = acc.rlike(r"[A-Za-z0-9]\z") & line["text"].rlike(r"\A[A-Za-z0-9]")
        return F.concat(acc, F.when(words, F.lit(" ")).otherwise(F.lit("")), line["text"])

    def blocks(body: Column) -> Column:
        def ends(x: Column) -> Column:
            return x["is_heading"] | x["text"].rlike(SENTENCE_END)

        starts = F.filter(F.transform(body, lambda x, i: F.when((i == 0) | x["is_heading"] | ends(F.get(body, i - 1)), i)), lambda i: i.isNotNull())

        def element(at: Column, i: Column, starts: Column) -> Column:
            first = F.get(body, at)
            mine = F.slice(body, at + 1, F.coalesce(F.get(starts, i + 1), F.size(body)) - at)
            return F.struct(i.alias("pos"), F.when(first["is_heading"], "HEADING").otherwise("PARAGRAPH").alias("type"),
                            F.aggregate(mine, F.lit(""), glue).alias("text"), first["level"].alias("level"), first["page"].alias("page_no"))

        return let(starts, lambda starts: F.transform(starts, lambda at, i: element(at, i, starts)))

    return let(F.filter(lines, lambda x: ~is_toc_entry(x["text"])), blocks)


def merge_paragraphs(lines: DataFrame) -> DataFrame:
    """Classified lines to element rows (doc_id, pos, type, text, level, page_no)."""
    return rows_of(nest_lines(lines, "body_font", "is_heading", "level"), paragraphs(F.col("lines")), "doc_id").select("doc_id", "item.*")


def layout_elements(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, page, page_count, max_font, text) to element rows: all steps inside the document's row, one exchange."""
    return rows_of(nest_lines(lines), let(classified(F.col("lines")), paragraphs), "doc_id").select("doc_id", "item.*")
