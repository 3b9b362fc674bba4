"""Elements to chunks. Each document is cut inside its own row, so chunking a corpus needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.arrays import rows_of
from askloom.functions.text import (
    SENTENCE_ENDS, SEPARATORS, count_tokens, is_blank, let, split_to_budget, tail_sentences, trim_controls,
    windows,
)

# ---- fixed values: budgets of the three strategies ----
TARGET_TOKENS = 320
OVERLAP_TOKENS = 48
OVERLAP_RATIO = 0.15
MIN_WINDOW_CHARS = 50
PARENT_TOKENS = 1024
HEADING_MAX_CHARS = 40
PATH_CHARS = 512
PATH_SEPARATOR = " > "
PREVIEW_BLOCKS = 150
PREVIEW_CHARS = 500
# ---- end of fixed values ----

_PIECE = "struct<text:string,tokens:int,section:string,page:int>"
_CHUNK = "struct<kind:string,parent_index:int,content:string,token_count:int,section_path:string,page_no:int,is_table:boolean>"


def _empty(item: str) -> Column:
    return F.expr(f"cast(array() as array<{item}>)")


def _paths(headings: Column, max_heading_chars: int | None) -> Column:
    """Section path in force after each heading: an entry of the open path is closed by the next heading of its
    level or above. A heading longer than ``max_heading_chars`` leaves the path as it is."""
    start = F.struct(_empty("struct<level:int,text:string>").alias("open"), _empty("string").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        grown = F.concat(F.filter(acc["open"], lambda o: o["level"] < h["level"]),
                         F.array(F.struct(h["level"].alias("level"), h["text"].alias("text"))))
        opened = grown if max_heading_chars is None else F.when(
            F.length(h["text"]) <= max_heading_chars, grown).otherwise(acc["open"])
        return let(opened, lambda o: F.struct(
            o.alias("open"),
            F.concat(acc["out"], F.array(F.when(F.size(o) > 0, F.array_join(
                F.transform(o, lambda x: x["text"]), PATH_SEPARATOR)))).alias("out")))

    return F.aggregate(headings, start, step, lambda acc: acc["out"])


def sections(elements: Column, max_heading_chars: int | None = None) -> Column:
    """Cut the elements at their headings: array of struct(section, body elements without headings)."""
    def cut(els: Column, heads: Column, paths: Column) -> Column:
        def one(i: Column) -> Column:
            begin = F.when(i == 0, F.lit(1)).otherwise(F.get(heads, i - 1)["pos"] + 2)
            end = F.coalesce(F.get(heads, i)["pos"] + 1, F.size(els) + 1)
            return F.struct(F.get(paths, i - 1).alias("section"),
                            F.slice(els, begin, F.greatest(end - begin, F.lit(0))).alias("body"))
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(heads)), one), lambda s: F.size(s["body"]) > 0)

    return let(elements, lambda els: let(
        F.filter(els, lambda e: e["type"] == "HEADING"),
        lambda heads: let(_paths(heads, max_heading_chars), lambda paths: cut(els, heads, paths))))


def section_path(docs: DataFrame, max_heading_chars: int | None = None, key: str = "doc_id") -> DataFrame:
    """One row per body element with its section path, outer heading first."""
    paths = F.flatten(F.transform(sections(F.col("elements"), max_heading_chars), lambda s: F.transform(
        s["body"], lambda e: F.struct(s["section"].alias("section_path"), e.alias("e")))))
    return (rows_of(docs, paths, key).select(key, "item.*")
            .select(key, F.col("e.pos").alias("pos"), F.col("e.type").alias("type"), F.col("e.text").alias("text"),
                    "section_path", F.col("e.page_no").alias("page_no")))


def pieces_of(body: Column, section: Column, separators: Sequence[str] = SEPARATORS, budget: int = TARGET_TOKENS,
              counted: bool = False) -> Column:
    """Body elements to counted pieces of at most ``budget`` tokens; ``counted`` elements carry their ``tokens``."""
    return F.flatten(F.transform(body, lambda e: F.transform(
        split_to_budget(e["text"], budget, separators, e["tokens"] if counted else None),
        lambda t: F.struct(t["text"].alias("text"), t["tokens"].alias("tokens"), section.alias("section"),
                           e["page_no"].alias("page"))))).cast(f"array<{_PIECE}>")


def pack_pieces(pieces: Column, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS,
                sentence_ends: str = SENTENCE_ENDS) -> Column:
    """Pack neighbouring pieces up to ``target + overlap`` tokens: array of struct(text, tokens, section, page).

    A chunk that follows another opens with the last whole sentences of it. The token count is the sum of the
    pieces' counts; section and page are the first piece's, an overlap carries those of the piece after it.
    """
    def done(acc: Column) -> Column:
        text = trim_controls(acc["text"])
        return F.when(F.length(text) > 0, F.concat(acc["out"], F.array(F.struct(
            text.alias("text"), acc["tokens"].alias("tokens"), F.substring(acc["section"], 1, PATH_CHARS).alias("section"),
            acc["page"].alias("page"))))).otherwise(acc["out"])

    def state(out: Column, text: Column, tokens: Column, section: Column, page: Column) -> Column:
        return F.struct(out.alias("out"), text.alias("text"), tokens.alias("tokens"), section.alias("section"),
                        page.alias("page"))

    def add(base: Column, p: Column) -> Column:
        opens = base["tokens"] == 0
        return state(base["out"], F.concat(base["text"], p["text"], F.lit("\n")), base["tokens"] + p["tokens"],
                     F.when(opens, p["section"]).otherwise(base["section"]),
                     F.when(opens, p["page"]).otherwise(base["page"]))

    def step(acc: Column, p: Column) -> Column:
        overflows = (acc["tokens"] > 0) & (acc["tokens"] + p["tokens"] > target + overlap)
        return F.when(overflows, let(tail_sentences(acc["text"], overlap, sentence_ends), lambda t: add(
            state(done(acc), t["text"], t["tokens"], p["section"], p["page"]), p))).otherwise(add(acc, p))

    start = state(_empty(_PIECE), F.lit(""), F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("int"))
    return F.aggregate(pieces, start, step, done)


def _child(parent_index: Column, piece: Column, is_table: Column) -> Column:
    return F.struct(F.lit("child").alias("kind"), parent_index.alias("parent_index"), piece["text"].alias("content"),
                    piece["tokens"].alias("token_count"), piece["section"].alias("section_path"),
                    piece["page"].alias("page_no"), is_table.alias("is_table"))


def _explode_chunks(docs: DataFrame, chunks: Column, strategy: str, key: str) -> DataFrame:
    return (rows_of(docs, chunks.cast(f"array<{_CHUNK}>"), key, pos="chunk_index", item="c")
            .select(key, F.lit(strategy).alias("strategy"), "chunk_index", "c.*"))


def fixed_chunks(docs: DataFrame, target: int = TARGET_TOKENS, overlap: float = OVERLAP_RATIO, key: str = "doc_id") -> DataFrame:
    """Windows of equal width over the whole text, the width from the document's characters per token."""
    text = F.array_join(F.transform("elements", lambda e: F.concat(e["text"], F.lit("\n"))), "")

    def page_ends(els: Column) -> Column:
        """(end offset, page) of each run of elements on one page."""
        acc0 = F.struct(_empty("struct<stop:int,page:int>").alias("out"), F.lit(0).alias("len"),
                        F.lit(None).cast("int").alias("page"))

        def step(a: Column, e: Column) -> Column:
            turned = F.when((a["len"] > 0) & ~a["page"].eqNullSafe(e["page_no"]), F.concat(
                a["out"], F.array(F.struct(a["len"].alias("stop"), a["page"].alias("page"))))).otherwise(a["out"])
            return F.struct(turned.alias("out"), (a["len"] + F.length(e["text"]) + 1).alias("len"),
                            e["page_no"].alias("page"))
        return F.aggregate(els, acc0, step, lambda a: F.concat(
            a["out"], F.array(F.struct(a["len"].alias("stop"), a["page"].alias("page")))))

    def cut_up(t: Column, n: Column, els: Column) -> Column:
        wide = (F.lit(float(target)) * (F.length(t).cast("double") / n)).cast("int")

        def cuts(w: Column, ends: Column) -> Column:
            step = F.greatest((w * F.lit(1 - overlap)).cast("int"), F.lit(1))
            width = F.greatest(w, F.lit(MIN_WINDOW_CHARS))
            last = F.greatest(F.ceil((F.length(t) - width) / step).cast("int"), F.lit(0))
            raw = F.transform(F.slice(windows(t, step, width), 1, last + 1), lambda cut, i: F.struct(
                trim_controls(cut).alias("text"),
                F.get(F.filter(ends, lambda e: i * step < e["stop"]), F.lit(0))["page"].alias("page")))
            return F.transform(F.filter(raw, lambda c: F.length(c["text"]) > 0), lambda c: _child(
                F.lit(None).cast("int"),
                F.struct(c["text"].alias("text"), count_tokens(c["text"]).alias("tokens"),
                         F.lit(None).cast("string").alias("section"), c["page"].alias("page")), F.lit(False)))
        return let(wide, lambda w: let(page_ends(els), lambda ends: cuts(w, ends)))

    chunks = let(F.col("elements"), lambda els: let(text, lambda t: F.when(is_blank(t), _empty(_CHUNK)).otherwise(
        let(count_tokens(t), lambda n: cut_up(t, n, els)))))
    return _explode_chunks(docs, chunks, "FIXED", key)


def recursive_chunks(docs: DataFrame, separators: Sequence[str] = SEPARATORS, sentence_ends: str = SENTENCE_ENDS,
                     key: str = "doc_id") -> DataFrame:
    """Section paths, split to budget, packed with overlap; headings are no content and there are no parents."""
    pieces = F.flatten(F.transform(sections(F.col("elements")), lambda s: pieces_of(s["body"], s["section"], separators)))
    chunks = F.transform(pack_pieces(pieces, sentence_ends=sentence_ends),
                         lambda p: _child(F.lit(None).cast("int"), p, F.lit(False)))
    return _explode_chunks(docs, chunks, "RECURSIVE", key)


def _parent_groups(body: Column, parent_tokens: int) -> Column:
    """Cut a section's counted body into parents: array of struct(from, size, atomic). A group closes once it is over
    budget, and around tables and code, which stand alone."""
    start = F.struct(_empty("struct<from:int,size:int,atomic:boolean>").alias("out"), F.lit(0).alias("seen"),
                     F.lit(0).alias("size"), F.lit(0).alias("tokens"))

    def close(a: Column) -> Column:
        return F.when(a["size"] > 0, F.concat(a["out"], F.array(F.struct(
            (a["seen"] - a["size"]).alias("from"), a["size"].alias("size"), F.lit(False).alias("atomic"))))
        ).otherwise(a["out"])

    def state(out: Column, seen: Column, size: Column, tokens: Column) -> Column:
        return F.struct(out.alias("out"), seen.alias("seen"), size.alias("size"), tokens.alias("tokens"))

    def step(a: Column, e: Column) -> Column:
        alone = F.array(F.struct(a["seen"].alias("from"), F.lit(1).alias("size"), F.lit(True).alias("atomic")))
        joined = let(a["tokens"] + e["tokens"], lambda n: let(
            state(a["out"], a["seen"] + 1, a["size"] + 1, n), lambda b: F.when(
                n > parent_tokens, state(close(b), b["seen"], F.lit(0), F.lit(0))).otherwise(b)))
        return F.when(e["type"].isin("TABLE", "CODE"),
                      state(F.concat(close(a), alone), a["seen"] + 1, F.lit(0), F.lit(0))).otherwise(joined)

    return F.aggregate(body, start, step, close)


def parents_of(elements: Column, parent_tokens: int = PARENT_TOKENS,
               max_heading_chars: int | None = HEADING_MAX_CHARS) -> Column:
    """Parent blocks: array of struct(content, section, page, is_table, atomic, body); the elements of a body carry their ``tokens``."""
    def block(s: Column, g: Column) -> Column:
        return let(F.slice(s["body"], g["from"] + 1, g["size"]), lambda body: F.struct(
            F.when(g["atomic"], F.get(body, F.lit(0))["text"]).otherwise(trim_controls(
                F.array_join(F.transform(body, lambda e: e["text"]), "\n\n"))).alias("content"),
            F.substring(s["section"], 1, PATH_CHARS).alias("section"),
            F.get(body, F.lit(0))["page_no"].alias("page"),
            (F.get(body, F.lit(0))["type"] == "TABLE").alias("is_table"), g["atomic"].alias("atomic"), body.alias("body")))

    counted = F.transform(elements, lambda e: e.withField("tokens", count_tokens(e["text"])))
    return F.flatten(F.transform(sections(counted, max_heading_chars), lambda s: F.transform(
        _parent_groups(s["body"], parent_tokens), lambda g: block(s, g))))


def structure_chunks(docs: DataFrame, parent_tokens: int = PARENT_TOKENS, separators: Sequence[str] = SEPARATORS,
                     sentence_ends: str = SENTENCE_ENDS, key: str = "doc_id") -> DataFrame:
    """Parents (returned to the reader) followed by their children (searched); a table or code block is one
    parent with one identical child."""
    def children(p: Column, i: Column) -> Column:
        whole = F.array(F.struct(p["content"].alias("text"), count_tokens(p["content"]).alias("tokens"),
                                 p["section"].alias("section"), p["page"].alias("page")))
        packed = pack_pieces(pieces_of(p["body"], p["section"], separators, counted=True), sentence_ends=sentence_ends)
        return F.transform(F.when(p["atomic"], whole).otherwise(packed), lambda c: _child(i, c, p["is_table"]))

    def parent(p: Column) -> Column:
        return F.struct(F.lit("parent").alias("kind"), F.lit(None).cast("int").alias("parent_index"),
                        p["content"].alias("content"), count_tokens(p["content"]).alias("token_count"),
                        p["section"].alias("section_path"), p["page"].alias("page_no"), p["is_table"].alias("is_table"))

    chunks = let(parents_of(F.col("elements"), parent_tokens), lambda ps: F.concat(
        F.transform(ps, parent), F.flatten(F.transform(ps, children))))
    return _explode_chunks(docs, chunks, "STRUCTURE_AWARE", key)


CHUNKERS: dict[str, Callable[..., DataFrame]] = {
    "FIXED": fixed_chunks,
    "RECURSIVE": recursive_chunks,
    "STRUCTURE_AWARE": structure_chunks,
}


def chunk_corpus(docs: DataFrame, strategy: str = "chunk_strategy", key: str = "doc_id",
                 chunkers: dict[str, Callable[..., DataFrame]] | None = None, **options: dict) -> DataFrame:
    """Chunk every document by the strategy named in its column; an unknown name means structure-aware.

    ``options`` maps a strategy to keyword arguments of its chunker.
    """
    chunkers = chunkers or CHUNKERS
    chosen = F.when(F.col(strategy).isin(*chunkers), F.col(strategy)).otherwise("STRUCTURE_AWARE")
    marked = docs.withColumn("_strategy", chosen)
    out = None
    for name, chunker in chunkers.items():
        part = chunker(marked.filter(F.col("_strategy") == name), key=key, **options.get(name, {}))
        out = part if out is None else out.unionByName(part)
    return out


def preview_chunks(chunks: DataFrame, max_blocks: int = PREVIEW_BLOCKS, chars: int = PREVIEW_CHARS, key: str = "doc_id") -> DataFrame:
    """First blocks per document, parents before children, contents cut. ``chunk_index`` has that order already."""
    shown = chunks.filter(F.col("chunk_index") < max_blocks)
    cut = F.when(F.length("content") <= chars, F.col("content")).otherwise(
        F.concat(F.substring("content", 1, chars), F.lit("…")))
    return shown.select(key, "kind", "chunk_index", "token_count", "section_path", "page_no", cut.alias("content"))


def preview_header(chunks: DataFrame, max_blocks: int = PREVIEW_BLOCKS, key: str = "doc_id") -> DataFrame:
    """Counts, child tokens and the truncated flag, set as soon as parents alone fill the preview."""
    parents, total = F.count_if(F.col("kind") == "parent"), F.count(F.lit(1))
    return chunks.groupBy(key).agg(
        parents.alias("parent_count"), F.count_if(F.col("kind") == "child").alias("child_count"),
        F.coalesce(F.sum(F.when(F.col("kind") == "child", F.col("token_count"))), F.lit(0)).alias("child_tokens"),
        ((parents >= max_blocks) | (total > max_blocks)).alias("truncated"))


def document_token_total(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sum of the child token counts per document; overlaps count twice."""
    return chunks.filter(F.col("kind") == "child").groupBy(key).agg(F.sum("token_count").alias("token_count"))


def chunk_id(doc_id: Column, strategy: Column, chunk_index: Column) -> Column:
    """Stable id from document, strategy and position: up to 2^24 chunks per document and strategy."""
    number = F.when(strategy == "FIXED", 0).when(strategy == "RECURSIVE", 1).otherwise(2)
    return (doc_id * F.lit(4 << 24) + number * F.lit(1 << 24) + chunk_index).cast("bigint")
