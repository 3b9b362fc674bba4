import random
import re

from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.operators import chunking as ch
from askloom.sources import corpus


def tokens(s):
    """The token rule in plain Python: Han characters, words, other visible characters, two special tokens."""
    s = re.sub(r"[\x00-\x1f\x7f-\x9f]", "", s)
    return len(re.findall(r"[\u4e00-\u9fff]|[^\W_\u4e00-\u9fff]+|[^\w\s]|_", s)) + 2 if s or False else (2 if s == "" else 0)


def rows(df):
    return df.orderBy("chunk_index").collect()


def test_count_tokens(spark):
    df = spark.createDataFrame([("",), (None,), ("ab\ncd",), ("数据 structure, v2!",)], "t string")
    assert [r[0] for r in df.select(tx.count_tokens(F.col("t"))).collect()] == [0, 0, 3, 8]


def test_fixed_chunks(spark, elements):
    r = rows(ch.fixed_chunks(elements(("PARAGRAPH", "顺序表是用一段地址连续的存储单元依次存储线性表的数据元素。" * 120, 0, 3))))
    assert len(r) > 3 and all(x.token_count <= 320 * 1.3 and x.page_no == 3 for x in r)
    assert ch.fixed_chunks(elements(("PARAGRAPH", "  ", 0, 1))).count() == 0


def test_fixed_chunks_page_of_start(spark, elements):
    r = rows(ch.fixed_chunks(elements(*[("PARAGRAPH", "数" * 300, 0, p) for p in (1, 2, 3)])))
    assert [x.page_no for x in r][0] == 1 and r[-1].page_no == 3 and [x.page_no for x in r] == sorted(x.page_no for x in r)


def test_recursive_chunks_paths_and_budget(spark, elements):
    para = "数据是信息的载体，能够被计算机识别、存储和加工处理的对象。" * 20
    r = rows(ch.recursive_chunks(elements(("HEADING", "第1章 绪论", 1, 1), ("HEADING", "1.1 基本术语", 2, 1), ("PARAGRAPH", para, 0, 1), ("PARAGRAPH", para, 0, 2))))
    assert len(r) >= 2 and all(x.token_count <= 398 and x.content.endswith("。") for x in r)
    assert {x.section_path for x in r} == {"第1章 绪论 > 1.1 基本术语"} and r[0].page_no == 1


def test_neighbours_overlap(spark, elements):
    sentences = "".join(f"第{i}句讲解线性表。" for i in range(200))
    r = rows(ch.recursive_chunks(elements(("PARAGRAPH", sentences, 0, 1))))
    for a, b in zip(r, r[1:]):
        assert b.content[:9] in a.content


def test_unpunctuated_text_terminates(spark, elements):
    r = rows(ch.recursive_chunks(elements(("PARAGRAPH", "没有标点的长文本" * 300 + "\n", 0, 1))))
    assert len(r) >= 2 and sum(len(x.content) for x in r) >= 2400


def test_structure_chunks(spark, elements):
    table = "| 算法 | 复杂度 |\n" + "| 快排 | O(nlogn) |\n" * 200
    para = "排序是计算机科学中的基本操作。" * 40
    r = rows(ch.structure_chunks(elements(("HEADING", "第8章 排序", 1, 5), ("PARAGRAPH", para, 0, 5), ("TABLE", table, 0, 6), ("PARAGRAPH", para, 0, 6),
                                          ("HEADING", "x" * 41, 2, 7), ("CODE", "int a;", 0, 7))))
    parents, children = [x for x in r if x.kind == "parent"], [x for x in r if x.kind == "child"]
    assert [x.chunk_index for x in r] == list(range(len(r))) and [x.kind for x in r] == ["parent"] * len(parents) + ["child"] * len(children)
    tables = [x for x in children if x.is_table]
    assert len(tables) == 1 and tables[0].content == table and parents[tables[0].parent_index].content == table
    assert all(x.section_path == "第8章 排序" for x in r)
    assert all(p.token_count <= 1224 for p in parents if not p.is_table)
    for c in children:
        if not c.is_table:
            assert c.content.split("\n")[0] in parents[c.parent_index].content
    assert not [x for x in children if x.content == "int a;"][0].is_table


def test_dispatch_unknown_strategy(spark, elements):
    docs = elements(("PARAGRAPH", "abc", 0, 1)).withColumn("chunk_strategy", F.lit("SEMANTIC"))
    assert {r.strategy for r in ch.chunk_corpus(docs).collect()} == {"STRUCTURE_AWARE"}


def test_section_paths_equal_a_stack(spark):
    rng = random.Random(5)
    docs, want = [], {}
    for d in range(40):
        items, stack, out = [], [], {}
        for i in range(rng.randint(1, 30)):
            if rng.random() < 0.5:
                level, title = rng.randint(1, 6), f"h{i}" + "x" * rng.choice([0, 50])
                items.append((i, "HEADING", title, level, 1))
                if len(title) <= 40:
                    stack = [s for s in stack if s[0] < level] + [(level, title)]
            else:
                items.append((i, "PARAGRAPH", f"p{i}", 0, 1))
                out[i] = " > ".join(s[1] for s in stack) or None
        docs.append((d, items))
        want[d] = out
    from askloom.schemas import ELEMENTS
    got = {}
    for r in ch.section_path(spark.createDataFrame(docs, f"doc_id bigint, elements {ELEMENTS}"), 40).collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.section_path
    assert got == {d: o for d, o in want.items() if o}


def pack_model(pieces, ends="。！？!?"):
    """Greedy packing in plain Python, for comparison."""
    out, cur, n = [], "", 0
    for text, t in pieces:
        if n > 0 and n + t > 368:
            if cur.strip():
                out.append((cur.strip(), n))
            tail, used = "", 0
            for s in reversed([x.strip() for x in re.split(f"(?<=[{ends}])", cur) if x.strip()]):
                if used + tokens(s) > 48:
                    break
                tail, used = s + tail, used + tokens(s)
            cur, n = tail, used
        cur, n = cur + text + "\n", n + t
    if cur.strip():
        out.append((cur.strip(), n))
    return out


def test_packing_equals_the_model(spark):
    rng = random.Random(3)
    docs = []
    for d in range(30):
        lines = ["".join(rng.choice("数据结构栈队列。！ab ") for _ in range(rng.randint(1, 120))).strip() or "x" for _ in range(rng.randint(1, 40))]
        docs.append((d, [(x, tokens(x), None, 1) for x in lines]))
    df = spark.createDataFrame(docs, "d bigint, pieces array<struct<text:string,tokens:int,section:string,page:int>>")
    for r in df.select("d", "pieces", ch.pack_pieces(F.col("pieces")).alias("out")).collect():
        assert [(c.text, c.tokens) for c in r.out] == pack_model([(p.text, p.tokens) for p in r.pieces])


def test_split_keeps_all_text(spark):
    text = "\n\n".join("一二三，四五六。" * 60 for _ in range(3)) + "尾" * 700
    parts = spark.createDataFrame([(text,)], "t string").select(tx.split_to_budget(F.col("t"), 320).alias("p")).first().p
    assert "".join(p.text for p in parts) == text.replace("\n", "") and all(p.tokens <= 322 for p in parts)


def test_preview_truncates_when_parents_fill_it(spark, elements):
    docs = elements(*[("CODE", f"c{i}", 0, 1) for i in range(150)])
    chunks = ch.structure_chunks(docs)
    assert ch.preview_chunks(chunks).filter("kind = 'child'").count() == 0
    assert ch.preview_header(chunks).first().truncated


def test_shingles(spark):
    df = spark.createDataFrame([("abc def ghi jkl",), ("short",), ("a" * 12,)], "t string")
    got = [sorted(r[0]) for r in df.select(tx.shingles(F.col("t"))).collect()]
    assert got == [["abcdefghij", "bcdefghijk", "cdefghijkl"], [], ["a" * 10]]


def test_word_class_is_letters_and_digits_but_han(spark):
    """Every code point: the class of the word pattern against the plain one."""
    points = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS ch")
    plain = F.col("ch").rlike(rf"\A[\p{{L}}\p{{N}}&&[^{tx.HAN}]]+\z")
    trimmed = F.regexp_replace(F.concat(F.lit("\x00 "), "ch", F.lit(" b"), "ch"), r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    wrong = points.filter((plain != F.col("ch").rlike(rf"\A{tx.WORD}\z")) | (trimmed != tx.trim_controls(F.concat(F.lit("\x00 "), "ch", F.lit(" b"), "ch"))))
    assert wrong.count() == 0


def test_texts_are_dealt_out_by_their_size(spark, tmp_path, monkeypatch):
    """A task of heavy text work gets a bounded share of the files, in one split or many, and every row arrives once."""
    spark.range(2000).selectExpr("id AS doc_id", "sha2(string(id), 512) AS text").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(corpus, "TASK_BYTES", 5000)
    for dealt in (corpus.spread(docs), corpus.spread(docs, "doc_id")):
        assert dealt.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and dealt.distinct().count() == dealt.count() == 2000
