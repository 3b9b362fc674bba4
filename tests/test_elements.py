from pyspark.sql import functions as F

from askloom.operators import elements as el, pagelayout


def md(spark, text):
    docs = el.parse_markdown(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    return [(r.type, r.text, r.level) for r in el.explode_elements(docs, "doc_id").orderBy("pos").collect()]


def test_markdown_block_kinds(spark):
    text = "# 第1章 绪论\n\n数据结构是\n计算机的基础。\n\n## 1.1 术语\n- 数据\n- 元素\n\n| 算法 | 复杂度 |\n|---|---|\n| 快排 | O(nlogn) |\n\n```java\nint x = 1;\n\n# no heading\n```\n"
    got = md(spark, text)
    assert [g[0] for g in got] == ["HEADING", "PARAGRAPH", "HEADING", "LIST", "TABLE", "CODE"]
    assert got[0][1:] == ("第1章 绪论", 1) and got[2][1:] == ("1.1 术语", 2)
    assert got[3][1] == "- 数据\n- 元素" and "# no heading" in got[5][1] and got[4][1].startswith("| 算法")


def test_markdown_details(spark):
    assert md(spark, "## T ##\n") == [("HEADING", "T", 2)]
    assert md(spark, "- a\n\n- b\n\np") == [("LIST", "- a\n\n- b", 0), ("PARAGRAPH", "p", 0)]
    assert md(spark, "text\n- item") == [("PARAGRAPH", "text", 0), ("LIST", "- item", 0)]
    assert md(spark, "> quoted\n> more") == [("PARAGRAPH", "quoted\nmore", 0)]
    assert md(spark, "    code\n    more\nplain") == [("CODE", "code\n    more", 0), ("PARAGRAPH", "plain", 0)]
    assert md(spark, "#hash no space") == [("PARAGRAPH", "#hash no space", 0)]
    assert md(spark, " \n\n ") == []


def test_many_blank_lines_and_quotes_do_not_overflow(spark):
    assert md(spark, "a" + "\n \n" * 30000 + "b") == [("PARAGRAPH", "a", 0), ("PARAGRAPH", "b", 0)]
    assert md(spark, ">" * 30000 + " deep") == [("PARAGRAPH", "deep", 0)]


def test_html_blocks(spark):
    html = ("<html><head><title>x</title></head><body><nav><p>menu</p></nav><h2>Title &amp; more</h2><p>one <b>two</b><p>three</p>"
            "<ul><li>a</li><li>b</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2\n3</td></tr></table><pre>x\n  y</pre></body></html>")
    docs = el.parse_html(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    got = [(r.type, r.text, r.level) for r in el.explode_elements(docs, "page_id").orderBy("pos").collect()]
    assert got == [("HEADING", "Title & more", 2), ("PARAGRAPH", "one two", 0), ("PARAGRAPH", "three", 0), ("LIST", "- a\n- b", 0),
                   ("TABLE", "| k | v |\n| 1 | 2 3 |", 0), ("CODE", "x\n  y", 0)]


def test_word_table_and_styles(spark):
    cells = [(1, 1, 1, 1, "算法"), (1, 1, 1, 2, "复杂度"), (1, 1, 2, 1, "快排"), (1, 1, 2, 2, " O(nlogn)\n")]
    df = spark.createDataFrame(cells, "doc_id bigint, table_no int, row_no int, col_no int, text string")
    assert el.table_rows_to_markdown(df, ["doc_id", "table_no"]).first().text == "| 算法 | 复杂度 |\n| 快排 | O(nlogn) |"
    styles = spark.createDataFrame([("Heading1",), ("heading 6",), ("标题 2",), ("Normal",), (None,)], "style string")
    assert [r.level for r in el.style_to_heading_level(styles).collect()] == [1, 4, 2, 0, 0]


def test_page_layout(spark):
    lines = [
        (1, 10, 1, 2, 9.0, "Data Structures 2024"), (1, 11, 1, 2, 16.0, "Chapter One Basics"), (1, 12, 1, 2, 11.0, "A tree is"),
        (1, 13, 1, 2, 11.0, "a connected graph."), (1, 14, 1, 2, 11.0, "Contents ...... 12"), (1, 19, 1, 2, 9.0, "1"),
        (1, 20, 2, 2, 9.0, "Data Structures 2025"), (1, 21, 2, 2, 11.0, "It has no cycles."), (1, 29, 2, 2, 9.0, "2")]
    df = spark.createDataFrame(lines, "doc_id bigint, line_no int, page int, page_count int, max_font double, text string")
    got = [(r.type, r.text, r.level, r.page_no) for r in pagelayout.layout_elements(df).orderBy("pos").collect()]
    assert got == [("HEADING", "Chapter One Basics", 1, 1), ("PARAGRAPH", "A tree is a connected graph.", 0, 1), ("PARAGRAPH", "It has no cycles.", 0, 2)]


def test_cluster_lines_uses_first_run_as_anchor(spark):
    runs = [(1, 1, 1, 10.0, 9.0, "a"), (1, 1, 2, 12.0, 12.0, "b"), (1, 1, 3, 13.0, 9.0, "c"), (1, 2, 1, 13.0, 9.0, "d"), (1, 2, 2, 13.0, 9.0, "  ")]
    df = spark.createDataFrame(runs, "doc_id bigint, page int, seq int, y double, font double, text string")
    got = sorted((r.page, r.page_line, r.text, r.max_font) for r in pagelayout.cluster_lines(df).collect())
    assert got == [(1, 0, "ab", 12.0), (1, 1, "c", 9.0), (2, 0, "d", 9.0)]


def test_body_font_tie_goes_to_the_first_to_reach_the_count(spark):
    lines = [(1, 1, 12.0), (1, 2, 10.0), (1, 3, 10.4), (1, 4, 12.0), (2, 1, 0.0)]
    df = spark.createDataFrame(lines, "doc_id bigint, line_no int, max_font double")
    assert {r.doc_id: r.body_font for r in pagelayout.body_font_mode(df).collect()} == {1: 10, 2: 10}


def test_empty_document_is_a_status_row(spark):
    docs = el.parse_markdown(spark.createDataFrame([(1, " \n "), (2, "x")], "doc_id bigint, text string"))
    assert {r.doc_id: r.status for r in el.empty_document_status(docs).collect()} == {1: "FAILED", 2: "READY"}


def test_nest_is_the_inverse_of_explode(spark):
    docs = el.parse_markdown(spark.createDataFrame([(1, "# a\n\nb\n\nc")], "doc_id bigint, text string"))
    back = el.nest_elements(el.explode_elements(docs, "doc_id"))
    assert back.select(F.to_json("elements")).first()[0] == docs.select(F.to_json("elements")).first()[0]
