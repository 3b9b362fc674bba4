"""Reading cards: chunks without a parent are spread, paragraphs are read at their beginning."""

import random
import re

from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.operators import reading


def test_chunks_without_a_parent_are_spread(spark):
    chunks = spark.range(400).selectExpr("id AS chunk_id", "id AS doc_id", "0 AS chunk_index", "CAST(NULL AS BIGINT) AS parent_id", "'t' || id AS content",
                                         "CAST(NULL AS STRING) AS section_path", "1 AS page_no")
    kids = spark.range(400).selectExpr("id + 1000 AS chunk_id", "id AS doc_id", "1 AS chunk_index", "id AS parent_id", "'k' || id AS content",
                                       "CAST(NULL AS STRING) AS section_path", "1 AS page_no")
    docs = spark.range(400).selectExpr("id AS doc_id", "1L AS kb_id", "'f' AS file_name")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        cards = reading.chunk_context(chunks.unionByName(kids), docs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(cards) == 800 and len({c.task for c in cards if c.parent_id is None}) > 1
    assert all(c.parent_content == (None if c.parent_id is None else f"t{c.parent_id}") for c in cards)


def test_paragraphs_are_read_at_their_beginning(spark):
    rng = random.Random(7)

    def made(n):
        return "".join(rng.choice("ab \t😀 漢") for _ in range(n))

    rows = [(i, made(rng.choice([0, 1, 5, 60])), "\n\n".join(made(rng.randint(0, 70)) for _ in range(4))) for i in range(150)]
    rows += [(i, k, f"xx {k}\n{' ' * 50}{k}\nxxxxx{k}\nxxxx{k}") for i, k in enumerate(["a b", "漢" * 30, "😀" * 21, " q" * 40], 900)]
    cards = spark.createDataFrame([*rows, (999, None, "a"), (998, "a", None)], "chunk_id bigint, content string, parent_content string")
    got = {(r.chunk_id, r.text): r.hit for r in reading.highlight_paragraphs(cards).collect()}

    def bare(s):
        return re.sub(r"[ \t\n\x0b\f\r]+", "", s)

    for i, content, parent in rows:
        key = bare(content)[:20]
        for p in re.split(r"\n+", parent):
            if p.strip(tx.BLANKS):
                assert got[i, p] == (len(key) > 0 and 0 <= bare(p).find(key) <= 4), (key, p)
    assert got[999, "a"] is None and not any(k[0] == 998 for k in got)
    plan = reading.highlight_paragraphs(cards)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" in plan
