"""Filter audit, Merkle manifest and line dedup against plain Python, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.llm import filter_audit, line_dedup, merkle, paragraph_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# ---- filter audit ----

def fails_of(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    found = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        bad = {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        bad |= {"D"} if re.search("[#$%&*|]", text) else set()
        bad |= {"E"} if doc_id is not None and doc_id > first[text] else set()
        found.append(bad)
    return found


def audit_by_hand(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    judged = [(r[3] or "", r[0], bad) for r, bad in zip(rows, fails_of(rows), strict=True)]
    out, summed = {}, Counter()
    for part in {p for p, _, _ in judged}:
        mine = [(d, bad) for p, d, bad in judged if p == part]
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                before = set(order[:i])
                here = [d for d, bad in mine if f in bad and not bad & before]
                summed[part, f] += len(here)
                out[part, "".join(order), i + 1] = [
                    sum(not bad & (before | {f}) for _, bad in mine), len(here), sum(f in bad and bool(bad & before) for _, bad in mine),
                    sum(bad == {f} for _, bad in mine), sum(d in good for d in here), sum(d in toxic for d in here)]
    return {k: (*v, summed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def many_words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n))


@pytest.fixture(scope="module")
def audited():
    base = [many_words(210, i) for i in range(12)]
    rows = []
    for i in range(120):
        text = base[i % 12]
        if i % 5 == 1:
            text = text[:300]
        if i % 7 == 2:
            text = "word word\n" * 150 + text
        if i % 11 == 3:
            text = text.upper()
        if i % 13 == 4:
            text += " 50% off | now"
        rows.append((i // 2 if i % 10 == 9 else i, text, "en", ["s1", "s2", "", None][i % 4], 1))
    rows += [(None, base[0], "en", "s1", 1), (None, base[0], "en", "s1", 1), (None, None, None, None, None), (500, None, None, "s2", None), (501, "", None, "s2", None)]
    rows += [(7, base[7], "en", "s3", 1)] * 3
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(None, 1, 1), (7, 1, 0), (7, None, 1)]
    return rows, labels


def test_audit_counts_every_order(spark, audited):
    rows, labels = audited
    docs = spark.createDataFrame(rows, DOCS).withColumns({"part": F.lit("x"), "id": F.lit(3), "n": F.lit(9), "_bit": F.lit(1), "A": F.lit(True)})
    out = filter_audit.audit_documents(docs, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("x")))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}
    assert got == audit_by_hand(rows, labels)


def test_audit_of_no_rows_and_no_labels(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(empty, none).count() == 0
    clean = [(1, many_words(300, 1), "en", "s", 1)]
    out = filter_audit.audit_documents(spark.createDataFrame(clean, DOCS), none).collect()
    assert len(out) == 600 and {(r.kept, r.removed, r.shapley) for r in out} == {(1, 0, 0)}


def test_audit_of_other_filters(spark):
    ids = spark.createDataFrame([(b"a", 1, "p", 1), (b"b", 2, "p", 2), (b"c", 3, "q", 1)], "id binary, doc_id bigint, part string, n bigint")
    fails = {"X": ids.filter("doc_id <= 2"), "Y": ids.filter("doc_id = 2")}
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(ids, fails, {}).collect()}
    assert out["p", "XY", 1] == (0, 3, 0, 1, 4) and out["p", "XY", 2] == (0, 0, 2, 0, 2)
    assert out["p", "YX", 1] == (1, 2, 0, 0, 2) and out["p", "YX", 2] == (0, 1, 2, 1, 4)
    assert out["q", "XY", 2] == (1, 0, 0, 0, 0) and len(out) == 8


def test_audit_refuses_too_many_filters(spark):
    ids = spark.createDataFrame([], "id binary, doc_id bigint, part string, n bigint")
    with pytest.raises(ValueError):
        filter_audit.audit(ids, {}, {})
    with pytest.raises(ValueError):
        filter_audit.audit(ids, {c: ids for c in "ABCDEFG"}, {})


def test_copies_of_one_text_are_told_apart_by_id(spark):
    rows = spark.createDataFrame([(i, "t") for i in (5, 3, 9, 3)] + [(None, "t"), (None, "u"), (4, "u")], "doc_id bigint, text_key string")
    assert sorted(r.doc_id for r in filter_audit.later_copies(rows).collect()) == [5, 9]


# ---- Merkle manifest ----

def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_by_hand(doc_id, text, lang, source, n_chars):
    return sha("".join(map(shown, (doc_id, source, lang, n_chars, text))))


def climb(nodes):
    """Root and, per node, its siblings as (left, right) from the bottom up."""
    paths, spots = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, places = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at:at + 8]
            for k in range(len(run)):
                for leaf in spots[at + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(sha("".join(run)))
            places.append([leaf for k in range(len(run)) for leaf in spots[at + k]])
        nodes, spots = above, places
    return nodes[0], paths


def manifest_by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf_by_hand(*r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(*r)))]) for g in names}
    root, upper = climb([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper, strict=True):
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(*r)))
        for r, below in zip(ordered, trees[g][1], strict=True):
            path = below + above
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                changed = (r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            node = leaf_by_hand(*changed)
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], leaf_by_hand(*r), trees[g][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows, extra=()):
    df = spark.createDataFrame(rows, DOCS)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    got = merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted([tuple(r) for r in got], key=str)


@pytest.mark.parametrize("count", [1, 8, 9, 65])
def test_manifest_of_one_group(spark, count):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(count)]
    assert manifest_rows(spark, rows) == manifest_by_hand(rows)


def test_manifest_of_groups_nulls_and_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(200), f"Größe {rng.randrange(40)} ÄB", rng.choice(["en", "de", None, "", "zz"]), rng.choice(["s", None]), rng.choice([1, None])) for _ in range(400)]
    rows += [(None, None, None, None, None)] * 30 + [(6, "SAME", "en", "s", 4)] * 90 + [(77, "", "lone", "s", 0)]
    rows += [(i, "Z" * 50_000, f"l{i}", "s", 1) for i in range(900, 920)]
    assert manifest_rows(spark, rows, ("grp", "pos", "total", "node", "seq", "tie", "path")) == manifest_by_hand(rows)


def test_manifest_of_blocks_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, f"T{i}", f"g{i % 3}" if i < 700 else f"h{i}", "s", 1) for i in range(800)]
    assert manifest_rows(spark, rows) == manifest_by_hand(rows)


def test_manifest_finds_what_was_tampered_with(spark):
    rows = [(i, "UPPER" if i % 2 else "lower", "en", "s", 1) for i in range(40)]
    told = {r[0]: r[6] for r in manifest_rows(spark, rows)}
    assert told == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(40)}


def test_manifest_of_no_rows(spark):
    out = merkle.manifest(spark.createDataFrame([], DOCS))
    assert out.count() == 0 and dict(out.dtypes)["verified"] == "boolean"


# ---- line dedup ----

def lines_by_hand(rows):
    def key(line):
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
        return k if len(k) >= 10 else None
    first = {}
    rank = lambda d: (d is None, d or 0)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                first[key(line)] = min(first.get(key(line), doc_id), doc_id, key=rank)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) is None or first[key(line)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def dedup(spark, rows, extra=()):
    df = spark.createDataFrame(rows, DOCS)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return sorted([tuple(r) for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).collect()], key=str)


def test_lines_against_plain_python(spark):
    rng = random.Random(5)
    pool = [f"A shared Line number {i}" for i in range(30)] + ["short", "", "   ", "ninechars", "tencharsxx", "zehn Zei…ü", "  nbsp line here "]
    rows = []
    for i in range(300):
        lines = [rng.choice(["", " ", "\t\v", "\f\r"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(["", "  ", "\r"]) for _ in range(rng.randrange(12))]
        rows.append((i // 2 if i % 9 == 0 else i, "\n".join(["One line that a third of all holds", *lines]) if i % 3 else "\n".join(lines), "en", "s", 1))
    rows += [(None, "One line that a third of all holds\nonly in rows without id", "en", "s", 1), (None, "only in rows without id", "en", "s", 1)]
    rows += [(4, "repeated row line\nrepeated row line", "en", "s", 1)] * 3 + [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "\n\n", "en", "s", 2)]
    rows += [(903, "a very long line " * 20_000 + "\n" + "\n".join(f"line number {j} of many" for j in range(20_000)), "en", "s", 1), (904, "line number 77 of many", "en", "s", 1)]
    assert dedup(spark, rows, ("row", "keep", "n_lines", "tie", "h1", "kind", "pos")) == lines_by_hand(rows)


def test_lines_of_one_key_over_all_partitions(spark):
    rows = [(i, "the very same line", "en", "s", 1) for i in range(999, -1, -1)]
    assert dedup(spark, rows) == lines_by_hand(rows)
    bitmaps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, DOCS))
    assert bitmaps.agg(F.sum("n_dropped")).first()[0] == 999


def test_lines_of_no_rows(spark):
    df = spark.createDataFrame([], DOCS)
    assert line_dedup.keep_bitmaps(df).count() == 0 and dedup(spark, []) == []


@pytest.mark.parametrize("cuts", [[3], [1, 2], [4, 4, 9], [1, 1, 1, 1, 1, 1]])
def test_stream_over_batches_and_partitions(cuts):
    """The stream's drops, and the waiting lines that the claims overrule, are the lines outside their key's first document however the sort is cut."""
    rng = random.Random(len(cuts))
    rows = sorted([(rng.randrange(3), 0, rng.choice([None, 1, 2, 3]), b"r", p) for p in range(40)], key=lambda r: (r[0], r[2] is None, r[2] or 0, r[4]))
    first = {}
    for h, _, d, *_ in rows:
        first.setdefault(h, d)
    want = sorted((h, p) for h, _, d, _, p in rows if d != first[h])
    parts = np.array_split(np.arange(40), 3)
    dropped, waiting, claims = [], [], {}
    for part in parts:
        mine = [rows[i] for i in part]
        batches, at = [], 0
        for c in [*cuts, len(mine)]:
            batches.append(pa.RecordBatch.from_pylist(
                [{"h1": a, "h2": b, "doc_id": d, "row": r, "pos": p, "tie": 0} for a, b, d, r, p in mine[at:at + c]],
                schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.binary()), ("pos", pa.int32()), ("tie", pa.int64())])))
            at += c
        for b in line_dedup._stream_firsts(iter(batches)):
            for r in b.to_pylist():
                if r["kind"] == line_dedup.DROPPED:
                    dropped.append((r["h1"], r["pos"]))
                elif r["kind"] == line_dedup.WAITING:
                    waiting.append((r["h1"], r["pos"], r["doc_id"]))
                else:
                    old = claims.get(r["h1"], r["doc_id"])
                    claims[r["h1"]] = min(old, r["doc_id"], key=lambda d: (d is None, d or 0))
    assert sorted(dropped + [(h, p) for h, p, d in waiting if d != claims[h]]) == want


def test_bitmaps_round_trip():
    for n, dropped in ((1, []), (1, [0]), (9, [0, 8]), (1000, list(range(0, 1000, 3)))):
        keep = line_dedup.unpack(line_dedup.pack(n, np.array(dropped, int)), n)
        assert len(keep) == n and np.flatnonzero(~keep).tolist() == dropped


# ---- pieces ----

def test_codec_slices_and_clashing_columns(spark, monkeypatch):
    from askloom.llm import pieces
    monkeypatch.setattr(pieces, "SLICE_BYTES", 64)
    monkeypatch.setattr(pieces, "WORD_BYTES", 1000)
    texts = ["", None, "one", "Größe über alles " * 40, "a  b\t c▁d", "x" * 300, None, "日本 🙂", ""] * 3
    df = spark.createDataFrame([(i, t, "keep", [1]) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, piece_ids array<int>").coalesce(1)
    coded = pieces.encode(df)
    assert coded.columns == ["doc_id", "text", "decoded", "piece_ids"]
    rows = {r.doc_id: r for r in pieces.decode(coded).collect()}
    assert len(rows) == len(texts) and all(rows[i].decoded == t for i, t in enumerate(texts))
    assert rows[0].piece_ids == [] and rows[1].piece_ids is None and all(rows[i].piece_ids == rows[i + 9].piece_ids for i in range(9))


# ---- pages ----

def read_page(source):
    from askloom.llm.html_text import Page
    return [text for _, text in Page(source).blocks]


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>t</title><body><article><p>Hello</p></article>", ["Hello"]),
    ("<head><meta charset=utf-8><style>p{}</style><p>One<p>Two", ["One", "Two"]),
    ("<head><title>t</title>Text right after the head", ["Text right after the head"]),
    ("<html><head><title>t</title></head><body><p>Closed</p></body></html>", ["Closed"]),
    ("<p>a<!-->b</p><p>c<!--->d</p><p>e<!-- x --!>f</p><p>g<!-- never closed", ["ab", "cd", "ef", "g"]),
    ("<p title=it's>one</p><p title=\"a>b\" class='x y'>two</p><p data-a = b\"c>three</p>", ["one", "two", "three"]),
    ("<p>" + "<b>" * 40 + "deep<div>next</div>", ["deep", "next"]),
    ("<p title=\"open>lost</p>", ["lost"]),
    ("", []), ("   ", []), ("<head>", []),
])
def test_pages_with_missing_ends_and_odd_attributes(source, want):
    assert read_page(source) == want


def test_every_attribute_word_counts():
    from askloom.llm.html_text import Page
    words = " ".join(["x" + chr(97 + i % 26) for i in range(30)])
    assert "sidebar" in Page(f'<div class="{words} sidebar">t</div>').attributes[1]


def test_very_long_page_is_read_whole():
    many = "".join(f"<p>paragraph {i}</p>" for i in range(20_000))
    assert len(read_page("<html><head><body>" + many)) == 20_000


def test_every_link_of_paragraphs_is_found(spark):
    """Copies that change the last three words of a paragraph share 29 of 35 shingles: all of them are links."""
    rng = random.Random(31)
    docs = []
    for i in range(300):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(51)]
        text = " ".join(words)
        _, begin, end, _, _, _ = paragraph_dedup.cut_paragraphs([text.encode()])
        whole = text[begin[0]:end[0]].split()
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:words.index(whole[-3])] + [f"x{rng.randint(0, 10**9)}" for _ in range(60)]))]
    rows = paragraph_dedup.duplicate_paragraphs(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    parts = {i: paragraph_dedup.cut_paragraphs([t.encode()]) for i, t in docs}
    heads = {i: {p[3][j]: set(p[4][p[5][j]:p[5][j + 1]].tolist()) for j in range(len(p[3]))} for i, p in parts.items()}
    linked = {i for i in range(300) if any(100 * len(s & heads[2 * i + 1].get(h, set())) >= 80 * len(s | heads[2 * i + 1].get(h, set())) for h, s in heads[2 * i].items())}
    assert len(linked) > 200 and {r.doc_id // 2 for r in rows} >= linked
