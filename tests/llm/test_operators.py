"""Operators against brute force, exact round trips and held-out accuracy on small tables."""

import base64
import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from askloom.llm import ann, decontamination, html_text, language_id, ngram_join, paragraph_dedup, pieces, setindex, warc
from askloom.llm.components import components

WORDS = {"en": "the house stands near this river with many trees and birds".split(), "de": "das haus steht nahe dem fluss mit vielen bäumen und vögeln".split(),
         "fr": "la maison est près du fleuve avec beaucoup d'arbres et oiseaux".split()}


def _shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def _classes(sets, linked):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and linked(sets[x], sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _near_copies(rng, families, members, length, edits):
    out = []
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(length)] = f"x{rng.randrange(10_000)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("length, edits", [(7, 1), (30, 3), (200, 12)])
def test_ngram_components(spark, length, edits):
    rng = random.Random(length)
    texts = _near_copies(rng, 6, 14, length, edits) + [None, "", " \t\n", "one", "One", "a b c d", "a b c d e", "é É É é é", "x" * 40_000]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 1), (1, "another text under the same id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_id long").repartition(5)
    got = ngram_join.ngram_components(docs).collect()
    assert len(got) == len(rows)
    sets = {i: _shingles(t) for i, t in enumerate(texts)}
    want = _classes(sets, lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b))
    for r in got:
        if r.doc_id != 1:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_ngram_blocks_lose_no_link():
    rng = np.random.default_rng(4)
    for n in list(range(5, 40)) + [77, 150, 400]:
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(20):
            drop = rng.integers(0, n // 5 + 1)
            other = np.concatenate((base[drop:], rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1), dtype=np.uint64)))
            a, b = np.sort(base), np.sort(other)
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or both == len(a) == len(b):
                continue
            keys, owner = ngram_join.block_postings(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            common = len(np.intersect1d(keys[owner == 0], keys[owner == 1]))
            assert common
            bits = setindex.parity_bitmaps(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            assert (int.from_bytes(bits[0]) ^ int.from_bytes(bits[1])).bit_count() <= len(a) + len(b) - 2 * both


def test_tiles_meet_every_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    lanes = (rng.integers(1, 4, (60, 6)) * 256).astype(np.uint32)
    place = np.tile(np.arange(6), 60)
    keys = setindex.list_keys(np.zeros(360, np.int64), place, lanes.ravel()).view(np.int64) & ((1 << 40) - 1)
    wide = setindex.wide_lanes(lanes)
    tokens = [np.setdiff1d(np.arange(30, dtype=np.uint64), rng.integers(0, 30, 2).astype(np.uint64)) for _ in range(60)]
    size = [len(t) for t in tokens]
    bits = setindex.parity_bitmaps(np.concatenate(tokens), np.cumsum([0, *size]))
    lists = spark.createDataFrame([(int(k), i // 6, i // 6, 60) for i, k in enumerate(keys.tolist())], "key long, set_id long, comp long, members long")
    sides = spark.createDataFrame([(i, 0, True, size[i], wide[i], bits[i]) for i in range(60)], setindex.LANES)
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60) if (lanes[i] == lanes[j]).any()]
    want = {(i, j) for i, j in pairs if 180 * np.setxor1d(tokens[i], tokens[j]).size <= 20 * (size[i] + size[j])}
    for tile in (1024, 20):
        monkeypatch.setattr(setindex, "TILE", tile)
        got = [tuple(r) for r in setindex._candidates(lists, sides, 80).collect()]
        assert len(got) == len(set(got)) and want <= set(got) <= set(pairs)


def _passages(docs):
    """Passages of :func:`paragraph_dedup.duplicate_paragraphs` by comparing every two paragraphs."""
    parts = {}
    for row, (i, text) in enumerate(docs):
        raw = (text or "").encode()
        owner, begin, end, _, _, _ = paragraph_dedup.cut_paragraphs([raw])
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            start = len(raw[:a].decode())
            parts[i, row, start] = start + len(raw[a:b].decode()), raw[a:b].decode()
    sets = {k: (_shingles(t), t.lower().split()[:5]) for k, (_, t) in parts.items()}
    want = _classes(sets, lambda x, y: x[0] == y[0] or (x[1] == y[1] and 100 * len(x[0] & y[0]) >= 80 * len(x[0] | y[0])))
    sizes = Counter(want.values())
    runs = []
    for remove in (False, True):
        last = None
        for k in sorted((k for k, c in want.items() if sizes[c] > 1 and (k != c) == remove), key=lambda k: k[1:]):
            if last is None or last[0] != k[1] or k[2] > last[3]:
                last = [k[1], k[0], k[2], parts[k][0], want[k][0], remove]
                runs.append(last)
            else:
                last[3], last[4] = max(last[3], parts[k][0]), min(last[4], want[k][0])
    return sorted(tuple(r[1:]) for r in runs)


def test_paragraphs(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage, other = fresh(51), fresh(70)
    passage[20] = "é" + passage[20]
    docs = [(i, " ".join([*fresh(rng.randint(0, 120)), *passage, *fresh(60)])) for i in range(1, 8)]
    docs += [(i, " ".join(fresh(40)) + "\nshort line of common words\n" + "\n".join(other) + "\n" + " ".join(fresh(9))) for i in range(8, 12)]
    docs += [(i, t) for i, t in zip(range(20, 32), _near_copies(rng, 3, 4, 300, 4), strict=True)]
    docs += [(i, " ".join(fresh(80)) + " and a clean line of a few common words\n" + " ".join(fresh(50))) for i in range(40, 46)]
    docs += [(50, docs[0][1]), (60, "a " * 300), (61, "A\t" * 300), (62, " ".join(fresh(35))), (63, None), (64, ""), (65, " \n"), (66, " ".join(fresh(20_000) + other))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in [*docs, (None, docs[0][1])]], "doc_id long, text string, row int, component string").repartition(5)
    rows = paragraph_dedup.duplicate_paragraphs(df).collect()
    got = sorted((r.doc_id, r.start, r.end, r.class_doc, r.remove) for r in rows)
    assert got == _passages(docs)
    found = {r.doc_id for r in rows}
    assert {*range(1, 12), 50, 61, 66} <= found and not found & {*range(40, 46), 62, 63, 64, 65}
    assert not paragraph_dedup.duplicate_paragraphs(df.filter("doc_id < 0")).collect()


def test_repeated_rows_keep_one_paragraph(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, text)] * 4, "doc_id long, text string").repartition(3)
    rows = paragraph_dedup.duplicate_paragraphs(df).collect()
    assert sorted(r.remove for r in rows) == [False, True, True, True] and {(r.doc_id, r.class_doc) for r in rows} == {(5, 5)}


@pytest.mark.parametrize("length", [51, 60, 90])
def test_every_passage_holds_a_paragraph(length):
    rng = random.Random(length)
    for _ in range(50):
        passage = " ".join(f"p{rng.randint(0, 10**9)}" for _ in range(length)).encode()
        cuts = []
        for _ in range(2):
            around = [" ".join(f"x{rng.randint(0, 10**9)}" for _ in range(rng.randint(0, 80))).encode() for _ in range(2)]
            text = around[0] + b"\n" + passage + b" " + around[1]
            at = len(around[0]) + 1
            _, begin, end, _, _, _ = paragraph_dedup.cut_paragraphs([text])
            assert all(len(text[a:b].split()) == paragraph_dedup.PIECE_WORDS for a, b in zip(begin, end, strict=True))
            cuts.append({(int(a) - at, int(b) - at) for a, b in zip(begin, end, strict=True) if a >= at and b <= at + len(passage)})
        assert cuts[0] & cuts[1]


def test_leaks(spark):
    rng = random.Random(2)
    items = [" ".join(f"b{k}w{j}" for j in range(rng.randint(8, 60))) for k in range(20)]
    docs, want = [], set()
    for i in range(60):
        w = [f"d{rng.randrange(500)}" for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            k = rng.randrange(20)
            own = items[k].split()
            if len(own) > 30 and i % 2:
                own[len(own) // 2] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = own
            if len(own) <= 30 or not i % 2 or len(own) >= 50:
                want.add((i, k))
        docs.append((i, " \n".join(w).upper(), "x"))
    df = spark.createDataFrame([*docs, (70, None, "x"), (71, "", "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.leaks(df, bench).collect()}
    assert want <= set(got) and all(i % 3 == 0 for i, _ in got) and min(got.values()) >= 0.8
    assert decontamination.leaks(df.limit(0), bench).count() == 0 == decontamination.leaks(df, bench.limit(0)).count()


@pytest.mark.parametrize("moved", [8, 20, 30])
def test_leaks_with_a_part_moved(spark, moved):
    item = [f"b{j}" for j in range(60)]
    around = [f"d{j}" for j in range(300)]
    turned = item[-moved:] + item[:-moved]
    # the second text is the item alone, shorter by its last words
    texts = [" ".join(around[:170] + turned + around[170:]), " ".join(item[:-3])]
    docs = spark.createDataFrame([*enumerate(texts), (0, "another text under the same id")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {0, 1} and (got[0].start_word, got[0].n_words) == (170, 60) and got[1].start_word == 0
    assert got[0].similarity == pytest.approx(52 / 60) and got[1].similarity == pytest.approx(53 / 56)


def test_leaks_equal_all_windows(spark):
    rng = random.Random(9)
    item = [f"b{rng.randrange(12)}" for _ in range(60)]
    docs = []
    for i in range(40):
        own = list(item)
        if i % 4:
            a = rng.randint(5, 55)
            own = own[a:] + own[:a]
        for _ in range(i % 3):
            own[rng.choice([0, -1])] = "edited"
        docs.append([f"d{rng.randrange(9)}" for _ in range(rng.randint(0, 30))] + own[:60 - i % 5] + [f"d{rng.randrange(9)}" for _ in range(rng.randint(0, 30))])

    def shingles(w):
        return Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))

    want = {}
    for i, w in enumerate(docs):
        for start in range(max(1, len(w) - 60 + 1)):
            a, b = shingles(w[start:start + 60]), shingles(item)
            score = (a & b).total() / (a | b).total()
            own, at = [tuple(w[j:j + 5]) for j in range(start, min(len(w), start + 60) - 4)], [tuple(item[j:j + 5]) for j in range(56)]
            step = any(x == y and (j == p or start == 0 and j <= p or start + 60 >= len(w) and j >= p) for j, x in enumerate(own) for p, y in enumerate(at))
            if score >= 0.8:
                want[i] = max(want.get(i, (0, False, 1)), (score, step, -start))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = decontamination.leaks(df, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: (r.similarity, r.start_word) for r in got} == {i: (score, -back) for i, (score, _, back) in want.items()} and len(want) > 20


def test_pieces_round_trip_and_merges(spark):
    texts = [None, "", " ", "  two  spaces ", "▁mark", "a\x00b\n\n\ttab", "日本語 \U0001F600 é", "x" * 9000, "The quick brown fox, jumps!"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, piece_ids array<int>")
    rows = {r.doc_id: r for r in pieces.encode_and_check(df).collect()}
    assert len(rows) == len(texts) and all(r.exact for r in rows.values())
    back = pieces.decode(pieces.encode(df)).collect()
    assert {r.doc_id: r.decoded for r in back} == dict(enumerate(texts))
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i, t in enumerate(texts):
        if t and "▁" not in t:
            assert rows[i].piece_ids == library.encode(t), t[:20]


def test_pieces_of_a_unigram_model():
    def field(number, kind, value):
        return bytes([number << 3 | kind]) + value

    def piece(text, score, sort=1):
        body = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([sort]))
        return field(1, 2, bytes([len(body)]) + body)

    vocabulary = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -3.5, "ba": -2.2, "bab": -5.0}
    codec = pieces.Codec(b"".join([piece("<unk>", 0, 2), *[piece(p, s) for p, s in vocabulary.items()]]))
    scores = {p.replace("▁", " "): s for p, s in vocabulary.items()}

    def best(text):
        if not text:
            return 0.0
        return max((scores[text[:n]] + best(text[n:]) for n in range(1, 4) if text[:n] in scores), default=-np.inf)

    for text in ["a", "ab", "abab", "babab a bab", "b  ab"]:
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        assert sum(list(scores.values())[i - 1] for i in ids) == pytest.approx(best(" " + text))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang) for i, lang in enumerate(sorted(WORDS) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "fr"), (902, "12 34 !?", "de"), (903, "das haus", None)], "doc_id long, text string, lang string")
    field = language_id.fit_documents(docs.filter(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.identify(docs.drop("lang"), field).collect()}
    assert len(got) == len(rows) + 4 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    mixed = language_id.label_words(["the house stands near das haus steht nahe dem fluss"], field)[0]
    assert [x[1] for x in mixed][:2] == ["en", "en"] and [x[1] for x in mixed][-2:] == ["de", "de"]
    assert language_id.identify(docs.limit(0), field).count() == 0


def test_many_languages(spark):
    rows = [(10 * k + i, " ".join(f"{chr(97 + k // 10)}{chr(97 + k % 10)}{chr(107 + (i + j) % 5)}" for j in range(20)), f"x{k:02d}") for k in range(70) for i in range(2 if k > 63 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit_documents(docs)).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_language_sample_of_repeated_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS["en"]) for _ in range(30)) for _ in range(40)]
    once = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    often = spark.createDataFrame([(t, "en") for t in texts for _ in range(language_id.SAMPLE_DOCUMENTS)], "text string, lang string")
    assert language_id.sample(often, "text", "lang") == language_id.sample(once, "text", "lang") and len(language_id.sample(once, "text", "lang")) == 40


def test_forward_backward_sums_over_paths():
    rng = np.random.default_rng(0)
    emission, move, start = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    weight = {}
    for path in np.ndindex(3, 3, 3, 3):
        weight[path] = np.exp(start[path[0]] + sum(emission[t, 0, p] for t, p in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
    total = sum(weight.values())
    got, _ = language_id.marginals(emission, np.array([4]), move, start)
    for t in range(4):
        for label in range(3):
            assert got[t, 0, label] == pytest.approx(sum(w for p, w in weight.items() if p[t] == label) / total)


def test_warc(spark):
    pages = [(0, "http://a", "<p>é</p>"), (1, None, None), (2, "http://b", "<p>é</p>"), (3, "http://c", ""), (4, "u\r\nv", "x" * 300_000), (5, "d", "<p>é</p>")]
    df = spark.createDataFrame([(i, u, h, "z") for i, u, h in pages], "page_id long, url string, html string, payload string")
    archives = warc.write_archives(warc.with_record_types(df))
    normalised = warc.normalise_archives(archives)
    rows = {r.page_id: r for r in warc.read_records(normalised).collect()}
    for i, _, h in pages:
        body = (h or "").encode()
        assert rows[i].payload_bytes == len(body) and rows[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert {i: (r.record_type, r.refers_to) for i, r in rows.items()} == {
        0: ("response", None), 1: ("response", None), 2: ("revisit", 0), 3: ("revisit", 1), 4: ("response", None), 5: ("revisit", 0)}
    for row in normalised.collect():
        plain = b"".join(warc.inflate(row.data))
        assert b"".join(zlib.decompress(row.data[e.offset:e.offset + e.length], 31) for e in row.entries) == plain
    assert warc.read_records(warc.normalise_archives(warc.write_archives(warc.with_record_types(df.limit(0))))).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(1500, 16))
    points[100:160] = points[100]
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(points)]
    bad = [(5000, None, 0.0), (5050, [0.0] * 16, 0.0), (5100, [float("nan")] * 16, 0.0), (5150, [1.0, None] * 8, 0.0), (None, points[0].tolist(), 0.0), (5200, [1.0], 0.0), (5250, [], 0.0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score double")
    got = ann.search(df, df.filter("vec_id % 50 = 0")).collect()
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    hit = 0
    for q in range(0, 1500, 50):
        sims = unit @ unit[q]
        sims[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(sims, 12)))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(sims[r.vec_id] - r.score) < 1e-12 for r in mine)
        hit += len({r.vec_id for r in mine} & set(best.tolist()))
        if q == 100:
            assert [r.vec_id for r in mine] == [101, 102, 103, 104, 105]
    assert hit / 150 >= 0.9 and len(got) == 150
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert [(r.query_id, r.vec_id) for r in ann.search(df.filter("vec_id < 2"), df.filter("vec_id = 0")).collect()] == [(0, 1)]


def test_ann_lists_of_copies():
    rng = np.random.default_rng(4)
    sample = rng.normal(size=(6000, 8))
    sample[:2000] = sample[0]
    sample = ann.unit(sample[rng.permutation(6000)])
    same, count = np.unique(sample, axis=0, return_counts=True)
    hot = same[count.argmax()]
    centroids = ann.different(ann.balanced_centroids(sample, 1200))
    assert 700 < len(centroids) < 900 and (np.linalg.norm(centroids - hot, axis=1) < 1e-3).sum() == 1
    graph = ann.centroid_graph(centroids)
    asked = ann.unit(np.concatenate((hot[None, :], hot + rng.normal(size=(40, 8)) * 0.2, rng.normal(size=(40, 8))))).astype(np.float32)
    row, number = ann.lists_within(asked, centroids, graph)
    posted, _ = ann.graph_search(hot[None, :].astype(np.float32), centroids, graph, ann.BEAM_BUILD)
    assert posted[0, 0] in number[row == 0]
    got = whole = 0
    for i, x in enumerate(asked):
        far = np.linalg.norm(centroids - x, axis=1)
        want = set(np.flatnonzero(far <= ann.SEARCH_RATIO * far.min()).tolist())
        got, whole = got + len(want & set(number[row == i].tolist())), whole + len(want)
    assert got / whole > 0.98


def test_ann_with_a_third_of_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_VECTORS", 4)
    rng = np.random.default_rng(8)
    points = rng.normal(size=(4000, 8))
    points[rng.permutation(4000)[:1333]] = points[0]
    # the queries lie around the copies
    points[:40] = points[0] + rng.normal(size=(40, 8)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.filter("vec_id < 40")).collect():
        got.setdefault(r.query_id, []).append(r.score)
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    hit = 0
    for q in range(40):
        sims = unit @ unit[q]
        sims[q] = -9
        least = np.sort(sims)[-5]
        hit += sum(s >= least - 1e-9 for s in got.get(q, []))
    assert hit / 200 >= 0.95


def test_html(spark):
    rng = random.Random(6)
    words = "one two three four five six seven, eight. nine ten".split()

    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))

    rows, want = [], {}
    for i in range(60):
        paragraphs = [sentence() for _ in range(rng.randint(1, 6))]
        body = f"<h1>Title {i} &amp;  more</h1>" + "".join(f"<p><b>{p}</b><br>\n tail" for p in paragraphs)
        rows.append((i, f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>{sentence()}</a></ul></nav>"
                        f"<div class=\"ad\">{sentence()}</div><article>{body}</article><footer>&copy; {sentence()}</footer>", "old"))
        want[i] = "\n".join([f"Title {i} & more", *[f"{p} tail" for p in paragraphs]])
    rows += [(100, None, "old"), (101, "", "old"), (102, "<", "old")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()}
    assert got[100] == got[101] == "" and sum(got[i] == want[i] for i in want) >= 58
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    page = html_text.Page("<div>" + html.escape("a<b") + "<p>x<p>y</div>z")
    assert [t for _, t in page.blocks] == ["a<b", "x", "y", "z"]


def test_html_sample_of_repeated_pages(spark):
    pages = spark.range(20).selectExpr("concat('<p>page ', id, '</p>') AS html")
    often = pages.crossJoin(spark.range(3000)).select("html")
    assert len(html_text.sample(pages)) == 20 and html_text.sample(often) == html_text.sample(pages)


def test_choice_is_consistent_and_best():
    rng = np.random.default_rng(2)
    page = html_text.Page("<div><div><p>a</p><p>b</p></div><p>c</p></div><ul><li>d</li></ul>")
    n = len(page.tag)
    for _ in range(50):
        margin = rng.normal(size=n)
        kept = page.chosen(margin)
        best = max((sum(margin[i] for i in range(1, n) if m >> i & 1) for m in range(1, 1 << n, 2)
                    if all(not m >> i & 1 or m >> page.parent[i] & 1 for i in range(1, n))), default=0)
        assert all(not kept[i] or kept[page.parent[i]] for i in range(1, n))
        assert sum(margin[i] for i in range(1, n) if kept[i]) == pytest.approx(best)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 5), (7, 7), (8, 10), (10, 11), (11, 12)], "x long, y long")
    assert {tuple(r) for r in components(edges, "x", "y").collect()} == {(3, 3), (4, 3), (5, 3), (8, 8), (9, 8), (10, 8), (11, 8), (12, 8)}
    assert components(edges.limit(0), "x", "y").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    items = [" ".join(f"bench{k}x{j}" for j in range(30)) for k in range(3)]
    rows = []
    for i in range(80):
        lang = sorted(WORDS)[i % 3]
        rows.append([i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(60)), lang, "src", 0])
    rows[10][1] = rows[4][1]
    rows[20][1] += " " + items[1]
    rows[30][1] += " write to me@example.org now"
    rows += [[90, None, "en", "src", 0], [91, "", "en", "src", 0], [92, "123 456", "en", "src", 0], [None, rows[5][1], "fr", "src", 0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
    every = set(range(80)) | {None}
    assert kept["language"] == every and kept["near_duplicates"] == every - {10} and kept["benchmark"] == every - {10, 20} == kept["pieces"]
    clean = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/personal_data").collect()}
    assert clean[30].text.endswith(" write to [EMAIL] now") and clean[30].n_chars == len(clean[30].text) and clean[5].text == rows[5][1]
