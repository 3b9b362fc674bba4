"""Leaders' pairs meet with sizes and bitmaps before any text moves; a text of several pairs is cut once; tasks give memory back."""

import random

import numpy as np
import pyarrow as pa
import pytest

from askloom.llm import common, ngram_join, setindex


def texts_of(count, seed=3, length=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choices(words, k=length)) for _ in range(count)]


def test_leaders_are_compared_only_if_bitmaps_allow_a_link(spark):
    texts = texts_of(41)
    texts.append(texts[0] + " more")
    tokens, offsets = common.shingle_sets([t.encode() for t in texts])
    ids = common.set_ids(tokens, offsets).tolist()
    columns = [c.to_pylist() for c in setindex.sketches(tokens, offsets, np.arange(len(ids)))]
    items = spark.createDataFrame(list(zip(ids, texts, *columns, strict=True)), "set_id long, content string, size long, parity binary, long binary")
    lists = spark.createDataFrame([(256, i) for i in ids] + [(key << 8, i) for key in (2, 3, 4) for i in (ids[0], ids[-1])], setindex.LISTS)
    compared = spark.sparkContext.accumulator(0)

    def compare(batches):
        for batch in batches:
            compared.add(batch.num_rows)
            yield from ngram_join._compare([batch])

    linked = setindex.resolve(lists, lambda _: items, ngram_join._lanes, compare, ngram_join.PERCENT, "six")
    assert {r.set_id for r in linked.collect()} == {ids[0], ids[-1]}
    assert 1 <= compared.value <= 4


@pytest.mark.parametrize(("count", "length"), [(60, 60), (12, 600), (12, 4000)])
def test_sketches_keep_every_linked_pair(count, length):
    rng = random.Random(5)
    texts = []
    for t in texts_of(count, 7, length):
        words = t.split()
        for _ in range(rng.randrange(length // 15)):
            words[rng.randrange(len(words))] = "other"
        texts += [t, " ".join(words), " ".join(words[:rng.randrange(length * 3 // 4, length)])]
    data = [t.encode() for t in texts]
    tokens, offsets = common.shingle_sets(data)
    sketches = setindex.sketches(tokens, offsets, np.arange(len(data)))
    pairs = [(i, j) for i in range(len(data)) for j in range(i)]
    shared, union = common.jaccard_counts([data[i] for i, _ in pairs], [data[j] for _, j in pairs])
    linked = {p for p, n, u in zip(pairs, shared, union, strict=True) if 100 * n >= ngram_join.PERCENT * u}

    def side(k):
        return pa.StructArray.from_arrays([c.take(pa.array([p[k] for p in pairs])) for c in sketches], ["size", "parity", "long"])

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs]), pa.array([j for _, j in pairs]), side(0), side(1)], ["a", "b", "content_a", "content_b"])
    kept = {(a, b) for out in setindex._sketch_task(ngram_join.PERCENT)([batch]) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    assert linked and linked <= kept and len(kept) < len(pairs) / 10


def test_a_text_of_several_pairs_is_cut_once(monkeypatch):
    texts = [t.encode() for t in texts_of(3)]
    cut, once = [], common.shingle_sets
    monkeypatch.setattr(common, "shingle_sets", lambda t, *a: cut.append(len(t)) or once(t, *a))
    shared, union = common.jaccard_counts([texts[0], texts[1], texts[0], b""], [texts[0], texts[0], texts[2], texts[1]])
    assert sum(cut) == 4
    sets = [{tuple(w[i:i + 5]) for i in range(56)} for w in (t.split() for t in texts)] + [set()]
    want = [(sets[a] & sets[b], sets[a] | sets[b]) for a, b in ((0, 0), (1, 0), (0, 2), (3, 1))]
    assert shared.tolist() == [len(a) for a, _ in want] and union.tolist() == [len(b) for _, b in want]


def test_tasks_give_memory_back_at_their_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    assert list(common.lean(iter)([1, 2, 3])) == [1, 2, 3] and calls == [1]
    monkeypatch.undo()
    common.release_memory()
