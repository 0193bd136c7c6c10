import random

import numpy as np
import pytest

from tidemill.llm import graph, minhash
from tidemill.llm.minhash import Numbers, Shingles, Sketcher, distance, labelled, plain, shingles, similar

from .conftest import words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_distance_against_full_alignment():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64) for _ in range(2))
        most, d = int(rng.integers(0, 40)), len(a) + len(b) - 2 * lcs(a, b)
        assert distance(a, b, most) == (d if d <= most else None)


def test_labels_tell_occurrences_apart():
    x = np.array([5, 7, 5, 5, 7], dtype=np.uint64)
    y = labelled(x)
    assert len(set(y.tolist())) == 5 and y[0] == 5 and y[1] == 7
    assert sorted(labelled(x[::-1]).tolist()) == sorted(y.tolist())


def brute(rows):
    numbers = Numbers()
    first = {}
    for d, t in rows:
        w = plain(t).split()
        if d is not None and w:
            k = b" ".join(w)
            first[k] = min(first.get(k, d), d)
    docs = {d: shingles(numbers.of(k.split()), 5) for k, d in first.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and similar(docs[a], docs[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = []
    for d, t in rows:
        k = b" ".join(plain(t).split())
        c = find(first[k]) if d is not None and k else d
        out.append((d, c, d == c))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block", [512, 4])
def test_against_all_pairs(spark, corpus, cluttered, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    for df in (corpus, cluttered):
        assert sorted(repr((r.doc_id, r.class_id, r.kept)) for r in minhash.near_dedup(df).collect()) == brute([(r.doc_id, r.text) for r in corpus.collect()])


def test_a_large_group_of_near_copies(spark):
    """Copies that differ from each other more than the threshold, linked by chains only."""
    rng = random.Random(2)
    base = words(rng, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr((r.doc_id, r.class_id, r.kept)) for r in minhash.near_dedup(df).collect()) == brute(rows)


def test_order_matters():
    rng = random.Random(3)
    a = words(rng, 200).split()
    s, t = (shingles(Numbers().of([w.encode() for w in x]), 5) for x in (a, a[100:] + a[:100]))
    assert similar(s, s) and not similar(s, t)


def test_near_leaves_out_only_the_different():
    rng = random.Random(5)
    m = Shingles()
    base = words(rng, 60).split()
    texts = [" ".join(w if rng.random() > p else "x" for w in base) for p in (0, 0.01, 0.03, 0.1, 0.5) for _ in range(6)]
    items = [m.item(t) for t in texts]
    index = m.index(items)
    for a in items:
        near = set(m.near(a, index).tolist())
        assert all(j in near for j, b in enumerate(items) if similar(a[0], b[0]))


def test_bands_find_what_is_similar():
    rng = random.Random(6)
    numbers, sketcher, found = Numbers(), Sketcher(), 0
    for _ in range(60):
        w = words(rng, 225).split()
        v = list(w)
        for k in (40, 90, 140, 190):
            v[k] = "other"
        a, b = (labelled(shingles(numbers.of([x.encode() for x in t]), 5)) for t in (w, v))
        found += bool((sketcher.bands_of(a) == sketcher.bands_of(b)).any())
    assert found == 60


def test_empty(nothing):
    assert minhash.near_dedup(nothing).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 100), (7, 7), (None, 3)]
    out = dict(graph.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
