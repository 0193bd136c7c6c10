import random
from collections import Counter

import numpy as np

from tidemill.llm import lm
from tidemill.llm.textual import plain


def test_gradient():
    rng = np.random.default_rng(0)
    net = lm.Network(3, 5, 4)
    around, here = rng.integers(0, 16, (lm.WIDTH, 30)), rng.integers(0, 15, 30)
    for p in net.parts:
        p[...] = rng.normal(0, 0.5, p.shape)
    flat = net.flat().astype(np.float64)
    # One step with huge sums of squares moves against the gradient: g = -(change) * sqrt(sum) / rate.
    square = [np.full_like(p, 1e6) for p in net.parts]
    net.learn(around, here, square, 1.0)
    grad = (flat - net.flat()) * 1000
    loss = lambda f: -lm.Network(3, 5, 4).load(f.astype(np.float32)).logs(around, here).mean()
    for i in rng.integers(0, len(flat), 25):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - grad[i]) < 0.03


def test_units_of_a_place_sum_to_one():
    net = lm.Network(3, 5, 4, seed=1)
    around = np.full((lm.WIDTH, 15), 7)
    assert np.isclose(np.exp(net.logs(around, np.arange(15))).sum(), 1, atol=1e-5)


def test_windows():
    around, here = lm.windows([np.array([1, 2, 3], dtype=np.uint16), np.array([4], dtype=np.uint16)], 9)
    assert here.tolist() == [1, 2, 3, 4]
    assert around.T.tolist() == [[9, 9, 2, 3], [9, 1, 3, 9], [1, 2, 9, 9], [9, 9, 9, 9]]


def test_order_is_learned(spark):
    """Texts with an order score above the same words shuffled, among many words of a unit each."""
    rng = random.Random(0)
    cycle = [f"w{i}" for i in range(300)]

    def text():
        k = rng.randrange(len(cycle))
        return " ".join(cycle[(k + i) % len(cycle)] for i in range(60))

    rows = [(i, text()) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model = lm.train(docs, rate=0.2)
    assert len(model.alone) == len(cycle)
    fresh = [text() for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), 60)) for t in fresh]
    test = spark.createDataFrame([(i, t) for i, t in enumerate(fresh + mixed)], "doc_id long, text string")
    out = {r.doc_id: r.score for r in lm.score(test, model).collect()}
    assert min(out[i] for i in range(20)) > max(out[i] for i in range(20, 40))


def test_counts_cover_all_documents(spark, corpus):
    want = Counter(w for r in corpus.collect() for w in plain(r.text).split())
    assert {bytes(r.word): r.n for r in lm.word_counts(corpus).collect()} == want


def test_scores_equal_a_loop_over_tokens(spark, corpus, monkeypatch):
    """Token by token: the unit from the network, the word in a shared unit from the counts."""
    monkeypatch.setattr(lm, "COMMON", 1e-3)  # Some words are joined, some sent.
    model = lm.train(corpus, rounds=2)
    counts = Counter(w for r in corpus.collect() for w in plain(r.text).split())
    sums = Counter()
    for w, n in counts.items():
        sums[model.unit_of(w)] += n + 1
    assert any(w not in model.common for w in counts) and model.alone
    texts = [r.text for r in corpus.where("length(text) < 3000").collect()][:60] + ["never seen words", None, ""]
    test = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in lm.score(test, model).collect()}
    for i, t in enumerate(texts):
        words = plain(t).split()
        units = [model.edge] * lm.SIDE + [model.unit_of(w) for w in words] + [model.edge] * lm.SIDE
        total = 0.0
        for k, w in enumerate(words):
            near = [units[k + d] for d in range(2 * lm.SIDE + 1) if d != lm.SIDE]
            total += float(model.network.logs(np.array(near)[:, None], np.array([units[k + lm.SIDE]]))[0])
            if w not in model.alone:
                total += np.log((counts[w] + 1) / (1 + sums[model.unit_of(w)]))
        assert out[i].n_tokens == len(words) and np.isclose(out[i].log_prob, total, rtol=1e-4, atol=1e-3)
        assert out[i].score is None if not words else np.isclose(out[i].score, out[i].log_prob / len(words))


def test_odd_tables(corpus, nothing, cluttered):
    model = lm.train(corpus, rounds=2)
    rows = lm.score(corpus, model).collect()
    assert len(rows) == corpus.count()
    for r in rows:
        assert (r.score is None) == (r.n_tokens == 0) and (r.n_tokens or r.log_prob == 0)
    assert any(r.n_tokens == 0 for r in rows) and max(r.n_tokens for r in rows) == 6000
    assert lm.score(cluttered, model).count() == len(rows)
    assert lm.score(nothing, lm.train(nothing)).count() == 0


def test_scores_do_not_depend_on_the_batch(spark, corpus):
    model = lm.train(corpus, rounds=1)
    a = {(r.doc_id, r.n_tokens): r.log_prob for r in lm.score(corpus.repartition(1), model).collect()}
    b = {(r.doc_id, r.n_tokens): r.log_prob for r in lm.score(corpus.repartition(7), model).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 * (1 + abs(a[k])) for k in a)
