import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import toxicity
from tidemill.llm.toxicity import Automaton, Finder, Model

from .conftest import words


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(4)
    entries = ["abcab", "bcabca", "aab", "ccacb", "abc"]
    a = Automaton(entries, ["bbb"])
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        best = [edits(w, e) for e in entries if edits(w, e) <= (1 if len(e) >= toxicity.FUZZY else 0)]
        want = 0 if w.startswith("bbb") else min(best, default=-1)
        assert a.match(w) == want, w


def labelled(spark, n=240):
    rng = random.Random(5)
    bad = ["grumblefuss", "snotwaffle", "dunderpate"]
    rows, labels = [], []
    for i in range(n):
        w = words(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                x = rng.choice(bad)
                if rng.random() < 0.3:
                    k = rng.randrange(len(x))
                    x = x[:k] + "q" + x[k + 1 :]
                w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).withColumn("predicted", toxicity.predicted()).join(labels, "doc_id").collect()
    held = [r for r in out if r.held]
    assert {r.doc_id for r in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    kept = toxicity.reject(docs.withColumn("score", F.lit("mine")), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(not r.predicted for r in out)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert a.words == b.words and np.allclose(a.weights, b.weights)


def test_quotation_counts_less():
    f = Finder(Model(["snotwaffle"]))
    plain, quoted = f.features("well you are a snotwaffle and more"), f.features("well they wrote “you are a snotwaffle” in the letter and more")
    assert plain[1] == 1 and quoted[1] == 0 and quoted[4] > 0
    assert plain @ toxicity.PRIOR > quoted @ toxicity.PRIOR


def test_window_of_late_finds():
    """A dense passage counts after any number of scattered finds."""
    f = Finder(Model(["snotwaffle"]))
    scattered = ("snotwaffle " + "word " * 30) * 60
    rng = random.Random(8)
    for text in (scattered + "snotwaffle " * 9, " ".join(rng.choice(["snotwaffle", "word", "word", "word"]) for _ in range(500))):
        at = [i for i, w in enumerate(text.split()) if w == "snotwaffle"]
        assert np.isclose(f.features(text)[6], np.log(max(sum(abs(i - j) <= toxicity.WINDOW for j in at) for i in at)))


def test_odd_tables(spark, corpus, nothing, cluttered):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    for docs in (corpus, cluttered):
        out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(out) == corpus.count() and all(0 <= r.score <= 1 for r in out)
    none = toxicity.train(corpus, labels.limit(0))
    assert none.words == [] and len({r.score for r in toxicity.score(corpus, none).collect()}) == 1
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0


def test_punctuation_of_all_scripts_and_masked_letters():
    finder = toxicity.Finder(toxicity.Model(words=["rotten"]))
    plainly = finder.features("you rotten thing")
    for text in ("you “rotten” thing", "you —rotten— thing", "you rotten… thing", "you ¡rotten! thing", "you «rotten» thing"):
        assert sum(finder.features(text)[2:5]) == sum(plainly[2:5]) > 0, text
    assert finder.features("you r*tten thing")[3] == finder.features("you rettem rottem thing")[3] > 0  # a misspelling
    assert toxicity.tokens("id*ot st@pid a * b don’t x") == ["idot".encode(), "stpid".encode(), b"a", b"b", b"don", b"t", b"x"]
    assert toxicity.tokens(None) == toxicity.tokens("") == []


def test_an_apostrophe_does_not_end_quotation():
    finder = toxicity.Finder(toxicity.Model(words=["rotten"]))
    straight, curly = (finder.features(f"I {x} mean it: \"you rotten here\"") for x in ("dont", "don’t"))
    assert straight[4] > 0 and curly[4] > 0 and straight[2] == curly[2] == 0
    assert finder.features("‘you rotten here’ it was")[4] > 0
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab ’'\"“”‘*é—.\n") for _ in range(60))
        words = toxicity.tokens(text)
        assert [w for w in toxicity.tokens(text, marks=True) if w != toxicity.MARK.encode()] == words, text
