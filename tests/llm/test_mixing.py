import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from tidemill.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 250 / 3 * 2, 250 / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, 5, 50, 5000, rng.randint(0, 10**6)]) for _ in range(rng.randint(1, 9))]
        t = mixing.targets(sizes)
        assert math.isclose(sum(t), 1.5 * sum(sizes)) and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
        free = [(x / (5, 2, 1)[i % 3]) for i, (x, s) in enumerate(zip(t, sizes, strict=True)) if x < 2 * s]
        assert not free or math.isclose(min(free), max(free))


def check(out, most=2):
    by = {}
    for r in out:
        assert r.copies in range(most + 1)
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        taken, target = sum(r.copies * r["size"] for r in rows), rows[0].target
        assert abs(taken - target) <= max(1, min(0.02 * target + 3, max(r["size"] for r in rows)))
        assert rows[0].source_size == sum(r["size"] for r in rows)
        assert all(r.copies == 1 for r in rows if r["size"] == 0)


def test_mix(spark, corpus, cluttered, nothing):
    out = mixing.mix(corpus).collect()
    assert len(out) == corpus.count()
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.copies * r["size"] for r in rows) - rows[0].target) <= max(r["size"] for r in rows)
    assert sorted(map(repr, mixing.mix(corpus.repartition(5)).collect())) == sorted(map(repr, out))
    assert sorted(map(repr, mixing.mix(cluttered).collect())) == sorted(map(repr, out))
    assert mixing.mix(nothing).count() == 0


def test_many(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([1, 5, 40, 300, 0]), rng.choice(["a", "a", "b", "é", "￮", "\U0001f600", None])) for i in range(3000)]
    check(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_rates_solve_the_dual(spark):
    """Tilts reach their targets, and odds of rates are exponential in size."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 90), "abc"[i % 3]) for i in range(900)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where(F.col("target") < 2 * F.col("source_size")).collect()
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        assert math.isclose(sum(r.rate * r["size"] for r in mine), mine[0].target, rel_tol=1e-8)
        slopes = [math.log(r.rate / (2 - r.rate)) / r["size"] for r in mine]
        assert max(slopes) - min(slopes) < 1e-9 * max(1, max(map(abs, slopes))) + 1e-12


def test_weights_are_exact():
    assert mixing.targets([10**15 + 1, 1], share=Fraction(1, 2))[1] == 2.0
