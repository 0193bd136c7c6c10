import math

import duckdb
import numpy as np
import pytest

from tidemill.llm import pivots


def brute(rows, least=0.93):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and len(r[2]) and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2])]
    links = {id(r): 0 for r in rows}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], dtype=np.float64), np.array(b[2], dtype=np.float64)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                    links[id(a)] += 1
                    links[id(b)] += 1
                    u, v = find(a[0]), find(b[0])
                    root[max(u, v)] = min(u, v)
    return sorted((r[0], links[id(r)], find(r[0]), r[0] == find(r[0])) for r in rows)


def table(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 16))
    rows = []
    for i in range(n):
        v = centres[rng.integers(30)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.6])
        rows.append((i, int(rng.integers(3)), [float(np.float32(x)) for x in v]))
    rows += [(n + i, 1, rows[0][2]) for i in range(25)]  # copies
    rows += [(600, None, rows[1][2]), (601, 1, None), (602, 1, [0.0] * 16), (603, 1, [float("nan")] * 16), (604, 1, [None, *rows[0][2][1:]]), (605, 1, [float("inf")] * 16), (606, 1, []), (607, 1, [1.0, 2.0]), (608, 1, [1.0, 2.0]), (609, 1, [2.0, 4.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows, df = table(spark)
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(df).collect())
    want = brute(rows)
    found, there = sum(r[1] for r in out), sum(r[1] for r in want)
    assert found <= there and found >= 0.97 * there
    assert all(a[1] <= b[1] for a, b in zip(out, want, strict=True))


def test_all_pivots_shared_is_exact(spark):
    rows, df = table(spark, 1)
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(df, near=32, shared=1).collect())
    assert out == brute(rows)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert pivots.near_vectors(df).count() == 0
    twice = spark.createDataFrame([(1, 0, [1.0, 0.0], "x"), (1, 0, [1.0, 0.0], "y"), (2, 0, [1e30, 1e20], "z")], "vec_id long, label int, embedding array<float>, n string")
    assert sorted(map(tuple, pivots.near_vectors(twice).collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_sql(spark):
    """The oracle against brute force, and the query against the oracle where the index is exact."""
    rows, df = table(spark, 2)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    got = sorted((r[0], r[1], r[2], r[3]) for r in con.sql(pivots.SQL).select("vec_id, n_links, component_id, kept").fetchall())
    assert got == brute(rows)
    assert sorted(map(tuple, pivots.near_vectors(df, near=32, shared=1).collect())) == got


def test_wide_vectors_bound_the_pivots(spark, monkeypatch):
    monkeypatch.setattr(pivots, "MOST_NUMBERS", 64)
    _, df = table(spark)
    reps = df.where("vec_id < 400").selectExpr("vec_id AS id", "embedding AS v")
    assert sum(map(len, pivots.choose(reps, 300).values())) == 32
