"""Every query against the same in DuckDB."""

import duckdb
import pytest

from tidemill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    ours = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    theirs = [tuple(plain(row[i]) for i in order) for row in cursor.fetchall()]
    key = lambda rows: sorted(map(repr, rows))
    assert sorted(df.columns) == sorted(names)
    assert key(ours) == key(theirs)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_predicates_and_columns_reach_the_scan(spark):
    plan = QUERIES["window_reduce_tumbling"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "props" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan


def test_window_then_reduce_has_one_exchange(spark):
    plan = QUERIES["window_then_reduce_incremental"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
