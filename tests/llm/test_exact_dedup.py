import hashlib
import re

import duckdb
import pytest

from tidemill.llm import exact_dedup


def brute(rows):
    normal = [(d, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()) for d, t in rows]
    groups = {}
    for d, h in normal:
        groups.setdefault(h, []).append(d)
    keep = {h: min((d for d in g if d is not None), default=None) for h, g in groups.items()}
    return sorted((repr((d, keep[h], len(groups[h]), d == keep[h], h)) for d, h in normal))


@pytest.mark.parametrize("counters", [1, 3, 2048])
def test_against_brute_force(corpus, cluttered, counters):
    want = brute([(r.doc_id, r.text) for r in corpus.collect()])
    for df in (corpus, cluttered):
        out = exact_dedup.dedup(df.repartition(3), counters=counters)
        assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in out.collect()) == want


def test_empty(nothing):
    assert exact_dedup.dedup(nothing).count() == 0


def test_summary_keeps_the_frequent(spark):
    rows = spark.createDataFrame([(bytes([i % 50 if i % 3 else 200]),) for i in range(3000)], "digest binary").repartition(4)
    kept = {r.digest: r.n for r in exact_dedup.summary(rows, 4).groupBy("digest").agg({"at_least": "sum"}).withColumnRenamed("sum(at_least)", "n").collect()}
    assert 1000 - 3000 // 5 <= kept[bytes([200])] <= 1000
    assert len(exact_dedup.heavy(rows.selectExpr("digest", "1L as doc_id"), 4).collect()) == 1


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(map(tuple, exact_dedup.query(spark, d).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == sorted(con.execute(exact_dedup.SQL).fetchall())
