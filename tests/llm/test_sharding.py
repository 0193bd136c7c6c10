import zlib
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import sharding


@pytest.mark.parametrize("block_rows", [3, 50_000])
def test_sizes_and_slots(corpus, cluttered, block_rows):
    n = corpus.count()
    for df in (corpus, cluttered):
        rows = sharding.shard(df, 5, block_rows=block_rows).collect()
        counts = Counter(r.shard for r in rows)
        assert sum(counts.values()) == n and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(5))
        for s, c in counts.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(c))
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in corpus.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts


def test_reruns_agree_and_seeds_differ(corpus):
    def run(**k):
        return sorted(repr(tuple(r)) for r in sharding.shard(corpus.repartition(k.pop("n")), 4, **k).collect())

    assert run(n=1) == run(n=5) != run(n=1, seed=1)


def test_empty_and_few(spark, nothing):
    assert sharding.shard(nothing).count() == 0
    assert sharding.shard(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 16).first().slot == 0


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    draws = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    assert abs(draws.mean() - 6) < 0.05 and abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    big = sharding.hypergeometric(rng, 10**11, 15 * 10**11, 10**6)
    assert abs(big - 62_500) < 3000


def test_matrix_sums():
    m = np.array(sharding.matrix([10, 0, 25, 5], [14, 13, 13], 3))
    assert m.sum(axis=1).tolist() == [10, 0, 25, 5] and m.sum(axis=0).tolist() == [14, 13, 13]


def test_placement_is_uniform(spark):
    docs = spark.range(64).selectExpr("id as doc_id", "cast(id as string) as text")
    first = Counter()
    for seed in range(30):
        first.update(r.shard for r in sharding.shard(docs, 4, seed=seed).where("doc_id < 4").collect())
    assert min(first.values()) > 12 and max(first.values()) < 50


def test_write(corpus, tmp_path, spark):
    sharding.write(corpus, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == corpus.count() and "source" in back.columns


def test_write_keeps_columns_of_its_own_names(cluttered, tmp_path, spark):
    sharding.write(cluttered, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {"size_in", "shard_in", "slot_in", "label"} <= set(back.columns)
    assert back.where("size_in = 'x' and shard_in = 'x' and slot_in = 'x'").count() == cluttered.count()
    with pytest.raises(ValueError, match="size_in"):
        sharding.write(cluttered.withColumnRenamed("rate", "size_in"), str(tmp_path / "t"))
