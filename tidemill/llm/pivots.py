"""Embedding near-duplicates by a pivot-permutation index.

Pivots are a bounded sample of the vectors, about the square root of their number (32 to 65,536), those with the
smallest hashes of their ids, and fewer where vectors are so wide that they would be over 128 MB. Every vector is described by its ``NEAREST`` nearest pivots in order, and stands in the
inverted list of each of them under its label. Two vectors that share at least ``SHARED`` pivots are candidates and
are checked by cosine in double precision. Lists are worked through in pairs of blocks by matrix products; a pair is
counted only in the list of its first shared pivot. What leaves a pair of blocks is a row a vector: how many links it
has there and the smallest linked id, so never all pairs of a list.

Edge cases: vectors that are null, empty or zero or hold null or non-finite components, and rows without a label,
link with nothing, nor do vectors of unequal length. Equal vectors of a label are compared as one and count each.
Rows that repeat a vec_id are vectors of their own in counts, and share a component.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table
from .graph import components

COSINE, NEAREST, SHARED, BLOCK, MOST_PIVOTS = 0.93, 8, 2, 1024, 65_536
#: Numbers that all pivots together may have, which bounds what is broadcast at 128 MB.
MOST_NUMBERS = 1 << 24


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def choose(reps: DataFrame, pivots: int | None = None) -> dict[int, np.ndarray]:
    """Unit vectors of the pivots by length of the vectors."""
    n, widest = reps.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = min(MOST_PIVOTS, max(32, MOST_NUMBERS // (widest or 1)), pivots or max(32, math.isqrt(n)))
    picked = reps.orderBy(F.xxhash64(F.lit(3), "id"), "id").select("v").limit(most).collect()
    out: dict[int, list] = {}
    for r in picked:
        out.setdefault(len(r.v), []).append(r.v)
    return {k: unit(np.array(v, dtype=np.float64)) for k, v in out.items()}


def nearest(reps: DataFrame, pivots: dict[int, np.ndarray], count: int) -> DataFrame:
    """``reps`` with ``near``: the numbers of the nearest pivots, nearest first; -1 alone where there is none."""
    sent = reps.sparkSession.sparkContext.broadcast(pivots)
    bounded_batches(reps.sparkSession, 2048)

    @F.pandas_udf("array<int>")
    def run(vs: pd.Series) -> pd.Series:
        out = np.empty(len(vs), dtype=object)
        sizes = vs.map(len).to_numpy()
        for size in set(sizes.tolist()):
            at = np.flatnonzero(sizes == size)
            p = sent.value.get(size)
            for i in range(0, len(at), 256):
                part = at[i : i + 256]
                if p is None:
                    near = np.full((len(part), 1), -1)
                else:
                    near = np.argsort(-(unit(np.stack(vs.iloc[part].to_list()).astype(np.float64)) @ p.T), axis=1, kind="stable")[:, :count]
                for j, row in zip(part, near, strict=True):
                    out[j] = row.astype(np.int32)
        return pd.Series(out)

    return reps.withColumn("near", run("v"))


def _held(near: list, pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pivots of a block its vectors have, and which of those come before ``pivot``."""
    width = max(map(len, near))
    x = np.array([[*r, *[-2] * (width - len(r))] for r in near])
    return x, (x >= 0) & (x < pivot)


def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool, pivot: int, least: float, shared: int) -> pd.DataFrame:
    """id, links (with copies) and root of the vectors of two blocks that are linked across them."""
    near = [*left.near, *right.near]
    x, _ = _held(near, pivot)
    names, at = np.unique(x, return_inverse=True)
    held = np.zeros((len(near), len(names)), dtype=np.float32)
    held[np.arange(len(near))[:, None], at.reshape(x.shape)] = 1
    held[:, names == -2] = 0
    k = len(left)
    both = held[:k] @ held[k:].T
    first = held[:, names < pivot]
    vectors = unit(np.stack([*left.v, *right.v]).astype(np.float64))
    linked = (vectors[:k] @ vectors[k:].T >= least) & (first[:k] @ first[k:].T == 0) & (both >= min(shared, max(1, (names >= 0).sum()))) if pivot >= 0 else vectors[:k] @ vectors[k:].T >= least
    if same:
        np.fill_diagonal(linked, False)
    ids, weights = np.concatenate([left.id, right.id]).astype(np.int64), np.concatenate([left.n, right.n]).astype(np.int64)
    links = np.concatenate([linked @ weights[k:], linked.T @ weights[:k] * (not same)]).astype(np.int64)
    a, b = np.nonzero(linked)
    root = ids.copy()
    while len(a):  # each takes the smallest root next to it until none changes
        old = root.copy()
        np.minimum.at(root, a, old[b + k])
        np.minimum.at(root, b + k, old[a])
        if same:
            root[:k] = root[k:] = np.minimum(root[:k], root[k:])
        if (root == old).all():
            break
    keep = links > 0
    return pd.DataFrame({"id": ids[keep], "links": links[keep], "root": root[keep]})


def near_vectors(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", least: float = COSINE, pivots: int | None = None, near: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) | ~F.exists("v", lambda x: x != 0)
    # 0.0 and -0.0 are equal numbers, but not equal keys.
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("id").isNotNull()
    rows = rows.withColumn("v", F.when(fit, F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x))))
    reps = materialize(rows.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    placed = materialize(nearest(reps, choose(reps, pivots), near).withColumn("dim", F.size("v")))
    lists = placed.select("id", "label", "v", "n", "near", "dim", F.explode("near").alias("pivot"))
    sizes = lists.groupBy("label", "dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 0")
    lists = lists.join(sizes, ["label", "dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("id", "pivot"), F.col("blocks")).cast("int"))
    # Of b blocks, each meets itself and every other once: a copy of the block for each block.
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = lists.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        pivot, low, high = key[2], key[3], key[4]
        left = cell[cell.block == low]
        right = left if low == high else cell[cell.block == high]
        if len(left) and len(right):
            return compare(left, right, low == high, pivot, least, shared)
        return pd.DataFrame({"id": [], "links": [], "root": []})

    found = lists.select("label", "dim", "pivot", "low", "high", "id", "v", "n", "near", "block").groupBy("label", "dim", "pivot", "low", "high").applyInPandas(run, "id long, links long, root long")
    found = materialize(found.groupBy("id", "root").agg(F.sum("links").alias("links")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    reps = reps.join(counted, "id", "left").join(parts, "id", "left")
    known = reps.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.where("v is not null").join(known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs, for tables on which the index misses none.
SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.93 ELSE false END
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id IS NOT DISTINCT FROM least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN counts ON vec_id = counts.a LEFT JOIN least ON vec_id = least.a
"""
