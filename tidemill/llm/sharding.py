"""A uniform shuffle into shards of exact size.

All rows lie in blocks. How many rows of which block go to which shard is drawn before any row moves: the matrix of
these counts follows the multivariate hypergeometric law that a uniform shuffle of all rows would give it. Each
block is then permuted locally and cut by its row of the matrix, the pieces are exchanged, and each shard is
permuted again. The law of sizes is ``rows``: counts of shards are at most one apart. A uniform shuffle takes no heed
of texts, so rows of equal texts are dealt like any others and come to lie in several shards.

Random orders are orders of seeded hashes of the row, so a task that runs again gives the same rows.
Edge cases: a null text has size 1 and CRC 0, as an empty one; rows that are alike in doc_id, size and CRC may
change places, which doesn't show; shards may be empty when there are fewer rows than shards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows of a block, and of a bin of a shard, that one task orders; and the most blocks, which bounds the matrix.
BLOCK_ROWS, MOST_BLOCKS = 50_000, 65_536


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw, by inversion around the mode: numpy's own stops at 10**9 rows."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1))
    low, high = max(low, mode - int(14 * spread) - 20), min(high, mode + int(14 * spread) + 20)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    mass = np.concatenate([[0], np.cumsum(step)])
    mass = np.cumsum(np.exp(mass - mass.max()))
    return low + min(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")), high - low)


def matrix(counts: Sequence[int], sizes: Sequence[int], seed: int) -> list[list[int]]:
    """For each block, how many of its rows go to each shard."""
    rng, left, out = np.random.default_rng(seed), list(sizes), []
    for n in counts:
        row, rest = [], sum(left)
        for j, free in enumerate(left):
            rest -= free
            row.append(hypergeometric(rng, free, rest, n))
            n -= row[-1]
            left[j] -= row[-1]
        out.append(row)
    return out


def _order(seed: int, salt: int) -> Column:
    """A random non-negative number of 63 bits for each row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "doc_id", "size", "text_crc32"), 1)


def _part(order: Column, parts: int) -> Column:
    """Which of so many equal parts of the range an order lies in."""
    return F.least(F.floor(order / F.lit(2.0**63) * parts), F.lit(parts - 1)).cast("int")


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240101, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard), and the columns to carry along."""
    spark, raw = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    rows = materialize(rows)
    total = rows.count()
    blocks = min(MOST_BLOCKS, max(16, math.ceil(total / block_rows)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(0), "doc_id"), F.lit(blocks)).cast("int"))
    counts = dict(rows.groupBy("block").count().collect())
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    drawn = matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    cuts = spark.createDataFrame([(b, [int(c) for c in np.cumsum(row)]) for b, row in enumerate(drawn)], "block int, cuts array<long>")

    alike = ("doc_id", "size", "text_crc32")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(_order(seed, 1), *alike)))
    # The matrix has MOST_BLOCKS rows of one number a shard at most.
    rows = rows.join(F.broadcast(cuts), "block").withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("place"))))
    rows = materialize(rows.drop("block", "cuts", "place"))

    bins = max(1, math.ceil(total / shards / block_rows))
    rows = rows.withColumn("order", _order(seed, 2)).withColumn("bin", _part(F.col("order"), bins))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bin").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rows = rows.withColumn("in_bin", F.row_number().over(Window.partitionBy("shard", "bin").orderBy("order", *alike)))
    rows = rows.join(starts, ["shard", "bin"])
    return rows.select(*alike, "shard", (F.col("start") + F.col("in_bin") - 1).cast("long").alias("slot"), *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)))


def write(docs: DataFrame, path: str, shards: int = 16, seed: int = 20240101) -> None:
    """Write all columns as one Parquet folder a shard, each in the order of its slots; a column of the input named as
    one of this operator's is written as ``<name>_in``."""
    own = ("size", "text_crc32", "shard", "slot")
    taken = {c.lower() for c in docs.columns}
    if clash := [f"{c}_in" for c in own if c in taken and f"{c}_in" in taken]:
        raise ValueError(f"no free name for columns of the input: {', '.join(clash)} exist already")
    docs = docs.withColumnsRenamed({c: f"{c}_in" for c in docs.columns if c.lower() in own})
    placed = shard(docs, shards, seed, carry=[c for c in docs.columns if c.lower() != "doc_id"])
    bins = F.floor(F.col("slot") / BLOCK_ROWS)
    placed.repartition("shard", bins).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
