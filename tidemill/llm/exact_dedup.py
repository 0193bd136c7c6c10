"""Exact deduplication by a heavy-hitter split.

A Misra-Gries summary of every task names the digests that may be frequent. Their exact counts and keepers are
verified; the verified winners, of which there are never more than ``counters + 1``, go to all tasks, where their
rows are answered without a shuffle. All other digests are aggregated and joined in the ordinary way, by a shuffle
in which no digest has more than a ``2 / counters`` part of the rows.

Edge cases: a null text counts as empty, and empty texts are copies of each other. A null doc_id never is the
smallest unless a group has no other. Rows that repeat a doc_id are counted each, and each is kept if that doc_id
is the one that stays. Extra columns of the input are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize, table

#: Counters of a summary: with 2,048 of them, winners have about a thousandth of all rows or more.
COUNTERS = 2048


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+", " ")
    return docs.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


def summary(rows: DataFrame, counters: int) -> DataFrame:
    """(digest, at_least, seen) of every task's summary; a count is short by seen / (counters + 1) at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update(batch.column(0).to_pylist())
            if len(held) > counters:
                # Equal parts of all counters cancel each other until no more than ``counters`` are left.
                less = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: n - less for k, n in held.items() if n > less})
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "at_least"])

    return rows.select("digest").mapInArrow(run, "digest binary, at_least long").where("digest is not null")


def heavy(rows: DataFrame, counters: int) -> DataFrame:
    """(digest, keep_id, group_size) of the frequent digests, at most ``counters + 1``, counted exactly."""
    spark, total = rows.sparkSession, rows.count()
    floor = max(2, total // (counters + 1))
    # What all summaries are short of together is total / (counters + 1): a digest with twice that has at least that left.
    names = summary(rows, counters).groupBy("digest").agg(F.sum("at_least").alias("n")).where(F.col("n") >= floor).select("digest")
    likely = spark.createDataFrame(names.limit(counters + 1).collect(), "digest binary")
    exact = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return spark.createDataFrame(exact.where(F.col("group_size") >= floor).collect(), "digest binary, keep_id long, group_size long")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(digests(docs, key, text))
    winners = F.broadcast(heavy(rows, counters))
    early = rows.join(winners, "digest")
    rest = rows.join(winners.select("digest"), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = early.unionByName(rest.join(groups, "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
