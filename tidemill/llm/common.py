"""What the operators of this subpackage share: scratch tables, Arrow batches, digests."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java and a Python character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one set here where it is unset and all run in one
    process (tests); elsewhere an unset folder is an error, since executors don't see each other's disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(root)
    return root


_written: list[str] = []


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder (a folder for each value of ``by``) and return a reader of it.

    A lost executor re-reads the files; nothing upstream runs again. ``discard`` removes the files.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _written.append(path)
    if (own := getattr(_own, "paths", None)) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(p)


def discard(spark: SparkSession) -> None:
    """Remove the tables that ``materialize`` has written so far. Results that weren't written elsewhere are lost."""
    _remove(spark, list(_written))


#: In each thread, the tables written within the innermost ``tidied``.
_own = threading.local()


def tidied(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """What ``make`` returns, as a table; the tables that were written on the way to it are removed."""

    @wraps(make)
    def run(*args: object, **how: object) -> DataFrame:
        outer, _own.paths = getattr(_own, "paths", None), []
        try:
            out = materialize(make(*args, **how))
            *before, last = _own.paths
        finally:
            _own.paths = outer
        if outer is not None:
            outer.append(last)
        _remove(out.sparkSession, before)
        return out

    return run


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small, so that very long texts never meet 10,000 to a batch in one worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """``mapInArrow`` by columns: ``make()`` runs once a task and returns a function from column lists to column lists."""
    bounded_batches(df.sparkSession)
    fields = [c.split() for c in schema.split(", ")]
    kinds = pa.schema([(n, ARROW[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
    "array<binary>": pa.list_(pa.binary()),
}


def words_of(text: str) -> Column:
    """Number of contract words of a column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of two numbers that a broadcast may hold: some 30 MB as a hash table.
BROADCAST_IDS = 1_000_000


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver holds, broadcast in joins unless there are too many."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_IDS else df


def joined(df: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with ``side`` (a few numbers a row): by a broadcast if it is counted and small, else by a shuffle."""
    return df.join(counted(side), on, how)


def counted(side: DataFrame) -> DataFrame:
    """``side`` as a table, to be broadcast if it is small, else to be shuffled."""
    side = materialize(side)
    return F.broadcast(side) if side.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else side.hint("merge")


def semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``ids``."""
    return joined(df, ids, on, "left_semi")


def sifted(df: DataFrame, ids: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that may have their ``on`` in ``ids``, and rows that surely haven't: neither are moved.

    A bit map of hashes is broadcast: ``BROADCAST_IDS`` rows of two numbers at most, however many ids there are."""
    at = F.pmod(F.xxhash64(*on), F.lit(64 * BROADCAST_IDS))
    ids = ids.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c in on))  # hashes depend on types
    place, bit = F.floor(at / 64).cast("int"), F.expr("shiftleft(1L, cast(__at % 64 as int))")
    bits = materialize(ids.select(at.alias("__at")).groupBy(F.floor(F.col("__at") / 64).cast("int").alias("__place")).agg(F.bit_or(bit).alias("__bits")))
    both = df.withColumns({"__at": at, "__place": place}).join(F.broadcast(bits), "__place", "left")
    there = F.coalesce(F.col("__bits"), F.lit(0)).bitwiseAND(bit) != 0
    return both.where(there).select(*df.columns), both.where(~there).select(*df.columns)


#: A key is frequent if it has more than one of so many rows.
FREQUENT = 1000


def split_join(rows: DataFrame, side: DataFrame, on: str, n: str) -> DataFrame:
    """Inner join in which no task gets all rows of a frequent key. ``side`` has one row a key and in ``n`` how many of
    ``rows`` have it: the frequent keys, ``FREQUENT`` at most, are broadcast, and only the others shuffled."""
    side = materialize(side)
    total = rows.count()
    frequent = side.where(F.col(n) * FREQUENT > total)
    early = rows.join(F.broadcast(frequent), on)
    rest = rows.join(F.broadcast(frequent.select(on)), on, "left_anti").join(side.where(F.col(n) * FREQUENT <= total), on)
    return early.unionByName(rest).drop(n)
