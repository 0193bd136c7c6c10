"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``most`` copies. Of all rates that give each source its target number of
words, those nearest to the middle rate in (two-sided) relative entropy are exponentially tilted:
``rate / (most - rate) = exp(tilt * size / mean size)`` with one tilt a source. The tilts solve the convex dual
problem; Newton's steps on it need two sums a source, which Spark takes over the table of sizes (rates depend on
source and size only). A seeded hash rounds rates into whole copies, and passes over the documents in a hashed order
then add or remove single copies until no document fits into what a source is still off its target.

Edge cases: a null text has no words; documents without words keep the middle rate, one copy, and take no words; a
null source is a source, the last; sources without words have target 0. Rows that repeat are mixed each.
The number of sources is taken to be small beside the number of documents; only sums by source reach the driver.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import listed, materialize, table, words_of

WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
#: Bins of the hashed order of a source, in one of which the last copy of a pass lies.
BINS, PASSES = 4096, 4


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> list[float]:
    """Words for each source, in the order given: by weight, none above ``most`` times its size, the excess reshared."""
    open_, left, out = list(range(len(sizes))), share * sum(sizes), [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        for i in open_:
            out[i] = left * weights[i % len(weights)] / total
        full = {i for i in open_ if out[i] > most * sizes[i]}
        if not full:
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return [float(x) for x in out]


def tilts(sizes: DataFrame, sources: dict[int, tuple[float, float, float]], most: int = MOST) -> dict[int, float]:
    """The tilt of each source: ``sizes`` has (sid, size, n); ``sources`` has sid -> (words, mean size, target)."""
    spark = sizes.sparkSession
    out = {s: math.inf if t >= most * w else -math.inf for s, (w, _, t) in sources.items() if w == 0 or t <= 0 or t >= most * w}
    bounds = {s: [-math.inf, math.inf] for s in sources if s not in out}
    now = dict.fromkeys(bounds, 0.0)
    for _ in range(100):
        if not now:
            break
        guess = listed(spark, [(s, t, sources[s][1]) for s, t in now.items()], "sid int, tilt double, mean double")
        x = F.col("size") / F.col("mean")
        half = 1 / (1 + F.exp(-F.col("tilt") * x))
        words = most * half * F.col("size") * F.col("n")
        # Sums of decimals don't depend on the order of tasks, so reruns find the same tilts to the last bit.
        sums = [F.sum(c.cast("decimal(38,9)")).cast("double") for c in (words, words * (1 - half) * x)]
        got = sizes.join(guess, "sid").groupBy("sid").agg(sums[0].alias("words"), sums[1].alias("slope"))
        for s, words, slope in got.collect():
            off = words - sources[s][2]
            if abs(off) <= 1e-9 * sources[s][2]:
                out[s] = now.pop(s)
                continue
            low, high = bounds[s] = [now[s], bounds[s][1]] if off < 0 else [bounds[s][0], now[s]]
            step = now[s] - off / slope if slope > 0 else math.nan
            if not low < step < high:  # Newton left the bracket: halve it, or double the way out of it
                step = (low + high) / 2 if math.isfinite(low + high) else 2 * now[s] + math.copysign(1, -off)
            if step == now[s]:
                out[s] = now.pop(s)
            else:
                now[s] = step
    return out | now


def _uniform(seed: int, salt: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "doc_id", "size"), 1) / F.lit(2.0**63)


def _corrected(rows: DataFrame, goals: dict[int, float], seed: int, turn: int, most: int) -> DataFrame:
    """``rows`` after single copies came or went, in hashed order, as long as they fit into what is missing or too much."""
    spark = rows.sparkSession
    off = {s: goals[s] - (n or 0) for s, n in rows.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size"))).collect()}
    gaps = listed(spark, [(s, abs(x), 1 if x > 0 else -1) for s, x in off.items()], "sid int, gap double, step int")
    able = (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & F.when(F.col("step") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    rows = rows.join(gaps, "sid").withColumn("order", _uniform(seed, turn)).withColumn("bin", F.when(able, F.least(F.floor(F.col("order") * BINS), F.lit(BINS - 1))))
    sums = rows.where("bin is not null").groupBy("sid", "bin", "gap").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("sid").orderBy("bin")))
    # Of each source, the first bin that doesn't fit whole.
    last = {s: (int(b), float(w)) for s, b, w in sums.where("upto > gap").groupBy("sid").agg(F.min("bin"), F.min(F.col("upto") - F.col("words"))).collect()}
    ends = listed(spark, [(s, *last.get(s, (BINS, 0.0))) for s in off], "sid int, last long, words_before double")
    rows = rows.join(ends, "sid")
    whole = rows.where("bin is null or bin <> last").withColumn("fits", F.coalesce(F.col("bin") < F.col("last"), F.lit(False)))
    upto = F.sum("size").over(Window.partitionBy("sid").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = rows.where("bin = last").withColumn("fits", F.col("words_before") + upto <= F.col("gap"))
    out = whole.unionByName(cut).withColumn("copies", F.col("copies") + F.when(F.col("fits"), F.col("step")).otherwise(0))
    return materialize(out.drop("gap", "step", "order", "bin", "last", "words_before", "fits"))


def mix(docs: DataFrame, seed: int = 11, key: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), rate and copies."""
    spark = docs.sparkSession
    rows = materialize(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words_of(text).alias("size")))
    sums = rows.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()
    sums = sorted(sums, key=lambda r: (r[0] is None, r[0] or ""))
    goals = targets([r[1] for r in sums])
    by_id = [(i, r[0], r[1], r[1] / r[2], goals[i]) for i, r in enumerate(sums)]
    names = listed(spark, by_id, "sid int, name string, source_size long, mean double, target double")
    rows = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    sizes = materialize(rows.where("size > 0").groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")))
    tilt = tilts(sizes, {i: (w, m, g) for i, _, w, m, g in by_id}, most)
    rows = rows.join(listed(spark, list(tilt.items()), "sid int, tilt double"), "sid")
    rate = F.when(F.col("size") == 0, most / 2).otherwise(most / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("mean"))))
    rows = rows.withColumn("rate", rate)
    copies = F.least(F.floor("rate") + F.when(_uniform(seed, 0) < F.col("rate") - F.floor("rate"), 1).otherwise(0), F.lit(most))
    rows = materialize(rows.withColumn("copies", copies.cast("int")).drop("mean", "tilt"))
    for turn in range(1, PASSES + 1):
        rows = _corrected(rows, dict(enumerate(goals)), seed, turn, most)
    return rows.drop("sid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
