"""Links of a similarity join without all pairs: hubs of buckets, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, joined, materialize, tidied

#: Members of a bucket that meet in one task, twice.
BLOCK = 512


@tidied
def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is the smallest id within reach.

    Large stars, then small stars, until nothing changes: each round is joins and minima only, and needs about the
    logarithm of the longest path. No neighbour list is ever gathered.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = None
    while True:
        links = materialize(links)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # What is left of nodes without larger neighbours: their links to the minimum.
        large = materialize(large.distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        links = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct()
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


@tidied
def link_buckets(
    entries: DataFrame, facts: DataFrame, may: Callable[[Column, Column], Column], texts_of: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame, DataFrame], DataFrame], matcher: Callable[[], Matcher],
    screen: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(id, component) of all ids that any chain of links within buckets connects with another.

    ``entries`` has (key, id); members of one key are candidates for each other if ``may`` holds of their facts
    (``facts``: id, fact). ``texts_of(ids)`` gives (id, text) for all ids that may be compared.
    First, all members are paired with the smallest id of their bucket: one pair a member. ``check`` gives those that
    are linked. Buckets whose members then are in one component are done. In the others, every member outside the
    hub's component meets all members in blocks, so no pair is lost to a bucket's size, and its pairs are no rows but
    for some a member at most. With ``screen`` (``may`` for pairs of rows of a frame of facts), members meet without their texts first
    (``screened``), and only those that may be linked with one of another component meet with them (``settle``).
    """
    # Entries are moved as they are: sums of each task would be wider, since most keys have one member.
    buckets = entries.repartition("key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub"), F.max("id").alias("last"))
    buckets = materialize(buckets.where("n > 1"))
    # A bucket of two is its smallest and its largest id: only larger ones are joined with their members.
    members = materialize(joined(entries, buckets.where("n > 2").select("key", "hub"), "key"))
    pairs = buckets.where("n = 2").select(F.col("last").alias("a"), F.col("hub").alias("b"))
    pairs = pairs.unionByName(members.select(F.col("id").alias("a"), F.col("hub").alias("b"))).where("a <> b").distinct()
    left, right = (facts.select(F.col("id").alias(x), F.col("fact").alias(f"fact_{x}")) for x in ("a", "b"))
    pairs = pairs.join(left, "a").join(right, "b").where(may(F.col("fact_a"), F.col("fact_b"))).select("a", "b")
    pairs = materialize(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    texts = texts_of((ids if screen else ids.union(members.select("id"))).distinct())
    parts = components(check(pairs, texts))
    if members.isEmpty():
        return parts
    placed = members.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    hubs = parts.select(F.col("id").alias("hub"), F.col("component").alias("hub_component"))
    placed = materialize(placed.join(hubs, "hub", "left").withColumn("hub_component", F.coalesce("hub_component", "hub")))
    more = []
    if screen:
        found = materialize(screened(placed, facts, screen))
        many = found.where("b is null").select("key", F.col("a").alias("id")).distinct()
        # Pairs of several buckets are looked at once.
        few = materialize(found.where("b is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
        texts = texts_of(few.select(F.col("a").alias("id")).union(few.select("b")).union(many.select("id")).distinct())
        more.append(check(few, texts))
        placed = materialize(placed.join(many, ["key", "id"]))
    if not screen or not placed.isEmpty():
        more.append(settle(placed, texts, matcher))
    more = materialize(reduce(DataFrame.unionByName, more))
    return parts if more.isEmpty() else components(more.unionByName(parts.select(F.col("id").alias("a"), F.col("component").alias("b"))))


class Matcher(Protocol):
    """Compares members of a block. ``near`` may only leave out what ``same`` would refuse."""

    def items(self, texts: list[str]) -> list: ...

    def index(self, items: list) -> Any: ...

    def near(self, item: Any, index: Any) -> Iterable[int]: ...

    def same(self, a: Any, b: Any) -> bool: ...


def cells(placed: DataFrame, block: int) -> DataFrame:
    """(key, id, component, u, v, vs, apart): each block of members outside the hub's component (u, ``apart`` 1) beside
    each block of all members (v of ``vs``, ``apart`` 0). ``placed`` has (key, id, component, hub_component)."""
    apart = F.col("component") != F.col("hub_component")
    sizes = placed.groupBy("key").agg(F.ceil(F.sum(apart.cast("int")) / block).cast("long").alias("us"), F.ceil(F.count(F.lit(1)) / block).cast("long").alias("vs")).where("us > 0")
    placed = placed.join(sizes, "key")
    h = F.xxhash64("id", "key")
    everyone = placed.select("key", "id", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("us") - 1)).alias("u"), F.pmod(h, F.col("vs")).alias("v"), "vs", F.lit(0).alias("apart"))
    outside = placed.where(apart).select("key", "id", "component", F.pmod(h, F.col("us")).alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("vs") - 1)).alias("v"), "vs", F.lit(1).alias("apart"))
    return everyone.unionByName(outside)


def by_cell(rows: DataFrame, run: Callable[[], Callable[[pa.Table], pa.Table | None]], schema: str) -> DataFrame:
    """Cells by task, whole cells to a call of ``run()``, as many as a batch or two have; (key, u, v, apart) in order.

    As many tasks as there are shuffle partitions: cells are small to read and long to compare."""
    bounded_batches(rows.sparkSession, 4 * BLOCK)
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "u", "v").sortWithinPartitions("key", "u", "v", F.desc("apart"), "id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, held = run(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(pa.Table.from_batches([batch]))
            if held and not _same(held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)):
                starts = np.concatenate([[0], starts])
            if len(starts):  # what comes before the last cell that begins here is whole
                whole = [*held, batch.slice(0, starts[-1])]
                held = []
                if any(x.num_rows for x in whole):
                    yield from work(pa.Table.from_batches(whole)).to_batches()
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(step, schema)


def _starts(table: pa.Table) -> np.ndarray:
    """Rows at which a cell begins, but for the first row."""
    new = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for c in ("key", "u", "v"):
        x = table[c].to_numpy()
        new |= x[1:] != x[:-1]
    return np.flatnonzero(new) + 1


def _same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a[c][0].as_py() == b[c][0].as_py() for c in ("key", "u", "v"))


def _sides(table: pa.Table) -> Iterator[tuple[int, int, int]]:
    """Of each cell, where its first side, its second and it end."""
    starts = np.concatenate([[0], _starts(table), [table.num_rows]])
    ours = np.concatenate([[0], np.cumsum(table["apart"].to_numpy())])
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield s, s + int(ours[e] - ours[s]), e


#: Pairs of members that are screened at a time, and pairs for each member up to which the cells of a bucket give pairs.
AT_ONCE, FEW_PAIRS = 1 << 20, 8


def screened(placed: DataFrame, facts: DataFrame, screen: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray], block: int = 2 * BLOCK) -> DataFrame:
    """(key, a, b): pairs of members of different components that may be linked, one of the two outside the hub's.

    A cell that has over its part of ``FEW_PAIRS`` such pairs a member (a member meets ``vs`` blocks) gives its members
    that have a partner instead, with a null b: pairs that are rows are in proportion to the members of a bucket."""

    def run() -> Callable[[pa.Table], pa.Table]:
        def work(table: pa.Table) -> pa.Table:
            rows, good = table.to_pandas(), np.zeros(table.num_rows, dtype=bool)
            parts, ids, keys = (rows[c].to_numpy() for c in ("component", "id", "key"))
            sides = list(_sides(table))
            cell = np.repeat(np.arange(len(sides)), [e - s for s, _, e in sides])
            most = FEW_PAIRS * np.bincount(cell) // rows["vs"].to_numpy()[[s for s, _, _ in sides]]
            seen = np.zeros(len(sides), dtype=np.int64)
            kept = [(np.zeros(0, np.int64),) * 2]

            def look(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                apart = parts[i] != parts[j]
                i, j = i[apart], j[apart]
                near = screen(rows, i, j)
                i, j = i[near], j[near]
                good[i] = good[j] = True
                seen[:] += np.bincount(cell[i], minlength=len(sides))
                few = seen[cell[i]] <= most[cell[i]]
                kept.append((i[few], j[few]))

            waiting, size = [], 0
            for s, m, e in sides:
                step = max(1, AT_ONCE // max(1, e - m))
                for k in range(s, m, step):
                    ours = np.arange(k, min(m, k + step))
                    waiting.append((np.repeat(ours, e - m), np.tile(np.arange(m, e), len(ours))))
                    size += len(waiting[-1][0])
                    if size >= AT_ONCE:
                        look(waiting)
                        waiting, size = [], 0
            if size:
                look(waiting)
            many = np.flatnonzero(good & (seen > most)[cell])
            i, j = (np.concatenate(x) for x in zip(*kept, strict=True))
            few = (seen <= most)[cell[i]]
            i, j = i[few], j[few]
            a, b = np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])
            b = pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(many), pa.int64())])
            return pa.table({"key": np.concatenate([keys[i], keys[many]]), "a": np.concatenate([a, ids[many]]), "b": b})

        return work

    return by_cell(cells(placed, block).join(facts.select("id", "fact.*"), "id"), run, "key long, a long, b long")


def settle(placed: DataFrame, texts: DataFrame, matcher: Callable[[], Matcher], block: int = BLOCK) -> DataFrame:
    """Links between components of a bucket."""

    def run() -> Callable[[pa.Table], pa.Table]:
        m = matcher()

        def work(table: pa.Table) -> pa.Table:
            out: dict[str, list[int]] = {"a": [], "b": []}
            ids, parts, text = table["id"].to_pylist(), table["component"].to_pylist(), table["text"].to_pylist()
            for s, t, e in _sides(table):
                if s == t or t == e:
                    continue
                root: dict[int, int] = {}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                items = m.items(text[t:e])
                index = m.index(items)
                for i, mine in zip(range(s, t), m.items(text[s:t]), strict=True):
                    for j in m.near(mine, index):
                        if (x := find(parts[i])) != (y := find(parts[t + j])) and m.same(mine, items[j]):
                            root[max(x, y)] = min(x, y)
                            out["a"].append(ids[i])
                            out["b"].append(ids[t + j])
            return pa.table(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        return work

    rows = cells(placed, block).join(texts, "id").select("key", "u", "v", "apart", "id", "component", "text")
    return materialize(by_cell(rows, run, "a long, b long").distinct())
