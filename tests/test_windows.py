from bisect import bisect_left
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions import reducers as R
from tidemill.functions.durations import micros, text
from tidemill.functions.windows import Session, Sliding, Tumbling, merge_sessions
from tidemill.operators.lateness import range_of, split_late
from tidemill.operators.stream import StreamEnv

BASE = datetime(2024, 1, 1, tzinfo=UTC)


def stream(spark, rows):
    data = [(k, v, BASE + timedelta(seconds=s), i, 0) for i, (k, v, s) in enumerate(rows)]
    return StreamEnv(spark).from_source(spark.createDataFrame(data, "key string, v long, timestamp timestamp, offset long, partition int"))


def spans(df, *more):
    out = df.select((F.unix_seconds("window.start") - int(BASE.timestamp())).alias("s"), (F.unix_seconds("window.end") - int(BASE.timestamp())).alias("e"), *more)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(
    ("rows", "window", "want"),
    [
        ([("k", 1, 7)], Sliding("10s", "5s"), [(0, 10), (5, 15)]),
        ([("k", 1, 3)], Sliding("5s", "5s"), [(0, 5)]),
        ([("k", 1, 3), ("k", 1, 3)], Sliding("10s", "5s"), [(-5, 5), (-5, 5), (0, 10), (0, 10)]),
        ([("k", 1, 12), ("k", 1, 14)], Tumbling("10s"), [(10, 20), (10, 20)]),
        ([("k", 1, 7)], Tumbling("5s", "1s"), [(6, 11)]),
        ([("k", 1, 0), ("k", 1, 10)], Session("30s"), [(0, 40), (0, 40)]),
        ([("k", 1, 0), ("k", 1, 20)], Session("5s"), [(0, 5), (20, 25)]),
        ([("k", 1, 0), ("k", 1, 18), ("k", 1, 9)], Session("10s"), [(0, 28)] * 3),
        ([("k", 1, 0), ("k", 1, 30)], Session("30s"), [(0, 30), (30, 60)]),
        ([("a", 1, 0), ("b", 1, 1)], Session("30s"), [(0, 30), (1, 31)]),
    ],
)
def test_rows(spark, rows, window, want):
    assert spans(stream(spark, rows).key_by("key").window(window).df) == want


def test_window_reduce(spark):
    s = stream(spark, [("k1", 1, 1), ("k1", 2, 2), ("k1", 3, 5), ("k1", 10, 12), ("k2", 100, 3)])
    assert spans(s.key_by("key").window_reduce(Tumbling("10s"), R.total("v")).df, "key", "sum") == [(0, 10, "k1", 6), (0, 10, "k2", 100), (10, 20, "k1", 10)]


@pytest.mark.parametrize(("second", "want"), [(30, [(0, 30, 1), (30, 60, 1)]), (29, [(0, 59, 2)])])
def test_sessions_that_touch_stay_apart(spark, second, want):
    s = stream(spark, [("k", 1, 0), ("k", 1, second)]).key_by("key")
    assert spans(s.window_reduce(Session("30s"), R.count("n")).df, "n") == want


def test_last_record_gives_its_columns(spark):
    s = stream(spark, [("k", 5, 4), ("k", 7, 2)]).key_by("key")
    row = s.window_reduce(Tumbling("10s"), R.count("n"), keep=("offset", "v")).df.first()
    assert (row.n, row.offset, row.v) == (2, 1, 7)


def test_running_reduce_is_per_record_and_window(spark):
    s = stream(spark, [("a", 2, 1), ("a", 3, 2), ("a", 4, 11), ("tenant/a/b", 9, 3)]).key_by("key")
    assert [r.sum for r in s.window(Tumbling("10s")).reduce(R.total("v")).df.orderBy("offset").collect()] == [2, 5, 4, 9]
    assert [r.sum for r in s.reduce(R.total("v")).df.orderBy("offset").collect()] == [2, 5, 9, 9]


def test_late_records(spark):
    rows = stream(spark, [("k", 1, 10), ("k", 2, 8), ("k", 3, 5), ("k", 4, 20), ("k", 5, 18), ("k", 6, 17)]).df
    for ranges in (1, 3):
        on_time, late = split_late(rows, "timestamp", ["offset"], "2s", ranges)
        assert sorted(r.v for r in late.collect()) == [3, 6]  # equal to the watermark is on time
        assert sorted(r.v for r in on_time.collect()) == [1, 2, 4, 5]


def test_ranges_of_an_order(spark):
    places = [float(x) for x in range(-3, 41)] + [1e18, float("inf"), None]
    df = spark.createDataFrame([(x,) for x in places], "x double")
    for n in (0, 1, 2, 3, 4, 7, 8, 31):
        cuts = [i * 1.25 for i in range(n)]
        got = [tuple(r) for r in df.select("x", range_of(F.col("x"), cuts)).collect()]
        assert got == [(x, 0 if x is None else bisect_left(cuts, x)) for x in places]
    many = df.select(range_of(F.col("x"), [float(i) for i in range(100_000)]).alias("r"))
    assert [r.r for r in many.where("r > 39").collect()] == [40, 100_000, 100_000]


def test_without_a_watermark_nothing_is_late(spark):
    s = stream(spark, [("k", 1, 100), ("k", 1, 1)]).key_by("key")
    assert s.window_reduce(Tumbling("10s"), R.count("n")).df.count() == 2
    assert s.late().count() == 0


def test_refused_windows():
    for make in (lambda: Tumbling(0), lambda: Sliding("5s", "10s"), lambda: Sliding("5s", 0), lambda: Session(0)):
        with pytest.raises(ValueError):
            make()


def test_merge_sessions():
    t = [BASE + timedelta(seconds=s) for s in (0, 20, 30, 60)]
    assert merge_sessions((t[0], t[2]), (t[1], t[3])) == (t[0], t[3])
    assert merge_sessions((t[0], t[2]), (t[2], t[3])) is None


@pytest.mark.parametrize(("s", "us"), [("5m", 300_000_000), ("1h30m", 5_400_000_000), ("500ms", 500_000), ("1.5s", 1_500_000), ("", 0), ("0", 0), ("-2s", -2_000_000), ("1500ns", 1), (timedelta(seconds=2), 2_000_000), (3, 3_000_000)])
def test_durations(s, us):
    assert micros(s) == us


def test_duration_faults_and_text():
    for bad in ("5", "5x", "m", "1h 2m"):
        with pytest.raises(ValueError):
            micros(bad)
    assert [text(micros(x)) for x in ("5m", "1h30m", "500ms", "2500ms", "0")] == ["5m0s", "1h30m0s", "500ms", "2.5s", "0s"]


def test_plan_and_description(spark):
    s = stream(spark, [("k", 1, 1)]).map(v=F.col("v") + 1).filter(F.col("v") > 0).key_by("key", 8).window(Tumbling("10s")).reduce(R.count())
    assert [(x["kind"], x["ops"]) for x in s.plan()] == [("source", []), ("stateless", ["Map", "Filter"]), ("keyed", ["KeyBy", "Window", "Reduce"]), ("sink", [])]
    split = stream(spark, []).map(v=F.col("v")).map(v=F.col("v")).with_parallelism(4).key_by("key").map(v=F.col("v")).reduce(R.count())
    assert [x["kind"] for x in split.plan()] == ["source", "stateless", "stateless", "keyed", "stateless", "single", "sink"]
    with pytest.raises(ValueError):
        s.key_by("key").with_partitions(0)
