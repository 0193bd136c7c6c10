"""One query for each operator over the fixture tables, and the same in DuckDB's SQL.

Arrival order is ``event_id``; sums of values are exact decimals, given as doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .envelope import window_headers
from .functions import json_paths as J
from .functions import reducers as R
from .functions.windows import Session, Sliding, Tumbling
from .operators.stream import Stream, StreamEnv
from .sinks.basic import hive_layout
from .sinks.postgres import last_per_key

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EXACT = "decimal(18,2)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def events(spark: SparkSession, d: str) -> Stream:
    return StreamEnv(spark).from_source(spark.read.parquet(f"{d}/events.parquet"), key="user_id", ts="ts", arrival=("event_id",))


def bounds(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def exact(c: str = "sum") -> Column:
    return F.col(c).cast("double").alias(c)


def sums(df: DataFrame, *keys: str) -> DataFrame:
    return bounds(df).select(*keys, "window_start", "window_end", "n", exact())


N, SUM = R.count("n"), R.total("value", "sum", EXACT)


# -- records --------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id * 2 AS doubled, value + 1 AS value_plus, upper(event_type) AS kind FROM events")
def map_project(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).map(F.col("event_id"), (F.col("user_id") * 2).alias("doubled"), (F.col("value") + 1).alias("value_plus"), F.upper("event_type").alias("kind")).df


@query(r"SELECT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(trim(text, E' \t\n\r\f\x0B'), '[ \t\n\r\f\x0B]+')) AS word FROM documents) WHERE word <> ''")
def flatmap_words(spark: SparkSession, d: str) -> DataFrame:
    docs = StreamEnv(spark).from_source(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), key="doc_id")
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    return docs.flat_map(words, "word").map(F.col("doc_id"), F.col("word")).df


PROPS = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def filtered(spark: SparkSession, d: str, field: str, operator: str, value: object = None) -> DataFrame:
    v = J.decoded(F.col("props"))
    return events(spark, d).filter(J.compare(v, field, operator, value)).map(F.col("event_id"), F.col("props")).df


@query(f"SELECT event_id, props FROM events WHERE {PROPS} = 42")
def filter_equals(spark: SparkSession, d: str) -> DataFrame:
    return filtered(spark, d, "k", "equals", 42)


@query(f"SELECT event_id, props FROM events WHERE {PROPS} <> 42")
def filter_not_equals(spark: SparkSession, d: str) -> DataFrame:
    return filtered(spark, d, "k", "not_equals", 42)


@query(f"SELECT event_id, props FROM events WHERE {PROPS} > 50")
def filter_greater_than(spark: SparkSession, d: str) -> DataFrame:
    return filtered(spark, d, "k", "greater_than", 50)


@query(f"SELECT event_id, props FROM events WHERE {PROPS} >= 50")
def filter_greater_than_or_equal(spark: SparkSession, d: str) -> DataFrame:
    return filtered(spark, d, "k", "greater_than_or_equal", 50)


@query(f"SELECT event_id, props FROM events WHERE {PROPS} < 50")
def filter_less_than(spark: SparkSession, d: str) -> DataFrame:
    return filtered(spark, d, "k", "less_than", 50)


@query(f"SELECT event_id, props FROM events WHERE {PROPS} <= 50")
def filter_less_than_or_equal(spark: SparkSession, d: str) -> DataFrame:
    return filtered(spark, d, "k", "less_than_or_equal", 50)


def typed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records of nested JSON."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    customer = F.struct(F.col("o_custkey").cast("string").alias("id"))
    tags = F.array(F.lower("o_orderpriority"), F.col("o_orderstatus"))
    fields = [customer.alias("customer"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), tags.alias("tags")]
    # A missing note is left out of the JSON.
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("note of "), F.col("o_orderkey"))).alias("note")
    return o.select(F.col("o_orderkey").alias("offset"), F.lit(0).alias("partition"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.to_json(F.struct(*fields, note)).alias("value"), "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urgent')")
def filter_contains(spark: SparkSession, d: str) -> DataFrame:
    v = J.decoded(F.col("value"))
    rows = typed_orders(spark, d).where(J.compare(v, "tags", "contains", "1-urgent") | J.compare(v, "status", "contains", "nothing"))
    return rows.select(F.col("offset").alias("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def filter_exists(spark: SparkSession, d: str) -> DataFrame:
    return typed_orders(spark, d).where(J.compare(J.decoded(F.col("value")), "note", "exists")).select(F.col("offset").alias("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def filter_not_exists(spark: SparkSession, d: str) -> DataFrame:
    return typed_orders(spark, d).where(J.compare(J.decoded(F.col("value")), "note", "not_exists")).select(F.col("offset").alias("o_orderkey"))


def halves(spark: SparkSession, d: str, on_error: str) -> Stream:
    ok = F.col("event_type") != "error"
    return events(spark, d).process((F.col("value") / 2), ok, F.concat(F.lit("bad event "), F.col("event_id")), on_error, name="half")


@query("SELECT event_id, value / 2 AS half FROM events WHERE event_type <> 'error'")
def process_drop(spark: SparkSession, d: str) -> DataFrame:
    return halves(spark, d, "drop").map(F.col("event_id"), F.col("half")).df


@query("SELECT event_id, 'bad event ' || event_id AS _error FROM events WHERE event_type = 'error'")
def process_dlq(spark: SparkSession, d: str) -> DataFrame:
    return halves(spark, d, "dlq").rejected[0].select("event_id", "_error")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'note of ' || o_orderkey END AS note, NULL::VARCHAR AS amount FROM orders")
def select_fields(spark: SparkSession, d: str) -> DataFrame:
    out = typed_orders(spark, d).withColumn("value", J.select(J.decoded(F.col("value")), ["customer.id", "status", "note", "gone"]))
    return out.select(F.col("offset").alias("o_orderkey"), *(J.text_at(F.col("value"), p).alias(n) for n, p in (("customer", "customer.id"), ("status", "status"), ("note", "note"), ("amount", "amount"))))


@query("SELECT o_orderkey, o_orderstatus AS state, CAST(o_custkey AS VARCHAR) AS buyer, NULL::VARCHAR AS status FROM orders")
def rename_fields(spark: SparkSession, d: str) -> DataFrame:
    out = J.staged(typed_orders(spark, d), [lambda v: J.rename(v, "status", "state"), lambda v: J.rename(v, "customer.id", "buyer.id")])
    return out.select(F.col("offset").alias("o_orderkey"), *(J.text_at(F.col("value"), p).alias(n) for n, p in (("state", "state"), ("buyer", "buyer.id"), ("status", "status"))))


@query("SELECT o_orderkey, 'eu' AS region, 'true' AS checked, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def set_fields(spark: SparkSession, d: str) -> DataFrame:
    sets = {"meta.region": "eu", "customer.checked": True, "status.x": 1}  # a string is in the way of the last: nothing changes
    out = J.staged(typed_orders(spark, d), [lambda v, k=k, x=x: J.put(v, k, J.constant(x)) for k, x in sets.items()])
    return out.select(F.col("offset").alias("o_orderkey"), *(J.text_at(F.col("value"), p).alias(n) for n, p in (("region", "meta.region"), ("checked", "customer.checked"), ("customer", "customer.id"))))


# -- keyed aggregation ----------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def keyby_count_final(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).key_by("user_id").reduce(N, mode="final").df


@query("SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM events GROUP BY user_id")
def keyby_sum_final(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).key_by("user_id").reduce(SUM, mode="final").df.select("user_id", exact())


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def reduce_running_count(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).key_by("user_id").reduce(N).df.select("event_id", "user_id", "n")


@query("SELECT event_id, user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS sum FROM events")
def reduce_running_sum(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).key_by("user_id").reduce(SUM).df.select("event_id", "user_id", exact())


@query("SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id")
def reduce_last(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).key_by("user_id").reduce(R.last("event_type"), mode="final").df


@query("SELECT event_id, min(value) OVER w AS min, max(value) OVER w AS max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def reduce_min_max(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).key_by("user_id").reduce(R.least("value"), R.most("value")).df.select("event_id", "min", "max")


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY event_id) AS path FROM events GROUP BY user_id")
def reduce_fold(spark: SparkSession, d: str) -> DataFrame:
    path = R.fold(["event_type"], F.lit(""), lambda acc, x: F.when(acc == "", x.event_type).otherwise(F.concat(acc, F.lit(">"), x.event_type)), "path")
    return events(spark, d).key_by("user_id").reduce(path, mode="final").df


@query("SELECT customer AS key, count(*) AS n FROM (SELECT CAST(o_custkey AS VARCHAR) AS customer FROM orders) GROUP BY 1")
def keyby_json_count(spark: SparkSession, d: str) -> DataFrame:
    orders = StreamEnv(spark).from_source(typed_orders(spark, d))
    return orders.key_by(J.text_at(F.col("value"), "customer.id")).reduce(N, mode="final").df


@query("SELECT event_type, user_id, count(*) AS n, GROUPING(event_type) AS g FROM events GROUP BY CUBE (event_type, user_id)")
def superset_cube(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).df.cube("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.grouping("event_type").cast("bigint").alias("g"))


# -- windows --------------------------------------------------------------------------------------------------------


def tumbled(us: int, offset: int = 0) -> str:
    start = f"((epoch_us(ts) - {offset}) // {us}) * {us} + {offset}"
    return f"make_timestamp({start}) AS window_start, make_timestamp({start} + {us}) AS window_end"


HOUR = 3_600_000_000


@query(f"SELECT event_id, {tumbled(HOUR)} FROM events")
def window_tumbling_rows(spark: SparkSession, d: str) -> DataFrame:
    return bounds(events(spark, d).key_by("user_id").window(Tumbling("1h")).df).select("event_id", "window_start", "window_end")


@query(f"SELECT event_id, {tumbled(5 * HOUR, 2 * HOUR)} FROM events")
def window_tumbling_offset(spark: SparkSession, d: str) -> DataFrame:
    return bounds(events(spark, d).key_by("user_id").window(Tumbling("5h", "2h")).df).select("event_id", "window_start", "window_end")


SLID = f"""SELECT *, make_timestamp((epoch_us(ts) // {HOUR // 2} - i) * {HOUR // 2}) AS window_start,
 make_timestamp((epoch_us(ts) // {HOUR // 2} - i) * {HOUR // 2} + {HOUR}) AS window_end FROM events, generate_series(0, 1) AS s(i)"""


@query(f"SELECT event_id, window_start, window_end FROM ({SLID})")
def window_sliding_rows(spark: SparkSession, d: str) -> DataFrame:
    return bounds(events(spark, d).key_by("user_id").window(Sliding("1h", "30m")).df).select("event_id", "window_start", "window_end")


#: Whole hours, so that events exactly one gap apart occur.
ISLANDS = """SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY hr RANGE UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN lag(hr) OVER (PARTITION BY user_id ORDER BY hr) IS NULL OR hr >= lag(hr) OVER (PARTITION BY user_id ORDER BY hr) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh
 FROM (SELECT event_id, user_id, value, date_trunc('hour', ts) AS hr FROM events))"""


def hourly(spark: SparkSession, d: str) -> Stream:
    s = events(spark, d)
    return StreamEnv(spark).from_source(s.df.withColumn("at", F.date_trunc("hour", "ts").cast("timestamp_ntz")), key="user_id", ts="at", arrival=("event_id",))


@query(f"SELECT event_id, min(hr) OVER w AS window_start, max(hr) OVER w + INTERVAL 6 HOUR AS window_end FROM ({ISLANDS}) WINDOW w AS (PARTITION BY user_id, island)")
def window_session_rows(spark: SparkSession, d: str) -> DataFrame:
    return bounds(hourly(spark, d).key_by("user_id").window(Session("6h")).df).select("event_id", "window_start", "window_end")


@query(f"SELECT user_id, {tumbled(HOUR)}, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM events WHERE event_type = 'click' GROUP BY ALL")
def window_reduce_tumbling(spark: SparkSession, d: str) -> DataFrame:
    clicks = events(spark, d).filter(F.col("event_type") == "click").key_by("user_id")
    return sums(clicks.window_reduce(Tumbling("1h"), N, SUM).df, "user_id")


@query(f"SELECT user_id, window_start, window_end, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM ({SLID}) GROUP BY ALL")
def window_reduce_sliding(spark: SparkSession, d: str) -> DataFrame:
    return sums(events(spark, d).key_by("user_id").window_reduce(Sliding("1h", "30m"), N, SUM).df, "user_id")


@query(f"SELECT user_id, min(hr) AS window_start, max(hr) + INTERVAL 6 HOUR AS window_end, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM ({ISLANDS}) GROUP BY user_id, island")
def window_reduce_session(spark: SparkSession, d: str) -> DataFrame:
    return sums(hourly(spark, d).key_by("user_id").window_reduce(Session("6h"), N, SUM).df, "user_id")


@query(f"SELECT user_id, {tumbled(24 * HOUR)}, count(*) AS n, arg_max(ts, event_id) AS ts, max(event_id) AS event_id FROM events GROUP BY user_id, window_start, window_end")
def window_reduce_last_meta(spark: SparkSession, d: str) -> DataFrame:
    out = events(spark, d).key_by("user_id").window_reduce(Tumbling("24h"), N, keep=("ts", "event_id")).df
    return bounds(out).select("user_id", "window_start", "window_end", "n", "ts", "event_id")


@query(f"SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id, epoch_us(ts) // {24 * HOUR} ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS sum FROM events")
def window_then_reduce_incremental(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).key_by("user_id").window(Tumbling("24h")).reduce(SUM).df.select("event_id", exact())


@query(f"""SELECT CAST(user_id AS VARCHAR) AS key, strftime(make_timestamp((epoch_us(ts) // {HOUR}) * {HOUR}), '%Y-%m-%dT%H:%M:%SZ') AS window_start, count(*) AS n FROM events GROUP BY ALL""")
def window_headers_rendered(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).key_by("user_id").window(Tumbling("1h"))
    df = s.df.select(F.col("user_id").cast("string").alias("key"), "window", F.create_map().cast("map<string,string>").alias("headers"))
    return window_headers(df).groupBy("key", F.col("headers")["window_start"].alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


# -- late records ---------------------------------------------------------------------------------------------------

SHUFFLED = "SELECT *, row_number() OVER (ORDER BY epoch_us(ts) + ((event_id * 7919) % 1200) * 1000000, event_id) AS arrival FROM events"
WATERMARKED = f"SELECT *, max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 MINUTE AS wm FROM ({SHUFFLED})"


def shuffled(spark: SparkSession, d: str) -> Stream:
    df = events(spark, d).df.withColumn("arrives", F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") * 7919 % 1200) * 1_000_000)
    return StreamEnv(spark).from_source(df, key="user_id", ts="ts", arrival=("arrives", "event_id")).with_watermark("5m")


@query(f"SELECT user_id, {tumbled(HOUR)}, count(*) AS n FROM ({WATERMARKED}) WHERE wm IS NULL OR ts >= wm GROUP BY ALL")
def late_drop_bounded(spark: SparkSession, d: str) -> DataFrame:
    return bounds(shuffled(spark, d).key_by("user_id").window_reduce(Tumbling("1h"), N).df).select("user_id", "window_start", "window_end", "n")


@query(f"SELECT event_id FROM ({WATERMARKED}) WHERE ts < wm")
def late_side_output(spark: SparkSession, d: str) -> DataFrame:
    return shuffled(spark, d).late().select("event_id")


# -- sinks and workflows ---------------------------------------------------------------------------------------------


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def pg_upsert_last_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    return last_per_key(rows, ["o_custkey"], ["o_orderkey"])


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS n FROM events GROUP BY ALL")
def hive_layout_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).df.withColumn("ts", F.col("ts").cast("timestamp"))
    return hive_layout(rows, "ts").groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n"))


TOTALS = """
name: order-totals
source: {type: slice, records: []}
pipeline:
  - {id: shipped, type: filter, filter: {field: status, operator: equals, value: F}}
  - {id: by-customer, type: keyBy, keyBy: {field: customer.id}}
  - {id: totals, type: reduce, reduce: {function: sum, field: amount}}
sink: {type: blackhole}
"""


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS \"offset\", CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS sum FROM orders WHERE o_orderstatus = 'F'")
def workflow_order_totals(spark: SparkSession, d: str) -> DataFrame:
    from .workflow.compiler import apply
    from .workflow.parse import loads

    source = typed_orders(spark, d).select(F.lit("").alias("key"), "value", "timestamp", "offset", "partition", F.create_map().cast("map<string,string>").alias("headers"))
    out = apply(StreamEnv(spark).from_source(source), loads(TOTALS, "yaml").pipeline).df
    # The payload holds a double; two decimals of it are exact at these sizes.
    return out.select("key", "offset", F.round(F.get_json_object("value", "$.sum").cast("double"), 2).alias("sum"))
