"""Predicates and edits of JSON against a small model of their rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import json_paths as J

RECORD = '{"amount":100,"ratio":1.5,"status":"completed","tags":["a","b",3],"note":"hello world","on":true,"none":null,"o":{"x":{"y":1}},"big":9007199254740993,"digits":"100"}'
CASES = [
    ("amount", "equals", 100, True), ("amount", "equals", 100.0, True), ("amount", "equals", "100", False), ("digits", "equals", 100, False), ("amount", "not_equals", 99, True), ("amount", "not_equals", 100, False),
    ("gone", "not_equals", 1, False), ("gone", "equals", None, False), ("gone", "greater_than", 0, False), ("none", "exists", None, True), ("none", "not_exists", None, False), ("none", "equals", None, False),
    ("none", "not_equals", 1, True), ("gone", "exists", None, False), ("gone", "not_exists", None, True), ("amount", "greater_than", 99.5, True), ("amount", "greater_than_or_equal", 100, True), ("amount", "less_than", 100, False),
    ("amount", "less_than_or_equal", 100, True), ("status", "greater_than", "abc", True), ("status", "less_than", 5, False), ("amount", "less_than", "5", False), ("note", "contains", "lo wo", True), ("note", "contains", "xyz", False),
    ("digits", "contains", 10, True), ("tags", "contains", "a", True), ("tags", "contains", 3, True), ("tags", "contains", "3", False), ("amount", "contains", "1", False), ("tags", "equals", "a", False), ("tags", "not_equals", "a", True),
    ("o", "equals", "x", False), ("o.x.y", "equals", 1, True), ("o.x.y.z", "exists", None, False), ("status.x", "exists", None, False), ("on", "equals", True, True), ("on", "equals", 1, False), ("on", "equals", "true", False),
    ("big", "equals", 9007199254740993, True), ("big", "equals", 9007199254740992, False), ("ratio", "equals", 1.5, True), ("tags.0", "exists", None, False),
]


def test_comparisons(spark):
    df = spark.createDataFrame([(RECORD,)], "value string")
    v = J.decoded(F.col("value"))
    row = df.select(*(J.compare(v, f, o, x).alias(f"c{i}") for i, (f, o, x, _) in enumerate(CASES))).first()
    assert [c for i, c in enumerate(CASES) if row[i] != c[3]] == []


@pytest.mark.parametrize("text", ["not json", "5", '"s"', "[1]", "{"])
def test_what_is_no_object_fails_every_predicate(spark, text):
    df = spark.createDataFrame([(text,)], "value string")
    v = J.decoded(F.col("value"))
    assert not any(df.select(*(F.coalesce(J.compare(v, "a", o, 1), F.lit(False)).alias(o) for o in J.OPERATORS)).first())


def test_empty_and_null_payloads_are_objects(spark):
    df = spark.createDataFrame([("",), ("  ",), ("null",), (None,)], "value string")
    assert df.where(J.compare(J.decoded(F.col("value")), "a", "not_exists")).count() == 4


def test_unknown_operator():
    with pytest.raises(ValueError):
        J.compare(F.lit(None), "a", "like", 1)


def edit(spark, text, *steps, **how):
    return json.loads(J.staged(spark.createDataFrame([(text,)], "value string"), list(steps), **how).first().value)


def test_edits(spark):
    text = '{"a":1,"b":{"c":"<x>"},"n":null,"s":"t"}'
    assert edit(spark, text, out=lambda v: J.select(v, ["a", "b.c", "n", "gone.x"])) == {"a": 1, "b": {"c": "<x>"}, "n": None}
    assert edit(spark, text, lambda v: J.rename(v, "b.c", "d.e")) == {"a": 1, "b": {}, "n": None, "s": "t", "d": {"e": "<x>"}}
    assert edit(spark, text, lambda v: J.rename(v, "gone", "x")) == json.loads(text)
    assert edit(spark, text, lambda v: J.rename(v, "a", "a")) == json.loads(text)
    assert edit(spark, text, lambda v: J.rename(v, "a", "s.x")) == json.loads(text)  # a string is in the way
    assert edit(spark, text, lambda v: J.rename(v, "a", "s"))["s"] == 1
    assert edit(spark, text, lambda v: J.put(v, "p.q.r", J.constant([1, {"z": None}])))["p"] == {"q": {"r": [1, {"z": None}]}}
    assert edit(spark, text, lambda v: J.put(v, "s.x", J.constant(1))) == json.loads(text)
    assert edit(spark, text, lambda v: J.delete(v, "b.c"))["b"] == {}
    assert edit(spark, text, lambda v: J.delete(v, "b.x.y")) == json.loads(text)
    broken = spark.createDataFrame([("not json",)], "value string")
    assert J.staged(broken, [lambda v: J.put(v, "a", J.constant(1))]).first().value == "not json"


def model(record, path, operator, value):
    at = record
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            return operator == "not_exists"
        at = at[part]
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    equal = (number(at) and number(value) and at == value) or (isinstance(at, str) and isinstance(value, str) and at == value) or (isinstance(at, bool) and isinstance(value, bool) and at == value)
    if operator in ("exists", "not_exists"):
        return operator == "exists"
    if operator in ("equals", "not_equals"):
        return equal == (operator == "equals")
    if operator == "contains":
        return isinstance(at, str) and str(value) in at
    if number(at) and number(value) or isinstance(at, str) and isinstance(value, str):
        return {"greater_than": at > value, "greater_than_or_equal": at >= value, "less_than": at < value, "less_than_or_equal": at <= value}[operator]
    return False


def test_random_records_against_the_model(spark):
    rng = random.Random(3)
    values = [0, 1, -1, 2.5, 10**15, "a", "b", "10", "", True, False, None]
    records = [{k: rng.choice([*values, {"y": rng.choice(values)}]) for k in rng.sample("abcx", rng.randint(0, 4))} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, value string")
    asked = [(p, o, x) for p in ("a", "x.y") for o in J.OPERATORS for x in (1, 2.5, "a", "10") if not (o == "contains" and not isinstance(x, str))]
    v = J.decoded(F.col("value"))
    rows = df.select("i", *(J.compare(v, *q).alias(f"q{k}") for k, q in enumerate(asked))).collect()
    assert [(records[r.i], q) for r in rows for k, q in enumerate(asked) if r[f"q{k}"] != model(records[r.i], *q)] == []
