"""Dotted paths and comparisons over JSON text, as columns that stay in the JVM.

A record's JSON is parsed once into a variant (``decoded``). A path crosses objects only; a null that is there is
present. Comparisons know JSON's types: a number never equals a quoted number, integers of 64 bits compare exactly,
order among numbers is that of doubles, and every comparison of a missing field is false.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("equals", "not_equals", "greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal", "contains", "exists", "not_exists")


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    Filters and branches would compute it again for each time; the variable of a lambda is a value."""
    return F.element_at(F.transform(F.array(x), body), 1)


def decoded(text: Column) -> Column:
    """The variant of a JSON object; empty text and a literal null are ``{}``; null where it can't be decoded."""
    trimmed = F.trim(text, F.lit(" \t\n\r"))
    # What parses and begins with a brace is an object.
    plain = bound(trimmed, lambda t: F.when(t.isNull() | t.isin("", "null"), F.lit("{}")).when(t.startswith("{"), t))
    return F.try_parse_json(plain)


def variant_path(path: str) -> str:
    return "$" + "".join("['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']" for part in path.split("."))


def get(v: Column, path: str) -> Column:
    """The variant at a path; SQL null where it is missing."""
    return F.try_variant_get(v, variant_path(path), "variant")


def kind(x: Column) -> Column:
    """number, string, boolean, null, array or object; SQL null where missing."""
    return bound(
        F.schema_of_variant(x),
        lambda s: F.when(s.isNull(), None).when(s == "VOID", "null").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").otherwise("number"),
    )


def text_at(text: Column, path: str) -> Column:
    """The literal text of a scalar at a path (``1.0`` stays ``1.0``); null where missing or null."""
    return F.get_json_object(text, variant_path(path))


def spoken(value: Any) -> str:
    """A constant as text, for substring tests."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value) if not isinstance(value, (list, dict)) else json.dumps(value)


def equal(x: Column, value: Any) -> Column:
    """Whether a variant equals a constant of the same JSON type; never null."""
    return bound(x, lambda x: _equal(x, value))


def _equal(x: Column, value: Any) -> Column:
    if isinstance(value, bool):
        same = (kind(x) == "boolean") & (F.try_variant_get(x, "$", "boolean") == F.lit(value))
    elif isinstance(value, (int, float)):
        number = F.try_variant_get(x, "$", "double") == F.lit(float(value))
        if isinstance(value, int) and -(2**63) <= value < 2**63:
            number = F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint") == F.lit(value).cast("bigint")).otherwise(number)
        same = (kind(x) == "number") & number
    elif isinstance(value, str):
        same = (kind(x) == "string") & (F.try_variant_get(x, "$", "string") == F.lit(value))
    else:
        same = F.lit(False)
    return F.coalesce(same, F.lit(False))


def compare(v: Column, path: str, operator: str, value: Any = None) -> Column:
    """The predicate ``path operator value`` over a decoded record; false where the record couldn't be decoded."""
    if operator not in OPERATORS:
        raise ValueError(f"unsupported filter operator {operator!r}")
    if operator == "exists":
        return get(v, path).isNotNull()
    if operator == "not_exists":
        return bound(v, lambda v: v.isNotNull() & get(v, path).isNull())
    return bound(get(v, path), lambda x: _test(x, operator, value))


def _test(x: Column, operator: str, value: Any) -> Column:
    if operator == "equals":
        return _equal(x, value)
    if operator == "not_equals":
        return x.isNotNull() & ~_equal(x, value)
    if operator == "contains":
        within = (kind(x) == "string") & (F.instr(F.try_variant_get(x, "$", "string"), spoken(value)) > 0 if spoken(value) else F.lit(True))
        member = (kind(x) == "array") & F.exists(F.try_variant_get(x, "$", "array<variant>"), lambda y: equal(y, value))
        return F.coalesce(within, F.lit(False)) | F.coalesce(member, F.lit(False))
    test = {"greater_than": "__gt__", "greater_than_or_equal": "__ge__", "less_than": "__lt__", "less_than_or_equal": "__le__"}[operator]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if isinstance(value, float) and math.isnan(value):
            return F.lit(False)
        ordered = (kind(x) == "number") & getattr(F.try_variant_get(x, "$", "double"), test)(F.lit(float(value)))
    elif isinstance(value, str):
        ordered = (kind(x) == "string") & getattr(F.try_variant_get(x, "$", "string"), test)(F.lit(value))
    else:
        ordered = F.lit(False)
    return F.coalesce(ordered, F.lit(False))


def number(v: Column, path: str) -> Column:
    """The double of a JSON number at a path, 0 for anything else: what sums add."""
    return bound(get(v, path), lambda x: F.coalesce(F.when(kind(x) == "number", F.try_variant_get(x, "$", "double")), F.lit(0.0)))


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _with(v: Column, name: str, x: Column | None) -> Column:
    """An object with a member replaced, or removed where ``x`` is None."""
    rest = F.map_filter(_members(v), lambda k, _: k != name)
    return F.to_variant_object(rest if x is None else F.map_concat(rest, F.create_map(F.lit(name), x)))


def put(v: Column, path: str, x: Column) -> Column:
    """``v`` with ``x`` at a path, objects made on the way; unchanged if something else than an object is in the way."""
    head, _, rest = path.partition(".")
    if not rest:
        return _with(v, head, x)

    def below(v: Column, inner: Column) -> Column:
        free = inner.isNull() | (kind(inner) == "object") & _free(inner, rest)
        return F.when(free, _with(v, head, put(F.coalesce(inner, F.parse_json(F.lit("{}"))), rest, x))).otherwise(v)

    return bound(v, lambda v: bound(get(v, head), lambda inner: below(v, inner)))


def _free(v: Column, path: str) -> Column:
    """Whether nothing but objects is in the way of a path."""
    head, _, rest = path.partition(".")
    if not rest:
        return F.lit(True)
    return bound(get(v, head), lambda inner: inner.isNull() | (kind(inner) == "object") & _free(inner, rest))


def delete(v: Column, path: str) -> Column:
    """``v`` without a path; unchanged where it is missing."""
    head, _, rest = path.partition(".")
    if not rest:
        return _with(v, head, None)
    return bound(v, lambda v: bound(get(v, head), lambda inner: F.when(kind(inner) == "object", _with(v, head, delete(inner, rest))).otherwise(v)))


def rename(v: Column, old: str, new: str) -> Column:
    """Moves a field; nothing happens where it is missing, where both names are one, or where the new place is taken
    by something that is no object."""
    if old == new:
        return v
    inside = new.startswith(old + ".")

    def moved(v: Column, x: Column) -> Column:
        there = put(delete(v, old), new, x) if inside else delete(put(v, new, x), old)
        return F.when(x.isNotNull() & _free(v, new), there).otherwise(v)

    return bound(v, lambda v: bound(get(v, old), lambda x: moved(v, x)))


def staged(df: DataFrame, steps: list[Callable[[Column], Column]], value: str = "value", out: Callable[[Column], Column] = F.to_json) -> DataFrame:
    """``df`` with its JSON edited step by step, parsed once; what can't be decoded stays as it is."""

    def edited(v: Column) -> Column:
        for step in steps:
            v = step(v)
        return out(v)

    return df.withColumn(value, bound(decoded(F.col(value)), lambda v: F.when(v.isNotNull(), edited(v)).otherwise(F.col(value))))


def constant(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def select(v: Column, paths: list[str]) -> Column:
    """Text of an object with these paths only; missing ones are left out, nulls are kept."""
    tree: dict = {}
    for p in paths:
        at, parts = tree, p.split(".")
        for part in parts[:-1]:
            at = at.setdefault(part, {})
            if at is None:
                break
        else:
            if at.get(parts[-1], 0) != {} or parts[-1] not in at:
                at[parts[-1]] = None

    def member(name: str) -> Callable[[Column], Column]:
        return lambda x: F.when(x.isNotNull(), F.concat(F.lit(json.dumps(name) + ":"), F.to_json(x)))

    def made(v: Column, node: dict, above: str) -> tuple[Column, Column]:
        parts, there = [], F.lit(False)
        for name, below in node.items():
            path = f"{above}.{name}" if above else name
            if below is None:
                here = get(v, path).isNotNull()
                parts.append(bound(get(v, path), member(name)))
            else:
                inner, here = made(v, below, path)
                parts.append(F.when(here, F.concat(F.lit(json.dumps(name) + ":"), inner)))
            there = there | here
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), there

    return bound(v, lambda v: F.when(v.isNotNull(), made(v, tree, "")[0]))
