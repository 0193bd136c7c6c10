"""Checks of a workflow, as tables of rules by block.

A rule looks at one block and gives what is wrong with it, or nothing. ``validate`` applies every rule whose block is
there and reports all faults at once, each with the place it was found at.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

from ..functions.json_paths import OPERATORS as COMPARISONS
from .spec import OPERATORS, Operator, Workflow

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
#: What may stand where (fixed values of the format).
SOURCES, SINKS = ("kafka", "slice", "generator"), ("kafka", "txnKafka", "postgres", "stdout", "blackhole")
WINDOWS, BACKENDS, FUNCTIONS, EMITS, MODES = ("tumbling", "sliding", "session"), ("memory", "pebble"), ("count", "sum"), ("running", "final"), ("insert", "upsert")

Fault = tuple[str, str]
#: From a block, the paths below it and what is wrong there.
Rule = Callable[[Any], Iterator[Fault]]


class ValidationError(ValueError):
    def __init__(self, faults: list[Fault]) -> None:
        self.faults = faults
        super().__init__("; ".join(f"{p}: {m}" for p, m in faults))


# -- kinds of rules --------------------------------------------------------------------------------------------------


def rule(field: str, wrong: Callable[[Any], Any], message: str, when: Callable[[Any], Any] = lambda _: True) -> Rule:
    """A fault at ``field`` where ``wrong`` holds of the block; the message may name the field's value."""

    def check(block: Any) -> Iterator[Fault]:
        if when(block) and wrong(block):
            yield field, message.format(value=_at(block, field))

    return check


def _at(block: Any, field: str) -> Any:
    for name in field.split("."):
        block = getattr(block, name, None)
    return block


def given(field: str, when: Callable[[Any], Any] = lambda _: True) -> Rule:
    return rule(field, lambda b: not _at(b, field), f"{field} is missing or empty", when)


def among(field: str, choices: tuple[str, ...], optional: bool = False) -> Rule:
    def wrong(block: Any) -> bool:
        value = _at(block, field)
        return value not in choices and not (optional and not value)

    return rule(field, wrong, "{value!r} is none of " + ", ".join(choices))


def counted(field: str) -> Rule:
    return rule(field, lambda b: _at(b, field) < 0, "{value} is below zero")


def lasting(field: str, when: Callable[[Any], Any] = lambda _: True) -> Rule:
    return rule(field, lambda b: _at(b, field).us <= 0, "a duration above zero is needed", when)


def writable(field: str, when: Callable[[Any], Any] = lambda _: True) -> Rule:
    def check(block: Any) -> Iterator[Fault]:
        if (path := _at(block, field)) and when(block):
            try:
                os.makedirs(path, exist_ok=True)
            except OSError as e:
                yield field, f"can't make the folder {path!r} ({e})"

    return check


def mapped(field: str) -> Rule:
    def check(block: Any) -> Iterator[Fault]:
        there = set(block.mapping.values())
        yield from ((field, f"column {name!r} isn't a target of the mapping") for name in getattr(block, field) if name not in there)

    return check


# -- rules by block --------------------------------------------------------------------------------------------------

OPERATOR_RULES: dict[str, tuple[Rule, ...]] = {
    "filter": (given("field"), among("operator", COMPARISONS)),
    "selectFields": (given("fields"),),
    "renameFields": (given("renames"),),
    "setFields": (given("sets"),),
    "keyBy": (given("field"), counted("partitions")),
    "reduce": (among("function", FUNCTIONS), given("field", lambda b: b.function == "sum"), among("emit", EMITS, optional=True)),
    "window": (
        among("type", WINDOWS),
        lasting("size", lambda b: b.type in ("tumbling", "sliding")),
        lasting("slide", lambda b: b.type == "sliding"),
        rule("slide", lambda b: b.slide.us > b.size.us > 0, "a slide longer than the size leaves gaps", lambda b: b.type == "sliding"),
        lasting("gap", lambda b: b.type == "session"),
    ),
    "map": (given("ref"),),
    "flatMap": (given("ref"),),
    "process": (given("ref"),),
}
SOURCE_RULES: dict[str, tuple[Rule, ...]] = {
    "kafka": (
        given("brokers"),
        rule("topic", lambda b: not b.topic and not b.topics, "neither topic nor topics is given"),
        rule("parallel", lambda b: b.parallel and b.groupID, "can't go together with groupID"),
        rule("watermark.maxOutOfOrderness", lambda b: b.watermark.maxOutOfOrderness.us <= 0, "a duration above zero is needed", lambda b: b.watermark),
    ),
}
SINK_RULES: dict[str, tuple[Rule, ...]] = {
    "kafka": (given("brokers"), given("topic")),
    "txnKafka": (given("brokers"), given("topic"), given("transactionalID")),
    "postgres": (
        given("dsn"),
        given("table"),
        given("mapping"),
        among("mode", MODES, optional=True),
        rule("mode", lambda b: b.conflictColumns or b.updateColumns, "conflictColumns and updateColumns belong to upsert", lambda b: b.mode in ("", "insert")),
        given("conflictColumns", lambda b: b.mode == "upsert"),
        mapped("conflictColumns"),
        mapped("updateColumns"),
    ),
}
ENV_RULES: dict[str, tuple[Rule, ...]] = {
    "": (counted("bufferSize"),),
    "checkpointing": (lasting("interval"), writable("dir")),
    "state": (among("backend", BACKENDS), writable("dir", lambda b: b.backend == "pebble")),
}
HEAD_RULES: tuple[Rule, ...] = (
    rule("version", lambda w: w.version not in ("", "1"), "{value!r} isn't known here; leave it out or write \"1\""),
    given("name"),
    rule("name", lambda w: w.name and not NAME.fullmatch(w.name), "{value!r} has other signs than letters, digits, dots, dashes and underscores"),
    among("source.type", SOURCES),
    among("sink.type", SINKS),
)


def applied(rules: tuple[Rule, ...], block: Any, path: str) -> Iterator[Fault]:
    return ((f"{path}.{p}" if path else p, m) for r in rules for p, m in r(block))


# -- the whole -------------------------------------------------------------------------------------------------------


def validate(wf: Workflow) -> None:
    """Raises a ValidationError with every fault there is."""
    if faults := list(chain(applied(HEAD_RULES, wf, ""), _environment(wf), _ends(wf), _pipeline(wf), _once(wf))):
        raise ValidationError(faults)


def place(i: int, op: Operator) -> str:
    return f'pipeline[{i}] "{op.id}"' if op.id else f"pipeline[{i}]"


def _environment(wf: Workflow) -> Iterator[Fault]:
    for name, rules in ENV_RULES.items():
        block = getattr(wf.env, name, None) if name else wf.env
        if block is not None:
            yield from applied(rules, block, f"env.{name}" if name else "env")


def _ends(wf: Workflow) -> Iterator[Fault]:
    for what, end, tables in (("source", wf.source, SOURCE_RULES), ("sink", wf.sink, SINK_RULES)):
        if end.type in tables:
            block = getattr(end, end.type)
            yield from applied(tables[end.type], block, f"{what}.{end.type}") if block is not None else [(f"{what}.{end.type}", f"the block {end.type} is missing")]


def _pipeline(wf: Workflow) -> Iterator[Fault]:
    first: dict[str, int] = {}
    key_at = reduce_at = -1
    for i, op in enumerate(wf.pipeline):
        at, there = place(i, op), [n for n in OPERATORS if getattr(op, n) is not None]
        if first.setdefault(op.id, i) != i or not op.id:
            yield at, f"its id is that of pipeline[{first[op.id]}]" if op.id else "it has no id"
        if op.type not in OPERATORS:
            yield at, f"{op.type!r} is no type of operator"
        elif there != [op.type]:
            yield at, f"a block {op.type} and no other is needed; there: {', '.join(there) or 'none'}"
        if there:
            yield from applied(OPERATOR_RULES[there[0]], getattr(op, there[0]), f"{at}.{there[0]}")
        if op.type == "keyBy":
            key_at = i
        elif op.type in ("reduce", "window") and key_at < 0:
            yield at, f"no keyBy stands before this {op.type}"
        if op.type == "window" and reduce_at > key_at:
            yield at, f"it comes after the reduce of the same key (pipeline[{reduce_at}])"
        reduce_at = i if op.type == "reduce" else reduce_at


#: What exactly once takes: its place, whether a workflow has it, and what to write.
ONCE: tuple[tuple[str, Callable[[Workflow], bool], str], ...] = (
    ("source", lambda wf: wf.source.type == "kafka" and wf.source.kafka is not None and wf.source.kafka.exactlyOnce, "a kafka source with exactlyOnce: true"),
    ("sink", lambda wf: wf.sink.type == "txnKafka", "a txnKafka sink"),
    ("env.checkpointing", lambda wf: wf.env is not None and wf.env.checkpointing is not None and wf.env.checkpointing.interval.us > 0, "checkpointing with an interval above zero"),
)


def _once(wf: Workflow) -> Iterator[Fault]:
    """One end that asks for exactly once asks it of all three parts."""
    has = [test(wf) for _, test, _ in ONCE]
    if any(has[:2]):
        yield from ((at, f"exactly-once takes {what}") for (at, _, what), there in zip(ONCE, has, strict=True) if not there)


def guarantee(wf: Workflow) -> str:
    """What the workflow asks of delivery: exactly-once, at-least-once or at-most-once."""
    has = [test(wf) for _, test, _ in ONCE]
    return "exactly-once" if all(has) else "at-least-once" if has[2] else "at-most-once"
