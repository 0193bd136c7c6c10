"""Durations as written in workflows ("1h30m", "500ms"), in whole microseconds: Spark's resolution."""

from __future__ import annotations

import re
from datetime import timedelta

# Fixed values of the duration format: nanoseconds of each unit.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def micros(value: str | int | float | timedelta) -> int:
    """Microseconds of a duration: a string like ``1h30m``, a ``timedelta`` or a number of seconds."""
    if isinstance(value, timedelta):
        return round(value.total_seconds() * 1_000_000)
    if isinstance(value, (int, float)):
        return round(value * 1_000_000)
    text = value.strip()
    if text == "":
        return 0
    sign = -1 if text[0] == "-" else 1
    body = text.lstrip("+-") if text[0] in "+-" else text
    if body == "0":
        return 0
    at = total = 0
    while at < len(body):
        m = _PART.match(body, at)
        if not m:
            raise ValueError(f'invalid duration "{value}" (want e.g. "30s", "5m", "500ms")')
        whole, _, part = m[1].partition(".")
        unit = UNITS[m[2]]
        total += int(whole or 0) * unit + (int(part) * unit // 10 ** len(part) if part else 0)
        at = m.end()
    if not at:
        raise ValueError(f'invalid duration "{value}" (want e.g. "30s", "5m", "500ms")')
    return sign * (total // 1000)


def interval(us: int) -> str:
    """The interval text that Spark's window functions take."""
    return f"{us} microseconds"


def text(us: int) -> str:
    """Shortest common form, as ``1h30m0s``, ``2.5s`` or ``500ms``."""
    if us == 0:
        return "0s"
    if us < 0:
        return "-" + text(-us)
    if us < 1_000_000:
        return f"{us / 1000:g}ms" if us >= 1000 else f"{us}µs"
    s, rest = divmod(us, 1_000_000)
    h, s = divmod(s, 3600)
    m, s = divmod(s, 60)
    sec = f"{s}" + (f".{rest:06d}".rstrip("0") if rest else "") + "s"
    return f"{h}h{m}m{sec}" if h else f"{m}m{sec}" if m else sec
