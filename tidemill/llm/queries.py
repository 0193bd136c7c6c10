"""Queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html, lines, lm, minhash, mixing, pivots, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.query,
    "op2_html": html.query,
    "op3_toxicity": toxicity.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_minhash": minhash.query,
    "op6_sharding": sharding.query,
    "op7_pivots": pivots.query,
    "op8_lines": lines.query,
    "op9_lm": lm.query,
    "op10_mixing": mixing.query,
}
ORACLES: dict[str, str] = {"op4_exact_dedup": exact_dedup.SQL, "op7_pivots": pivots.SQL}
