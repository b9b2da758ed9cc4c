"""Registry of this subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> tuple[dict[str, Callable], dict[str, str]]:
    from evtrail.llm import (  # noqa: F401
        align, bpe, classifier, divergence, exact_dedup, lm_score, packing, quality_rules, run_index, secrets, simhash,
        url_reputation, wrapper,
    )
    return QUERIES, ORACLES
