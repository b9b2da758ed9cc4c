"""Registry of named queries: Spark builder + equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql=None):
    """Register ``fn`` under ``name``; ``sql`` is a string or a zero-arg
    callable returning one (to reuse other queries' SQL)."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql() if callable(sql) else sql)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the catalog modules fills REGISTRY
    from evtrail.plans import (  # noqa: F401
        q_sources, q_cleaning, q_profiling, q_claims, q_pointintime, q_splits,
        q_evaluation, q_models, q_rules, q_ranking, q_retrieval, q_dashboards, q_streaming,
    )
    return REGISTRY
