"""Query registry: key -> (Spark query, DuckDB oracle SQL or None).

Each query takes (spark, sf_dir), reads the data directory's tables and
returns a DataFrame whose columns are aliased exactly like its oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


def queries() -> dict[str, Query]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load() -> None:
    # Importing the modules registers their queries.
    from quillspark.plans import (  # noqa: F401
        q_eval, q_select, q_text, q_prompts, q_score, q_sinks, q_baseline,
    )
