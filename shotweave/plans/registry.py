"""Registry of named queries and their DuckDB oracle SQL.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` that reads the given
parquet tables; its oracle (when SQL can express it) is plain SQL over the
same tables, written from the operator's specification, not from its code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, oracle: str | None = None, headline: bool = False):
    """Decorator: add a query under ``name`` with an optional oracle SQL string."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        if headline:
            HEADLINE.append(name)
        return fn

    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    from shotweave.plans import (  # noqa: F401
        catalog_plans,
        coverage_plans,
        evaluate_plans,
        linking_plans,
        masked_plans,
        portfolio_plans,
        prompting_plans,
        retrieval_plans,
        source_plans,
        text_plans,
        whitening_plans,
    )
