"""Registry of catalogue queries: name -> (Spark plan builder, oracle SQL).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
given tables. The oracle SQL is the same computation in DuckDB SQL over views
of the same Parquet tables (omitted for iterative or model-fitting queries).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that its ``register`` calls run."""
    from wardflow.plans import (  # noqa: F401
        q_features,
        q_files,
        q_metrics,
        q_models,
        q_reports,
        q_sampling,
        q_survival,
        q_tables,
        q_text,
        q_timeline,
    )
