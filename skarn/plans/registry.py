"""Registered queries of the engine and their SQL equivalents.

Importing the query modules fills the registry; a query is a function of (spark, sf_dir).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("corpus_queries", "grammar_queries", "coupling_queries", "retrieval_queries", "profile_queries", "portrait_queries", "fusion_queries")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"skarn.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def oracle_sql_of(name: str) -> str:
    """The SQL of a query whose module is imported, for use inside another's."""
    return _SQL[name]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the corpus: the terms that everything else is measured by."""
    return queries()["t06_vocabulary"](spark, sf_dir)
