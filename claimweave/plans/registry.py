"""All queries over the claim graph, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from claimweave.sources.claimgraph import VIEWS, ClaimGraph

_QUERIES: dict[str, Callable[[ClaimGraph], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: The modules that register queries.
MODULES = ("graph_queries", "read_queries", "ingest_queries", "function_queries", "source_queries", "stream_queries", "page_queries", "resolution_queries")


def query(name: str, sql: str | None = None, plain: bool = False) -> Callable:
    """Registers a function of a ClaimGraph; ``sql`` may use the graph's views, unless it is ``plain``."""

    def add(function: Callable[[ClaimGraph], DataFrame]) -> Callable[[ClaimGraph], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql.replace("--recursive", "WITH RECURSIVE", 1) if plain or sql.startswith("--recursive") else f"WITH {VIEWS}{',' if sql.lstrip().startswith('--more') else ''}\n{sql.replace('--more', '', 1)}"
        return function

    return add


def _load() -> None:
    for module in MODULES:
        import_module(f"claimweave.plans.{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["materialize_edges"](ClaimGraph(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=function: f(ClaimGraph(spark, sf_dir))) for name, function in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
