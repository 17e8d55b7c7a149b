"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadline.plans.bindings import BINDINGS

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

_queries: dict[str, Callable[[Inputs], DataFrame]] = {}
_sql: dict[str, str] = {}


class Inputs:
    """The driver tables of one folder, and the bindings derived from them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def _named(self, text: str) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES if f"{{{name}}}" in text}

    def bound(self, name: str) -> DataFrame:
        """A binding, run by Spark."""
        return self.sql(BINDINGS[name])

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over driver tables named in braces."""
        return self.spark.sql(text, **self._named(text))


def with_bindings(uses: str, body: str) -> str:
    """Body with the named bindings in front of it as common table expressions."""
    parts = []
    for name in uses.split():
        text = BINDINGS[name]
        for table in TABLES:
            text = text.replace(f"{{{table}}}", table)
        text = text.replace("{{", "{").replace("}}", "}")
        parts.append(f"{name} AS ({text})")
    return f"WITH {', '.join(parts)} SELECT * FROM ({body}) AS answer" if parts else body


def query(name: str, body: str | None = None, uses: str = "") -> Callable:
    """Register a query under ``name``; ``body`` is its SQL twin over tables and bindings."""

    def keep(function: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = function
        if body is not None:
            _sql[name] = with_bindings(uses, body)
        return function

    return keep


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(function: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, path: function(Inputs(spark, path))

    return {name: runner(function) for name, function in _queries.items()}


def all_sql() -> dict[str, str]:
    return dict(_sql)
