"""All queries of the engine's own operators, and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockdb.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, build: Callable[[SparkSession, str], DataFrame] | None = None, oracle: bool = True) -> None:
    """A query by SQL; with `build`, Spark runs that and the SQL is for DuckDB alone."""
    if name in QUERIES:
        raise ValueError(f"{name} is there already")
    QUERIES[name] = build or (lambda spark, sf_dir: views.run(spark, sf_dir, sql))
    if oracle:
        SQL[name] = views.oracle(sql)


from blockdb.plans import census_queries, fleet_queries, log_queries, metric_queries, store_queries, validation_queries  # noqa: E402, F401
