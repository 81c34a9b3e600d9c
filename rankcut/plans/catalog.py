"""Registry of the checked queries: a Spark callable and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankcut.plans.fixtures import Fixture, fixture, table, with_tables
from rankcut.session import ship_package
from rankcut.sources.readers import spread_scan

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, since the two engines add floats in different orders."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def on_fixture(name: str, sql: str | None = None):
    """Register a query over the derived inputs."""

    def wrap(fn: Callable[[Fixture], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return _rounded(fn(fixture(spark, sf_dir)))

        _add(name, run, sql)
        return fn

    return wrap


def on_documents(name: str, sql: str | None = None, costly: bool = False, source: str = "documents"):
    """Register a query over one of the given tables itself; ``costly`` work per row is spread over the cores."""

    def wrap(fn: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            docs = table(spark, sf_dir, source)
            return _rounded(fn(spread_scan(docs) if costly else docs))

        _add(name, run, sql)
        return fn

    return wrap


def _add(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = with_tables(sql)
