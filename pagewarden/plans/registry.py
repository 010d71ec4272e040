"""Queries by name, each with the SQL that another engine may check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK
from ..sources.html import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str, deal: bool = False) -> None:
    """deal: rows cost much each, so a small scan is dealt over all cores."""
    for name in names:
        rows = load(spark, sf_dir, name)
        (spread(rows) if deal else rows).createOrReplaceTempView(name)


def query(name: str, oracle: Callable[[], str] | None = None):
    """Registers f(spark, sf_dir)."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sql_query(name: str, *tables: str, deal: bool = False):
    """Registers f(d), SQL for a dialect, as a query and as its oracle."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir, *tables, deal=deal)
            return spark.sql(f(SPARK))

        QUERIES[name], ORACLES[name] = run, lambda: f(DUCK)
        return f

    return add


def oracle_sql() -> dict[str, str]:
    return {name: f() for name, f in ORACLES.items()}
