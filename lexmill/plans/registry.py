"""All queries of the reference's operators, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import cleaning, curation, features, grading, ledger, records, search, streams, tables, tasks

_MODULES = [curation, search, features, grading, ledger, tables, tasks, streams, cleaning, records]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["search_bm25_top10"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
