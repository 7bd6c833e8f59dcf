"""All queries of the library, with the SQL that an independent engine runs for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import extras, graphs, retrieval

MODULES = [retrieval, graphs, extras]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse_store_policy(spark, sf_dir)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.sql.items()}
