"""What the plans share."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def read(spark: SparkSession, sf_dir: str, *tables: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables]


def plan(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that it must equal."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put
