"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import bindings as b

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WEEK = "2024-W05"


def query(sql: str | None = None, bound: bool = True):
    """Registers a query with its SQL; bound: the SQL begins with the views of the domain."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (b.SQL if bound else "") + sql
        return f

    return register


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_ward(spark: SparkSession, d: str, documents: DataFrame | None = None) -> DataFrame:
    s = b.sources(spark, d).select(F.col("id").alias("_s"), "ward_number")
    return b.newsletters(spark, d, documents).join(F.broadcast(s), F.col("source_id") == F.col("_s"), "left").drop("_s")
