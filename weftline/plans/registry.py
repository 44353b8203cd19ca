"""Where queries and their SQL are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tables of long texts: where such a table is so small that it is one piece, its rows are spread over the cores.
WIDE = frozenset(["pages", "documents"])


def query(sql: str | None = None):
    """Register a function under its name, with DuckDB SQL for the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in WIDE:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """Literal rows, written as SQL that both engines read."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")
