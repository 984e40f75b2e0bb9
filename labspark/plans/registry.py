"""Where registered queries and their SQL counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query over the tables of a folder, with equivalent SQL where there is one."""
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table out before heavy per-row work if it has fewer splits than cores.

    One row group is one task, however large.  Only the plan is asked, and a table of many splits
    is left alone, so a large one never pays for a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; the operators themselves do not round."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def values_sql(rows: list, columns: str) -> str:
    """A VALUES list for the SQL side, made from the same rows as the lookup table."""
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(literal(x) for x in v) + "]"
        return "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({columns})"
