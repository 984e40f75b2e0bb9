"""Intermediate tables in the folder that driver and executors share, and global row numbers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labspark.session import checkpoint_folder


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, which survives lost executors.

    Spark knows the size of such a table, so it chooses the join with it. The table stays, as results read it; see
    :func:`temporary_tables`. ``schema`` names other types to read the columns as, such as vectors for their structs.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the intermediate tables that were written inside: results must be stored by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[before:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _WRITTEN[before:]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until the table has no such column: helper columns that harm nobody's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def numbered(df: DataFrame, order: Sequence[Column], column: str = "_row") -> DataFrame:
    """Add the global row number (from 0) in the order given, without one task seeing all rows.

    Rows are range-partitioned and sorted; the sizes of the partitions give each its first number.
    The place in the input is the last sort key's tie-break, so only rows that agree in all of
    ``order`` can swap numbers, and many equal rows spread over partitions.
    """
    tie, place, part, size, start = fresh(df, "_tie", "_place", "_part", "_size", "_start")
    spread = df.withColumn(tie, F.monotonically_increasing_id())
    sorted_rows = (
        spread.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
        .withColumn(place, F.monotonically_increasing_id()))
    fixed = written(sorted_rows, "numbered").withColumn(part, F.shiftright(place, 33))
    sizes = fixed.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    starts = sizes.select(part, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(start))
    # one row per partition: broadcast is bounded by the number of partitions
    return fixed.join(F.broadcast(starts), part).withColumn(
        column, F.col(start) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    ).select(*[c for c in df.columns if c != column], column)
