"""What several operators of this folder share: written intermediate tables, numbering, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.tables import numbered as numbered_by
from labspark.tables import written

#: Rows up to which a side of one or two longs or hashes is broadcast (some 64 MB); beyond it, shuffle.
BROADCAST_ROWS = 1_000_000


def join_checked(left: DataFrame, right: DataFrame, on, how: str, right_rows: int) -> DataFrame:
    """Join that broadcasts ``right`` only if it has at most BROADCAST_ROWS (narrow) rows."""
    return left.join(F.broadcast(right) if right_rows <= BROADCAST_ROWS else right, on, how)


def numbered(df: DataFrame, order: list[str], column: str = "_row") -> DataFrame:
    """Add the global row number (from 0) in the order given, nulls first."""
    return numbered_by(df, [F.col(c) for c in order], column)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): one row (node, root) per node that has an edge.

    The root is the smallest node. Each round takes the smallest label among neighbours and then the
    label of the label, so paths shrink by doubling. Joins read written tables on both sides, which
    lets adaptive execution split a hot node; minima are combined before their shuffle.
    """
    one_way = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    both = written(one_way.union(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select(
        "node", F.least("node", "near").alias("root")), "labels")
    while True:
        told = both.join(labels, both["v"] == labels["node"]).select(F.col("u").alias("node"), "root")
        lowest = told.unionByName(labels).groupBy("node").agg(F.min("root").alias("root"))
        lowest = written(lowest, "lowest")
        above = lowest.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        moved = written(
            lowest.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "labels")
        changed = moved.join(labels.withColumnRenamed("root", "before"), "node").where("root <> before")
        if changed.isEmpty():
            return moved
        labels = moved


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold at most that many bytes; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop
