"""Positions, ranks and quantiles that stay distributed under skew.

A window or an exact percentile puts a whole group into one task.  Positions first ask which
groups are too large for that (one aggregate over the key columns) and number those by a global
sort.  Ranks count values first, range-partition the distinct ones and add the rows of earlier partitions.
Quantiles of whole columns are selected within bands that a sketch gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labspark.tables import numbered, written

# Rows of one group that a single task may sort.
MAX_GROUP_ROWS = 5_000_000
_SLICE = "__slice"


def hot_groups(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Keys of the groups of more than ``max_rows`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(
        F.col("__rows") > max_rows).select(*keys)


def _same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return condition


def _offsets(counted: DataFrame, keys: Sequence[str], rows: Column) -> DataFrame:
    """Rows of the same group in earlier slices; one small row per (group, slice)."""
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.groupBy(*keys, _SLICE).agg(rows.alias("__n"))
        .select(*keys, _SLICE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos",
                   max_group_rows: int = MAX_GROUP_ROWS, size: str | None = None) -> DataFrame:
    """0-based position of every row in its group, in ``order`` (nulls last; any orderable types).

    ``size`` names a column for the number of rows of the group, which costs no further shuffle. The last order column should make the order total.  Groups of more than ``max_group_rows``
    rows, however many there are, are numbered in one global order of (keys, order), spread over
    tasks by range; a row's position is its number less the first number of its group.
    """
    in_order = [F.col(c).asc_nulls_last() for c in order]
    window = Window.partitionBy(*keys).orderBy(*in_order)

    def in_window(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn(out, (F.row_number().over(window) - 1).cast("long"))
        return placed.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if size else placed

    hot = hot_groups(df, keys, max_group_rows)
    if hot.isEmpty():
        return in_window(df)
    same = _same_keys("l", "r", keys)
    cool = df.alias("l").join(hot.alias("r"), same, "left_anti")
    rows = numbered(df.alias("l").join(hot.alias("r"), same, "left_semi"),
                    [*[F.col(k) for k in keys], *in_order], "__number")
    starts = rows.groupBy(*keys).agg(F.min("__number").alias("__start"), F.count(F.lit(1)).alias("__size"))
    placed = rows.alias("l").join(starts.alias("r"), same).select(
        *[f"l.{c}" for c in df.columns], (F.col("__number") - F.col("__start")).alias(out),
        *([F.col("__size").alias(size)] if size else []))
    return in_window(cool).unionByName(placed)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values with their number of copies ``n``."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n"))


def cumulative_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values (of any orderable type) with ``n`` copies and ``before`` = rows with a smaller value.

    Copies are counted first, so what is ordered are the distinct values of each group.
    """
    return cumulative_sums(value_counts(df, by, value), by, value, "n")


def cumulative_sums(counts: DataFrame, by: Sequence[str], value: str, weight: str,
                    tasks: int | None = None) -> DataFrame:
    """Add ``before``: the sum of ``weight`` over rows of the same group with a smaller value.

    Values are distinct within a group and of any orderable type. Rows are range-partitioned by (``by``, value) and
    written, so each partition is one stretch of the order; sums run within a stretch of a group, and
    what the group has in earlier stretches is added. No task sees more than one stretch, whatever the group. ``by``
    names at least one column, which may be the same everywhere. ``tasks`` sets the number of stretches, else the session does.
    """
    ordered = counts.repartitionByRange(*([tasks] if tasks else []), *by, value)
    ranged = written(ordered.withColumn(_SLICE, F.spark_partition_id()), "ranged")
    if tasks:
        ranged = ranged.repartition(tasks, *by, _SLICE)
    inside = Window.partitionBy(*by, _SLICE).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and stretch: at most as many as groups and partitions together
    offsets = _offsets(ranged, by, F.sum(weight))
    return (
        ranged.withColumn("__in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).alias("l")
        .join(offsets.alias("r"), _same_keys("l", "r", [*by, _SLICE]))
        .select(*[F.col(f"l.{c}") for c in counts.columns],
                (F.col("__in") + F.col("__before")).alias("before"))
    )


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their tie-averaged 1-based rank."""
    return cumulative_counts(df, by, value).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)


#: Accuracy of the sketch that bounds quantiles, and by how many times its error a bound is moved outwards.
SKETCH = 10_000
_MARGIN = 3


def summary(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row: a struct per column with n, mean, std, min, max and bounds of its quantiles (low, high per prob)."""
    found = [F.count(F.lit(1)).alias("rows")]
    wanted = [min(max(p + side * _MARGIN / SKETCH, 0.0), 1.0) for p in probs for side in (-1, 1)]
    for c in columns:
        v = F.col(c).cast("double")
        sketched = F.percentile_approx(v, wanted, SKETCH)
        bounds = [(F.min(v) if w == 0 else F.max(v) if w == 1 else sketched[i]) for i, w in enumerate(wanted)]
        found.append(F.struct(
            F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            F.max(v).alias("max"), F.array(*bounds).alias("bounds")).alias(c))
    return df.agg(*found)


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     facts: DataFrame | None = None) -> DataFrame:
    """Linearly interpolated exact quantiles q0, q1, ... of numeric columns: one row per column, ``variable``.

    Selection in two reads and no job before the result is asked for: a sketch gives each quantile a band of values
    that surely holds it; then values in bands are counted one by one and those between bands all
    together, for all columns at once. The band of a quantile holds about 6 rows in 10,000. Nulls are left out; a
    column without values has null quantiles.
    """
    facts = summary(df, columns, probs) if facts is None else facts
    one = facts.select(F.struct(*[F.col(c)["bounds"].alias(c) for c in columns])).scalar()
    bounded = df.select(*[F.col(c).cast("double").alias(c) for c in columns], one.alias("__bounds"))
    parts = []
    for c in columns:
        v, bounds = F.col(c), F.col("__bounds")[c]
        region, in_band = F.lit(0), F.lit(False)
        for i in range(len(probs)):
            low, high = bounds[2 * i], bounds[2 * i + 1]
            region = region + (v >= low).cast("int") + (v > high).cast("int")
            in_band = in_band | ((v >= low) & (v <= high))
        parts.append(F.struct(F.lit(c).alias("variable"), v.isNotNull().alias("is_value"),
                              region.alias("region"), F.when(in_band, v).alias("value")))
    counts = bounded.select(F.explode(F.array(*parts)).alias("s")).select("s.*").filter("is_value").groupBy(
        "variable", "region", "value").agg(F.count(F.lit(1)).alias("n"))
    nothing = df.sparkSession.range(1).select(  # so that every column has a row
        F.explode(F.array(*[F.lit(c) for c in columns])).alias("variable"), F.lit(-1).alias("region"),
        F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("n"))
    group = Window.partitionBy("variable")
    ranked = counts.unionByName(nothing).select(
        "*", F.coalesce(F.sum("n").over(group.orderBy("region", "value").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(group).alias("__total"))
    return ranked.groupBy("variable").agg(*_interpolated(probs, "value"))


def _interpolated(probs: Sequence[float], value: str) -> list[Column]:
    """Aggregates over rows with before, n and __total: the value at each share of the way."""
    aggregates = []
    for i, p in enumerate(probs):
        at = (F.col("__total") - 1) * F.lit(float(p))

        def covering(position: Column) -> Column:
            hit = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
            return F.max(F.when(hit, F.col(value)))

        low, high = covering(F.floor(at)), covering(F.ceil(at))
        share = F.max(at - F.floor(at))
        # equal ends need no arithmetic, which would fail for infinite ones
        aggregates.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(f"q{i}"))
    return aggregates


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles q0, q1, ... per group, without one task holding a group.

    A quantile lies between two order positions; the distinct values covering those positions
    are found by a range filter on the cumulative counts.
    """
    cumulative = cumulative_counts(df, by, value)
    totals = F.broadcast(  # one row per group: the rows up to and with its last value
        cumulative.groupBy(*by).agg(F.max(F.col("before") + F.col("n")).alias("__total")))
    ranked = (
        cumulative.alias("l").join(totals.alias("r"), _same_keys("l", "r", by))
        .select("l.*", "__total")
    )
    return ranked.groupBy(*by).agg(*_interpolated(probs, value))
