"""Per-series summaries, slopes, directions and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.values import (
    change_rate, direction_of_change, direction_of_slope, range_high, range_low)
from labspark.operators.ordering import MAX_GROUP_ROWS, with_positions

_LAST_MICROS = 2 ** 63 - 1


def _time_order(time: str, tie: str | None) -> Column:
    """Sortable time with missing times last; a plain long keeps the aggregation hash-based."""
    micros = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(_LAST_MICROS))
    return F.struct(micros.alias("t"), F.col(tie).alias("o")) if tie else micros


def trajectory_features(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                        max_group_rows: int = MAX_GROUP_ROWS, carry: Sequence[str] = (),
                        extra: Sequence[Column] = ()) -> DataFrame:
    """Baseline, latest, extremes, mean, sample std, slope over position and change rate.

    Series of fewer than two points are dropped.  ``extra`` are further aggregates of the points,
    over the ``carry`` columns.
    """
    points = with_positions(
        df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, *order, value, *carry])),
        keys, order, "pos", max_group_rows)
    v = F.col(value)
    return (
        points.groupBy(*keys)
        .agg(F.count(v).alias("n_points"),
             F.min_by(v, "pos").alias("baseline_value"),
             F.max_by(v, "pos").alias("latest_value"),
             F.max(v).alias("max_value"), F.min(v).alias("min_value"),
             F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
             F.regr_slope(v, F.col("pos").cast("double")).alias("slope"), *extra)
        .filter(F.col("n_points") >= 2)
        .withColumn("change_rate", change_rate(F.col("baseline_value"), F.col("latest_value")))
    )


def trend_summary(df: DataFrame, keys: Sequence[str], value: str, time: str,
                  tie: str | None = None) -> DataFrame:
    """First, last, max, min, change rate and up/down/stable direction of each series.

    Groups without any value stay with direction 'unknown'.  The ordered points themselves are
    rows of :func:`labspark.operators.ordering.with_positions`, not one array per series.
    """
    v = F.col(value)
    order = F.when(v.isNotNull(), _time_order(time, tie))
    rate = change_rate(F.col("first_value"), F.col("last_value"))
    return (
        df.groupBy(*keys)
        .agg(F.min_by(v, order).alias("first_value"), F.max_by(v, order).alias("last_value"),
             F.max(v).alias("max_value"), F.min(v).alias("min_value"),
             F.count(v).alias("n_points"))
        .withColumn("change_rate", rate)
        .withColumn("trend_direction",
                    F.when(F.col("n_points") == 0, "unknown")
                    .otherwise(direction_of_change(F.col("change_rate"))))
    )


def slopes_per_day(df: DataFrame, keys: Sequence[str], value: str, time: str,
                   tie: str | None = None) -> DataFrame:
    """(last - first) / whole days between, at least one day; plain difference without times."""
    rows = df.filter(F.col(value).isNotNull())
    order, v, t = _time_order(time, tie), F.col(value), F.col(time).cast("timestamp")
    days = F.greatest(
        F.floor((F.unix_micros("__t1") - F.unix_micros("__t0")) / F.lit(86_400_000_000)),
        F.lit(1))
    gain = F.col("__v1") - F.col("__v0")
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(v, order).alias("__v0"), F.max_by(v, order).alias("__v1"),
             F.min(t).alias("__t0"),
             # the last row has a time only when no time is missing
             F.when(F.count(t) == F.count(v), F.max(t)).alias("__t1"),
             F.count(v).alias("n_points"))
        .filter(F.col("n_points") >= 2)
        .select(*keys, "n_points",
                F.when(F.col("__t0").isNotNull() & F.col("__t1").isNotNull(), gain / days)
                .otherwise(gain).alias("slope_per_day"))
    )


def latest_values(df: DataFrame, keys: Sequence[str], value: str, time: str,
                  tie: str | None = None) -> DataFrame:
    """Last value per series; a row without a time counts as latest."""
    return (
        df.filter(F.col(value).isNotNull()).groupBy(*keys)
        .agg(F.max_by(value, _time_order(time, tie)).alias("latest_value"))
    )


def marker_summaries(df: DataFrame, case: str, marker: str, value: str, time: str,
                     tie: str | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per (case, marker): v0, v1, t0, t1, n, mean of the rows with a value.

    ``extra`` adds aggregates over all rows of the pair, so that one shuffle serves them too.
    """
    v, t = F.col(value), F.when(F.col(value).isNotNull(), F.col(time).cast("timestamp"))
    order = F.when(v.isNotNull(), _time_order(time, tie))
    return df.filter(F.col(marker).isNotNull()).groupBy(case, marker).agg(
        F.min_by(v, order).alias("v0"), F.max_by(v, order).alias("v1"),
        F.min(t).alias("t0"),
        # the last row has a time only when no time is missing
        F.when(F.count(t) == F.count(v), F.max(t)).alias("t1"),
        F.count(v).alias("n"), F.avg(v).alias("mean"), *extra)


def feature_aggregates(marker: str, slope_markers: Sequence[str], glucose: str = "GLU",
                       creatinine: str = "Creatinine", tumour: str = "CEA") -> list[Column]:
    """Aggregates over the marker summaries of a case: a pivot with an explicit marker list."""
    days = F.greatest(
        F.floor((F.unix_micros("t1") - F.unix_micros("t0")) / F.lit(86_400_000_000)), F.lit(1))
    gain = F.col("v1") - F.col("v0")
    slope = F.when(
        F.col("n") >= 2,
        F.when(F.col("t0").isNotNull() & F.col("t1").isNotNull(), gain / days).otherwise(gain))

    def of(name: str, column: Column) -> Column:
        return F.max(F.when(F.col(marker) == name, column))

    return [
        of(glucose, F.col("v1")).alias(f"{glucose}_latest"),
        of(glucose, F.col("mean")).alias(f"{glucose}_mean"),
        of(creatinine, F.col("mean")).alias(f"{creatinine}_mean"),
        of(tumour, F.col("v1")).alias(f"{tumour}_level"),
        *[of(m, slope).alias(f"{m}_slope") for m in slope_markers]]


def clinical_features(df: DataFrame, case: str, marker: str, value: str, time: str,
                      slope_markers: Sequence[str], tie: str | None = None,
                      **names: str) -> DataFrame:
    """One row per case: latest and mean of the named markers and a slope per listed marker."""
    rows = df.filter(F.col(value).isNotNull())
    return marker_summaries(rows, case, marker, value, time, tie).groupBy(case).agg(
        *feature_aggregates(marker, slope_markers, **names))


def abnormal_points(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                    low: str = "reference_low", high: str = "reference_high",
                    max_group_rows: int = MAX_GROUP_ROWS, size: str | None = None) -> DataFrame:
    """Every point with its position and an out-of-range mark; ``size`` names a column for the number of points."""
    points = with_positions(
        df.filter(F.col(value).isNotNull()), keys, order, "pos", max_group_rows, size)
    outside = (F.col(value) < F.col(low)) | (F.col(value) > F.col(high))
    return points.withColumn("is_abnormal", F.coalesce(outside, F.lit(False)))


def half_split_trend(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                     low: str = "reference_low", high: str = "reference_high",
                     spread: str | None = None,
                     max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Direction from the mean of the later half against the earlier half.

    The threshold is a tenth of ``spread`` (a column; the series' sample std where it is null or
    not given).  Two or more abnormal points on both sides of the range make the series 'fluctuating'.
    """
    halved = abnormal_points(df, keys, value, order, low, high, max_group_rows, "n_points")
    later = F.col("pos") >= F.floor(F.col("n_points") / 2)
    v = F.col(value)
    given = F.max(spread) if spread else F.lit(None).cast("double")
    width = F.coalesce(given, F.stddev_samp(v), F.lit(0.0))
    summary = halved.groupBy(*keys).agg(
        F.max("n_points").alias("n_points"),
        F.avg(F.when(~later, v)).alias("first_half_mean"),
        F.avg(F.when(later, v)).alias("second_half_mean"),
        F.count_if(v > F.col(high)).alias("n_above"),
        F.count_if(v < F.col(low)).alias("n_below"),
        width.alias("__spread"))
    gap = F.col("second_half_mean") - F.col("first_half_mean")
    return summary.withColumn(
        "trend_direction",
        F.when((F.col("n_above") > 0) & (F.col("n_below") > 0), "fluctuating")
        .when(F.col("n_points") < 2, "stable")
        .when(gap > F.col("__spread") * 0.1, "increasing")
        .when(gap < -F.col("__spread") * 0.1, "decreasing")
        .otherwise("stable")).drop("__spread")


def forecast(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
             steps: int = 2, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Next ``steps`` points of each series by a line, or a parabola that fits clearly better.

    The fit needs no second pass: with x = 0..n-1 the sums of v, x*v and x^2*v give the
    coefficients on the discrete orthogonal polynomials 1, x - m and (x - m)^2 - (n^2 - 1)/12.
    """
    points = with_positions(
        df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, *order, value])),
        keys, order, "pos", max_group_rows)
    v, x = F.col(value).cast("double"), F.col("pos").cast("double")
    sums = points.groupBy(*keys).agg(
        F.count(v).cast("double").alias("n"), F.sum(v).alias("s0"), F.avg(v).alias("mean"),
        F.var_pop(v).alias("var"), F.sum(x * v).alias("s1"), F.sum(x * x * v).alias("s2"),
        F.max_by(v, "pos").alias("latest_value"))
    n, mid = F.col("n"), (F.col("n") - 1) / 2
    p1 = F.col("s1") - mid * F.col("s0")
    p2 = (F.col("s2") - 2 * mid * F.col("s1") + mid * mid * F.col("s0")
          - (n * n - 1) / 12 * F.col("s0"))
    fitted = (
        sums.filter(n >= 2)
        .withColumn("q1", n * (n * n - 1) / 12)
        .withColumn("q2", n * (n * n - 1) * (n * n - 4) / 180)
        .withColumn("slope", p1 / F.col("q1"))
        .withColumn("p2", p2)
        .withColumn("rss1", F.greatest(
            n * F.col("var") - p1 * p1 / F.col("q1"), F.lit(0.0)))
        # a line through all points leaves only rounding noise, never a reason for a parabola
        .withColumn("rss1", F.when(
            F.col("rss1") > 1e-12 * n * F.col("var"), F.col("rss1")).otherwise(0.0))
        .withColumn("curved", (n >= 4) & (
            F.col("rss1") - F.col("p2") * F.col("p2") / F.nullif(F.col("q2"), F.lit(0.0))
            < 0.8 * F.col("rss1")))
        .withColumn("bend", F.when(F.col("curved"), F.col("p2") / F.col("q2")).otherwise(0.0))
        .withColumn("bend", F.coalesce("bend", F.lit(0.0)))
    )

    def at(step: int) -> Column:
        offset = n + F.lit(step - 1) - mid
        return (F.col("mean") + F.col("slope") * offset
                + F.col("bend") * (offset * offset - (n * n - 1) / 12))

    predicted = fitted.withColumn("forecast", F.array(*[at(i) for i in range(1, steps + 1)]))
    rising = F.col("trend_direction") == "increasing"
    high = (F.col("latest_value") > F.col("mean") * 1.1) | (
        F.array_max(F.transform("forecast", lambda f: F.round(f, 2))) > F.col("latest_value"))
    return (
        predicted.withColumn("trend_direction", direction_of_slope(F.col("slope")))
        .withColumn("risk_alert", rising & high)
        .select(*keys, n.cast("long").alias("n_points"), "slope",
                F.coalesce("curved", F.lit(False)).alias("is_quadratic"), "forecast",
                "trend_direction", "risk_alert")
    )


def forecast_rows(forecasts: DataFrame) -> DataFrame:
    """One row per forecast step."""
    other = [c for c in forecasts.columns if c != "forecast"]
    return forecasts.select(
        *other, F.posexplode("forecast").alias("__i", "forecast_value")).withColumn(
        "step", F.col("__i") + 1).drop("__i")


def with_text_range(dictionary: DataFrame) -> DataFrame:
    """Numeric bounds from the dictionary's 'low-high' text."""
    return dictionary.withColumns({
        "reference_low": range_low(F.col("reference_range")),
        "reference_high": range_high(F.col("reference_range"))})
