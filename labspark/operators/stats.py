"""Descriptive statistics, group tests and correlation matrices."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.functions.tails import f_pvalue, t_pvalue, z_pvalue
from labspark.operators.ordering import column_quantiles, cumulative_sums, summary
from labspark.session import shuffle_partitions
from labspark.tables import written

QUARTILES = (0.25, 0.5, 0.75)
SIGNIFICANT = 0.05
#: Rows that a task of a rank correlation is meant to hold, and rows of one value that may go to one task.
TASK_ROWS = 500_000
FREQUENT = 50_000


def describe(df: DataFrame, variables: Sequence[str], exact: bool = True) -> DataFrame:
    """One row per variable: n, mean, sample std, quartiles, min, max and missing rate.

    One read gives moments and a sketch; exact quartiles take a second one, which counts the values in
    the sketch's bands. ``exact=False`` takes the sketch's own quartiles.
    """
    if not exact:
        aggregates = [F.count(F.lit(1)).alias("rows")]
        for v in variables:
            c = F.col(v).cast("double")
            q = F.percentile_approx(c, list(QUARTILES), 10_000)
            aggregates.append(F.struct(
                F.lit(v).alias("variable"), F.count(c).alias("n"), F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
                *[q[i].alias(f"q{i}") for i in range(3)]).alias(v))
        found = df.agg(*aggregates).select("rows", F.explode(F.array(*[F.col(v) for v in variables])).alias("s"))
        moments = found.select("rows", "s.*")
    else:
        facts = summary(df, variables, QUARTILES)
        both = facts.select(F.struct("rows", F.create_map(*[part for v in variables for part in (
            F.lit(v), F.col(v).dropFields("bounds"))]).alias("of"))).scalar()
        moments = column_quantiles(df, variables, QUARTILES, facts).withColumn("s", both).select(
            "variable", "q0", "q1", "q2", "s.rows", F.col("s.of")[F.col("variable")].alias("m")).select("*", "m.*")
    return moments.select(
        "variable", F.col("n").alias("sample_count"), "mean", "std",
        F.col("q1").alias("median"), F.col("q0").alias("quartile_1"),
        F.col("q2").alias("quartile_3"), "min", "max",
        F.when(F.col("rows") == 0, F.lit(1.0))
        .otherwise(1 - F.col("n") / F.col("rows")).alias("missing_rate"))


def welch_t_test(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """Two-sample t-test with unequal variances, one row."""
    g, v = F.col(group), F.col(value).cast("double")
    of_a, of_b = F.when(g == F.lit(a), v), F.when(g == F.lit(b), v)
    moments = df.filter(g.isin([a, b])).agg(
        F.count(of_a).alias("n_a"), F.count(of_b).alias("n_b"),
        F.avg(of_a).alias("mean_a"), F.avg(of_b).alias("mean_b"),
        F.var_samp(of_a).alias("var_a"), F.var_samp(of_b).alias("var_b"))
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    return (
        moments
        .withColumn("statistic", (F.col("mean_a") - F.col("mean_b")) / F.sqrt(ea + eb))
        .withColumn("df", (ea + eb) * (ea + eb) / (
            ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1)))
        .withColumn("p_value", t_pvalue("statistic", "df"))
        .withColumn("is_significant", F.col("p_value") < SIGNIFICANT)
        .drop("var_a", "var_b")
    )


def mann_whitney(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """U of group a, with the tie-corrected normal approximation and continuity correction.

    Rank sums come from distinct values and their counts per group; rows are never sorted.
    """
    g = F.col(group)
    rows = df.filter(g.isin([a, b]) & F.col(value).isNotNull()).select(
        F.col(value).cast("double").alias("v"), (g == F.lit(a)).cast("int").alias("is_a"))
    # one read serves the ranks and the counts of a
    per_value = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("is_a").alias("n_in_a"))
    ranks = cumulative_sums(per_value.withColumn("all", F.lit(1)), ["all"], "v", "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    sums = ranks.agg(
        F.sum(F.col("rank") * F.col("n_in_a")).alias("rank_sum"),
        F.sum("n_in_a").cast("double").alias("n1"), F.sum("n").cast("double").alias("total"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n1, total = F.col("n1"), F.col("total")
    n2 = total - n1
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread
    return (
        sums.select(
            n1.cast("long").alias("n_a"), n2.cast("long").alias("n_b"),
            u.alias("statistic"), z.alias("z"))
        .withColumn("p_value", F.least(z_pvalue("z"), F.lit(1.0)))
        .withColumn("is_significant", F.col("p_value") < SIGNIFICANT)
    )


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F test over all groups, one row."""
    per_group = (
        df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group)
        .agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"),
             F.var_pop(value).alias("var"))
    )
    # the grand mean first: squares of the means themselves would cancel far from zero
    grand = per_group.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    gap = F.col("m") - F.col("grand")
    totals = per_group.crossJoin(F.broadcast(grand)).agg(  # one row
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("total"),
        F.sum(F.col("n") * gap * gap).alias("ss_between"),
        F.sum(F.col("n") * F.col("var")).alias("ss_within"))
    return (
        totals
        .withColumn("df_between", F.col("k") - 1)
        .withColumn("df_within", F.col("total") - F.col("k"))
        .withColumn("statistic", (F.col("ss_between") / F.col("df_between"))
                    / (F.col("ss_within") / F.col("df_within")))
        .withColumn("p_value", f_pvalue("statistic", "df_between", "df_within"))
        .withColumn("is_significant", F.col("p_value") < SIGNIFICANT)
        .select("ss_within", "ss_between", "df_between", "df_within", "statistic", "p_value", "is_significant")
    )


def correlation(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form (row_no, col_no, names, value), diagonal 1.

    One pass computes every pair i < j; the mirror image is added to the one-row result.
    """
    names = list(variables)
    pairs = list(combinations(range(len(names)), 2))
    aggregates = [
        F.corr(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")).alias(f"c{i}_{j}")
        for i, j in pairs
    ] or [F.count(F.lit(1)).alias("rows")]
    return _cells(df.agg(*aggregates), names, lambda i, j: F.col(f"c{i}_{j}"))


def spearman(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Pearson matrix of the average ranks (rows with a null in any variable are left out).

    The rows are read once: equal combinations of values become one row with its copies. All variables together,
    as (variable, value), are ranked in one pass, joined and put back into one row per combination. Values of more than
    FREQUENT combinations are few, and their ranks are broadcast; only the others are joined by a shuffle, so no task
    gets a frequent value. Tables beyond what the session's number of tasks can hold get more of them, so
    that a task's memory stays the same whatever the number of rows.
    """
    names = list(variables)
    n_tasks = math.ceil(df.count() / TASK_ROWS)
    many = n_tasks > shuffle_partitions(df.sparkSession)

    def dealt(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(n_tasks, *keys) if many else rows

    complete = df.select(*[F.col(v).cast("double").alias(v) for v in names]).dropna()
    distinct = written(dealt(complete, *names).groupBy(*names).agg(F.count(F.lit(1)).alias("__copies")).withColumn(
        "__id", F.monotonically_increasing_id()), "combinations")
    entries = dealt(distinct, "__id").select("__id", "__copies", F.explode(F.array(*[
        F.struct(F.lit(i).alias("__variable"), F.col(v).alias("__value")) for i, v in enumerate(names)])).alias("__e")
    ).select("__id", "__copies", "__e.*")
    counts = entries.groupBy("__variable", "__value").agg(
        F.sum("__copies").alias("n"), F.count(F.lit(1)).alias("__combinations"))
    ranks = written(cumulative_sums(counts, ["__variable"], "__value", "n", n_tasks if many else None).select(
        "__variable", "__value", (F.col("before") + (F.col("n") + 1) / 2).alias("__rank"), "__combinations"), "ranks")
    key, is_frequent = ["__variable", "__value"], F.col("__combinations") > FREQUENT
    # no more rows than variables times combinations / FREQUENT
    frequent = F.broadcast(ranks.filter(is_frequent).drop("__combinations"))
    others = ranks.filter(~is_frequent).drop("__combinations")
    placed = entries.join(frequent, key).unionByName(
        dealt(entries.join(frequent, key, "left_anti"), *key).join(dealt(others, *key), key))
    ranked = dealt(placed, "__id").groupBy("__id", "__copies").agg(*[
        F.max(F.when(F.col("__variable") == i, F.col("__rank"))).alias(f"__rank_{v}") for i, v in enumerate(names)])
    return weighted_correlation(ranked, names, "__rank_", "__copies")


def weighted_correlation(df: DataFrame, variables: Sequence[str], prefix: str,
                         weight: str) -> DataFrame:
    """Pearson matrix of ``prefix + variable`` columns with frequency weights, in one pass.

    Meant for ranks: their mean is about half their range, so raw moments lose no precision.
    """
    names = list(variables)
    w, x = F.col(weight).cast("double"), [F.col(prefix + v).cast("double") for v in names]
    count = len(names)
    sums = df.agg(
        F.sum(w).alias("w"), *[F.sum(w * x[i]).alias(f"m{i}") for i in range(count)],
        *[F.sum(w * x[i] * x[j]).alias(f"s{i}_{j}")
          for i in range(count) for j in range(i, count)])

    def covariance(i: int, j: int):
        return F.col(f"s{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}") / F.col("w")

    return _cells(sums, names, lambda i, j: covariance(i, j) / F.sqrt(
        covariance(i, i)) / F.sqrt(covariance(j, j)))


def _cells(row: DataFrame, names: list[str], value) -> DataFrame:
    """Long form of the matrix held by a one-row table of aggregates."""
    cells = [
        F.struct(
            F.lit(i).alias("row_no"), F.lit(j).alias("col_no"),
            F.lit(names[i]).alias("row_name"), F.lit(names[j]).alias("col_name"),
            (F.lit(1.0) if i == j else value(min(i, j), max(i, j))).alias("value"))
        for i in range(len(names)) for j in range(len(names))
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
