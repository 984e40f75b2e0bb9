"""Registered queries for statistics over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.operators import ordering, stats
from labspark.plans.registry import query, rounded, table

VARIABLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with missing values in two columns."""
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice",
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("l_tax"))


_gaps_sql = """SELECT l_quantity, l_extendedprice,
  CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount,
  CASE WHEN l_returnflag <> 'R' THEN l_tax END AS l_tax FROM lineitem"""


@query("stats_describe", " UNION ALL ".join(f"""
SELECT '{v}' AS variable, count({v}) AS sample_count, round(avg({v}), 6) AS mean,
  round(stddev_samp({v}), 6) AS std, round(quantile_cont({v}, 0.5), 6) AS median,
  round(quantile_cont({v}, 0.25), 6) AS quartile_1,
  round(quantile_cont({v}, 0.75), 6) AS quartile_3, min({v}) AS min, max({v}) AS max,
  round(1 - count({v}) / count(*), 6) AS missing_rate
FROM ({_gaps_sql})""" for v in VARIABLES))
def stats_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, moments, exact quartiles and missing rates."""
    return rounded(
        stats.describe(_with_gaps(spark, sf_dir), VARIABLES),
        "mean", "std", "median", "quartile_1", "quartile_3", "missing_rate")


def _tail_sql(start: str, density: str) -> str:
    """Twice the integral of a density of u from ``start`` on, by the midpoint rule over u = start + v / (1 - v)."""
    n = 100_000
    at = f"((i + 0.5) / {n})"
    value = density.format(u=f"({start} + {at} / (1 - {at}))")
    return f"2 * list_sum(list_transform(range({n}), lambda i: {value} / ((1 - {at}) * (1 - {at})))) / {n}"


_T_DENSITY = ("exp(lgamma((df + 1) / 2) - lgamma(df / 2) - ln(pi() * df) / 2"
              " - (df + 1) / 2 * ln(1 + {u} * {u} / df))")


@query("stats_welch", f"""
SELECT * EXCLUDE (raw_df, raw_t, df, p), round(df, 4) AS df, round(p, 8) AS p_value, p < 0.05 AS is_significant
FROM (SELECT *, {_tail_sql("abs(raw_t)", _T_DENSITY)} AS p FROM (SELECT *, raw_df AS df FROM (
SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
  round((mean_a - mean_b) / sqrt(va / n_a + vb / n_b), 6) AS statistic,
  (mean_a - mean_b) / sqrt(va / n_a + vb / n_b) AS raw_t,
  (va / n_a + vb / n_b) ** 2 /
    ((va / n_a) ** 2 / (n_a - 1) + (vb / n_b) ** 2 / (n_b - 1)) AS raw_df
FROM (
  SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS n_a,
    count(*) FILTER (WHERE l_returnflag = 'R') AS n_b,
    avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS mean_a,
    avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS mean_b,
    var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS va,
    var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS vb
  FROM lineitem))))""")
def stats_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch t-test of prices between two return flags."""
    got = stats.welch_t_test(
        table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "A", "R")
    return rounded(rounded(rounded(got, "mean_a", "mean_b", "statistic"), "df", digits=4), "p_value", digits=8).select(
        "n_a", "n_b", "mean_a", "mean_b", "statistic", "df", "p_value", "is_significant")


# with two degrees of freedom above, the tail is a power
@query("stats_anova", """
SELECT * REPLACE (round(statistic, 6) AS statistic), round((1 + 2 * statistic / df_within) ** (-df_within / 2), 8) AS p_value,
  (1 + 2 * statistic / df_within) ** (-df_within / 2) < 0.05 AS is_significant FROM (
WITH g AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m,
             var_pop(l_quantity) AS v FROM lineitem GROUP BY 1),
  t AS (SELECT avg(l_quantity) AS grand, count(*) AS total FROM lineitem)
SELECT round(sum(n * (m - grand) ** 2), 4) AS ss_between, round(sum(n * v), 4) AS ss_within,
  CAST(count(*) - 1 AS DOUBLE) AS df_between,
  CAST(max(total) - count(*) AS DOUBLE) AS df_within,
  sum(n * (m - grand) ** 2) / (count(*) - 1) / (sum(n * v) / (max(total) - count(*))) AS statistic
FROM g, t)""")
def stats_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.anova(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return rounded(rounded(rounded(got, "statistic"), "ss_between", "ss_within", digits=4), "p_value", digits=8).select(
        "ss_between", "ss_within", "df_between", "df_within", "statistic", "p_value", "is_significant")


_average_rank_sql = """rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"""


@query("stats_mann_whitney", f"""
SELECT n_a, n_b, statistic, round(z, 6) AS z, round(least(p, 1), 8) AS p_value, least(p, 1) < 0.05 AS is_significant
FROM (SELECT *, {_tail_sql("abs(z)", "exp(-{u} * {u} / 2) / sqrt(2 * pi())")} AS p FROM (
SELECT n1 AS n_a, n2 AS n_b, u AS statistic,
  (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5)
    / sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1)))) AS z
FROM (
  SELECT n1, n2, CAST(n1 + n2 AS DOUBLE) AS n, ties, rs - n1 * (n1 + 1) / 2.0 AS u
  FROM (
    SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS n1,
      count(*) FILTER (WHERE l_returnflag = 'R') AS n2,
      sum(rk) FILTER (WHERE l_returnflag = 'A') AS rs,
      sum(CAST(c AS DOUBLE) * c - 1) AS ties
    FROM (
      SELECT l_returnflag, {_average_rank_sql.format('l_quantity')} AS rk,
        count(*) OVER (PARTITION BY l_quantity) AS c
      FROM lineitem WHERE l_returnflag IN ('A', 'R'))))))""")
def stats_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.mann_whitney(
        table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "A", "R")
    return rounded(rounded(got, "z"), "p_value", digits=8).select(
        "n_a", "n_b", "statistic", "z", "p_value", "is_significant")


def _matrix_sql(source: str, names: list[str]) -> str:
    cells = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            cells.append(f"SELECT {i} AS row_no, {j} AS col_no, '{a}' AS row_name, '{b}' AS "
                         f"col_name, round(corr({a}, {b}), 6) AS value FROM {source}")
    return " UNION ALL ".join(cells)


@query("stats_pearson_heatmap", _matrix_sql(f"({_gaps_sql})", VARIABLES))
def stats_pearson_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation matrix in heat-map form, null pairs left out."""
    return rounded(stats.correlation(_with_gaps(spark, sf_dir), VARIABLES), "value")


@query("stats_spearman", "WITH k AS (SELECT "
       + ", ".join(f"{_average_rank_sql.format(v)} AS {v}" for v in VARIABLES)
       + " FROM lineitem) " + _matrix_sql("k", VARIABLES))
def stats_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman(table(spark, sf_dir, "lineitem"), VARIABLES), "value")


@query("average_ranks", f"""
SELECT DISTINCT value, {_average_rank_sql.format('value')} AS rank,
  count(*) OVER (PARTITION BY value) AS n FROM events""")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-averaged rank of every distinct value, without a global sort in one task."""
    rows = table(spark, sf_dir, "events").select(F.lit(1).alias("one"), "value")
    return ordering.average_ranks(rows, ["one"], "value").select("value", "rank", "n")


def _ranks_sql(name: str, by: str, value: str) -> str:
    return f"""SELECT DISTINCT {by} AS k, {value} AS value, rank() OVER (PARTITION BY {by} ORDER BY {value})
  + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY {by}, {value}) AS n
FROM {name}"""


def _ranks(spark: SparkSession, sf_dir: str, name: str, by: str, value: str) -> DataFrame:
    return ordering.average_ranks(table(spark, sf_dir, name).select(
        F.col(by).alias("k"), F.col(value).alias("value")), ["k"], "value").select("k", "value", "rank", "n")


@query("ranks_of_dates", _ranks_sql("orders", "o_orderpriority", "o_orderdate"))
def ranks_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-averaged ranks of order dates within each priority."""
    return _ranks(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate")


@query("ranks_of_names", _ranks_sql("events", "user_id % 3", "props"))
def ranks_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-averaged ranks of event properties, which are text, within thirds of the users."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("k"), F.col("props").alias("value"))
    return ordering.average_ranks(rows, ["k"], "value").select("k", "value", "rank", "n")
