"""Registered queries over lab-like series: ``events`` rows stand for lab results.

user_id is the patient, event_type the item, ts the time and value the measurement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark import catalog
from labspark.functions.values import range_high, range_low, to_number, trajectory_label
from labspark.operators import dictionary, labs, ordering, trends
from labspark.plans.integration import Lookups, lab_trends
from labspark.plans.registry import query, r, rounded, spread, table, values_sql

KEYS = ["user_id", "event_type"]
ORDER = ["ts", "event_id"]

# The lookup tables of these queries: item names of the events table instead of lab markers.
RANGES = [
    ("view", 5.0, 100.0, "s", 1.0, 200.0), ("click", 10.0, 80.0, "s", None, 150.0),
    ("signup", 2.0, 60.0, "s", None, None), ("error", 20.0, 90.0, "s", 5.0, None),
]
UNITS = {
    "view": ("s", {"s": 1.0, "ms": 1003.77}), "click": ("s", {"s": 0.05551237, "min": 1.0}),
    "error": ("s", {"s": 1.0, "h": 0.00027777}),
}
FIELDS = [
    {"standard_name": "view", "chinese_name": "浏览", "alias_names": ["View", "page view"],
     "unit": "s", "reference_range": "5-100"},
    {"standard_name": "click", "chinese_name": "点击", "alias_names": ["CLICK", "tap"],
     "unit": "s", "reference_range": ">40"},
    {"standard_name": "signup", "chinese_name": "注册", "alias_names": ["Sign Up", "SIGNUP"],
     "unit": "n", "reference_range": "2.5-60"},
    {"standard_name": "error", "chinese_name": "错误", "alias_names": ["ERR", "Error"],
     "unit": "n", "reference_range": ""},
]
PROFILES = [("purchase", 10.0, 120.0, "usd", 30.0, "购买")]

_ranges_sql = values_sql(RANGES, "marker, low, high, unit, crit_low, crit_high")
_units_sql = values_sql(
    [(m, u, f, s, us[s]) for m, (s, us) in UNITS.items() for u, f in us.items()],
    "marker, unit, factor, standard_unit, standard_factor")
_alias_sql = values_sql(
    [(a, f["standard_name"]) for f in FIELDS
     for a in dict.fromkeys([f["standard_name"], f["standard_name"].lower(),
                             *f["alias_names"], *[x.lower() for x in f["alias_names"]]])],
    "alias, standard_name")
_flag_sql = """CASE WHEN e.value > g.high THEN
      CASE WHEN e.value > coalesce(g.crit_high, g.high) THEN 'critical_high' ELSE 'high' END
    WHEN e.value < g.low THEN
      CASE WHEN e.value < coalesce(g.crit_low, g.low) THEN 'critical_low' ELSE 'low' END
    ELSE 'normal' END"""
_points_sql = """SELECT user_id, event_type, ts, event_id, value,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS pos
  FROM events WHERE value IS NOT NULL"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").drop("props")


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labs.with_reference(
        events(spark, sf_dir), catalog.range_table(spark, RANGES), "event_type")


def _lookups(spark: SparkSession) -> Lookups:
    return Lookups(
        spark, catalog.field_table(spark, FIELDS), catalog.range_table(spark, RANGES),
        catalog.unit_table(spark, UNITS), profiles=catalog.profile_table(spark, PROFILES))


@query("labs_abnormal_trajectory", f"""
WITH p AS ({_points_sql}),
flags AS (
  SELECT e.user_id, e.event_type,
    count(*) FILTER (WHERE f <> 'normal') AS n_abnormal,
    count(*) FILTER (WHERE f LIKE 'critical%') AS n_critical
  FROM (SELECT e.user_id, e.event_type, {_flag_sql} AS f
        FROM events e LEFT JOIN {_ranges_sql.replace(' AS v(', ' AS g(')}
          ON g.marker = e.event_type) e
  GROUP BY 1, 2)
SELECT p.user_id, p.event_type, count(*) AS n_points,
  arg_min(value, pos) AS baseline_value, arg_max(value, pos) AS latest_value,
  max(value) AS max_value, min(value) AS min_value,
  round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(regr_slope(value, CAST(pos AS DOUBLE)), 6) AS slope,
  round(CASE WHEN arg_min(value, pos) = 0 THEN 0
        ELSE (arg_max(value, pos) - arg_min(value, pos)) / arg_min(value, pos) END, 6)
    AS change_rate,
  any_value(n_abnormal) AS n_abnormal, any_value(n_critical) AS n_critical
FROM p JOIN flags USING (user_id, event_type)
GROUP BY p.user_id, p.event_type HAVING count(*) >= 2""")
def labs_abnormal_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference ranges, abnormal flags and trajectory features per patient and item."""
    flagged = labs.with_flag(_ranged(spark, sf_dir))
    features = trends.trajectory_features(
        flagged, KEYS, "value", ORDER, carry=["abnormal_flag"], extra=[
            F.count_if(F.col("abnormal_flag") != "normal").alias("n_abnormal"),
            F.count_if(F.col("abnormal_flag").startswith("critical")).alias("n_critical")])
    return rounded(features, "mean", "std", "slope", "change_rate")


@query("lab_flag_counts", f"""
SELECT e.event_type, {_flag_sql} AS abnormal_flag, count(*) AS n
FROM events e LEFT JOIN {_ranges_sql.replace(' AS v(', ' AS g(')} ON g.marker = e.event_type
GROUP BY 1, 2""")
def lab_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labs.flag_counts(labs.with_flag(_ranged(spark, sf_dir)), ["event_type"])


_raw_events_sql = """SELECT event_id, user_id, ts,
    CASE event_id % 4 WHEN 0 THEN ' ' || event_type || ' ' WHEN 1 THEN upper(event_type)
      WHEN 2 THEN CASE event_type WHEN 'view' THEN 'Page View' WHEN 'click' THEN 'Tap'
                  ELSE event_type END
      ELSE 'x-' || event_type END AS item_name,
    CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS raw_value,
    value,
    CASE event_id % 5 WHEN 0 THEN 's' WHEN 1 THEN 'ms' WHEN 2 THEN 'min' WHEN 3 THEN 'h' END
      AS unit
  FROM events"""


def raw_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messy lab rows: spelling variants, text values, mixed and missing units."""
    e = events(spark, sf_dir)
    kind, n = F.col("event_type"), F.col("event_id")
    item = (
        F.when(n % 4 == 0, F.concat(F.lit(" "), kind, F.lit(" ")))
        .when(n % 4 == 1, F.upper(kind))
        .when(n % 4 == 2, F.when(kind == "view", "Page View").when(kind == "click", "Tap")
              .otherwise(kind))
        .otherwise(F.concat(F.lit("x-"), kind)))
    unit = (F.when(n % 5 == 0, "s").when(n % 5 == 1, "ms").when(n % 5 == 2, "min")
            .when(n % 5 == 3, "h"))
    value = F.when(n % 11 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return e.select(
        n.alias("ord"), F.col("user_id").cast("string").alias("case_id"),
        F.col("user_id").cast("string").alias("patient_id"), item.alias("item_name"),
        value.alias("value"), unit.alias("unit"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("test_time"))


_standard_sql = f"""SELECT e.event_id AS ord, CAST(e.user_id AS VARCHAR) AS case_id,
    coalesce(a.standard_name, b.standard_name, trim(e.item_name)) AS standard_item_name,
    CASE WHEN e.event_id % 11 <> 0 THEN e.value END AS raw, e.unit AS raw_unit,
    CAST(floor(epoch(e.ts)) AS BIGINT) AS test_seconds
  FROM ({_raw_events_sql}) e
  LEFT JOIN {_alias_sql.replace(' AS v(', ' AS a(')} ON a.alias = trim(e.item_name)
  LEFT JOIN {_alias_sql.replace(' AS v(', ' AS b(')} ON b.alias = lower(trim(e.item_name))"""
_labs_sql = f"""SELECT e.ord, e.case_id, e.standard_item_name,
    CASE WHEN e.value IS NULL THEN 'normal' ELSE {_flag_sql} END AS abnormal_flag,
    e.value, e.unit, e.test_seconds
  FROM (
    SELECT s.ord, s.case_id, s.standard_item_name, s.test_seconds,
      CASE WHEN s.raw IS NULL OR coalesce(s.raw_unit, g.unit) IS NULL THEN s.raw
        WHEN u.factor IS NULL OR u.standard_unit = coalesce(s.raw_unit, g.unit)
          THEN round(s.raw, 4)
        ELSE round(s.raw / u.factor * u.standard_factor, 4) END AS value,
      CASE WHEN s.raw IS NULL THEN coalesce(s.raw_unit, g.unit)
        ELSE coalesce(u.standard_unit, s.raw_unit, g.unit) END AS unit
    FROM ({_standard_sql}) s
    LEFT JOIN {_ranges_sql.replace(' AS v(', ' AS g(')} ON g.marker = s.standard_item_name
    LEFT JOIN {_units_sql.replace(' AS v(', ' AS u(')}
      ON u.marker = s.standard_item_name AND u.unit = coalesce(s.raw_unit, g.unit)) e
  LEFT JOIN {_ranges_sql.replace(' AS v(', ' AS g(')} ON g.marker = e.standard_item_name"""


@query("lab_standardize_units", _labs_sql)
def lab_standardize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, numbers, units, bounds and flags of messy lab rows."""
    lookups = _lookups(spark)
    standard = labs.standard_labs(
        raw_labs(spark, sf_dir), lookups.aliases, lookups.ranges, lookups.units)
    return standard.select(
        "ord", "case_id", "standard_item_name", "abnormal_flag", "value", "unit",
        F.unix_timestamp("test_time").alias("test_seconds"))


@query("lab_case_attributes", """
SELECT CAST(user_id AS VARCHAR) AS case_id, CAST(arg_min(event_id, event_id) AS VARCHAR)
    AS patient_id, round(arg_min(value, event_id), 2) AS anchor_age
FROM events GROUP BY 1""")
def lab_case_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient id and age from the first row of every case."""
    rows = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_id").cast("string").alias("patient_id"), "event_id", "value")
    return labs.case_attributes(rows, "event_id", "value")


@query("numeric_coercion", """
SELECT event_type, count(TRY_CAST(trim(t) AS DOUBLE)) AS n_numbers,
  count(*) - count(TRY_CAST(trim(t) AS DOUBLE)) AS n_bad,
  round(sum(TRY_CAST(trim(t) AS DOUBLE)), 4) AS total
FROM (SELECT event_type, CASE event_id % 4 WHEN 0 THEN ' ' || CAST(value AS VARCHAR) || ' '
        WHEN 1 THEN event_type WHEN 2 THEN CAST(value AS VARCHAR) || 'd'
        ELSE '-' || CAST(value AS VARCHAR) END AS t FROM events)
GROUP BY event_type""")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("event_id"), F.col("value").cast("string")
    t = (F.when(n % 4 == 0, F.concat(F.lit(" "), text, F.lit(" ")))
         .when(n % 4 == 1, F.col("event_type")).when(n % 4 == 2, F.concat(text, F.lit("d")))
         .otherwise(F.concat(F.lit("-"), text)))
    number = to_number(t)
    return events(spark, sf_dir).select("event_type", number.alias("x")).groupBy(
        "event_type").agg(
        F.count("x").alias("n_numbers"), F.count_if(F.col("x").isNull()).alias("n_bad"),
        F.round(F.sum("x"), 4).alias("total"))


@query("lab_wide_to_long", """
SELECT item_name, count(*) AS n_rows, count(TRY_CAST(value AS DOUBLE)) AS n_values,
  round(sum(TRY_CAST(value AS DOUBLE)), 2) AS total
FROM (
  SELECT 'l_quantity' AS item_name, CAST(l_quantity AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT 'l_discount', CAST(l_discount AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem)
GROUP BY item_name""")
def lab_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows (one column per item) to long rows, bad numbers to null."""
    wide = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_quantity", "l_discount", "l_returnflag")
    long = labs.wide_to_long(wide, ["id"]).withColumn("x", to_number(F.col("value")))
    return long.groupBy("item_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("n_values"),
        F.round(F.sum("x"), 2).alias("total"))


@query("series_positions", f"SELECT user_id, event_type, event_id, pos FROM ({_points_sql})")
def series_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0-based position of every row in its series."""
    rows = events(spark, sf_dir).filter("value is not null").select(*KEYS, *ORDER)
    return ordering.with_positions(rows, KEYS, ORDER).select(*KEYS, "event_id", "pos")


_trend_sql = """SELECT user_id, event_type, arg_min(value, ts) AS first_value,
    arg_max(value, ts) AS last_value, max(value) AS max_value, min(value) AS min_value,
    count(value) AS n_points,
    CASE WHEN arg_min(value, ts) = 0 THEN 0
      ELSE (arg_max(value, ts) - arg_min(value, ts)) / arg_min(value, ts) END AS change_rate
  FROM events GROUP BY 1, 2"""


@query("lab_trend_direction", f"""
SELECT user_id, event_type, first_value, last_value, max_value, min_value, n_points,
  round(change_rate, 6) AS change_rate,
  CASE WHEN n_points = 0 THEN 'unknown' WHEN change_rate > CAST(0.05 AS DOUBLE) THEN 'up'
    WHEN change_rate < CAST(-0.05 AS DOUBLE) THEN 'down' ELSE 'stable' END AS trend_direction
FROM ({_trend_sql})""")
def lab_trend_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        trends.trend_summary(events(spark, sf_dir), KEYS, "value", "ts"), "change_rate")


_slope_sql = """CASE WHEN count(value) >= 2 THEN (arg_max(value, ts) - arg_min(value, ts))
      / greatest(floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000.0), 1) END"""


@query("lab_slope_per_day", f"""
SELECT user_id, event_type, count(value) AS n_points, round({_slope_sql}, 6) AS slope_per_day
FROM events GROUP BY 1, 2 HAVING count(value) >= 2""")
def lab_slope_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        trends.slopes_per_day(events(spark, sf_dir), KEYS, "value", "ts"), "slope_per_day")


@query("lab_latest", """
SELECT user_id, event_type,
  arg_max(value, struct_pack(a := CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END,
    b := CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END, c := event_id)) AS latest_value
FROM events GROUP BY 1, 2""")
def lab_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value per series, where every 13th row has lost its time and counts as latest."""
    rows = events(spark, sf_dir).withColumn(
        "ts", F.when(F.col("event_id") % 13 != 0, F.col("ts")))
    return trends.latest_values(rows, KEYS, "value", "ts", "event_id")


def _feature_sql(item: str, expression: str) -> str:
    return f"max(CASE WHEN event_type = '{item}' THEN {expression} END)"


@query("clinical_features_wide", f"""
SELECT user_id, {_feature_sql('view', 'last_value')} AS view_latest,
  round({_feature_sql('view', 'mean')}, 6) AS view_mean,
  round({_feature_sql('click', 'mean')}, 6) AS click_mean,
  {_feature_sql('error', 'last_value')} AS error_level,
  round({_feature_sql('view', 'slope')}, 6) AS view_slope,
  round({_feature_sql('signup', 'slope')}, 6) AS signup_slope
FROM (SELECT user_id, event_type, arg_max(value, ts) AS last_value, avg(value) AS mean,
        {_slope_sql} AS slope FROM events GROUP BY 1, 2)
GROUP BY user_id""")
def clinical_features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature row per case."""
    wide = trends.clinical_features(
        events(spark, sf_dir), "user_id", "event_type", "value", "ts", ["view", "signup"],
        glucose="view", creatinine="click", tumour="error")
    return rounded(wide, "view_mean", "click_mean", "view_slope", "signup_slope")


@query("lab_abnormal_points", f"""
SELECT user_id, event_type, pos, p.value,
  coalesce(p.value < g.low OR p.value > g.high, FALSE) AS is_abnormal
FROM ({_points_sql}) p LEFT JOIN {_ranges_sql.replace(' AS v(', ' AS g(')} ON g.marker = p.event_type""")
def lab_abnormal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point; items without a range are never abnormal."""
    return trends.abnormal_points(_ranged(spark, sf_dir), KEYS, "value", ORDER).select(
        *KEYS, "pos", "value", "is_abnormal")


def _half_split_sql(points: str, spread: str) -> str:
    return f"""SELECT user_id, event_type, n_points, round(m1, 6) AS first_half_mean,
    round(m2, 6) AS second_half_mean, n_above, n_below,
    CASE WHEN n_above > 0 AND n_below > 0 THEN 'fluctuating' WHEN n_points < 2 THEN 'stable'
      WHEN m2 - m1 > spread * CAST(0.1 AS DOUBLE) THEN 'increasing'
      WHEN m2 - m1 < -spread * CAST(0.1 AS DOUBLE) THEN 'decreasing'
      ELSE 'stable' END AS trend_direction
  FROM (
    SELECT user_id, event_type, max(n) AS n_points,
      avg(CASE WHEN pos < n // 2 THEN value END) AS m1,
      avg(CASE WHEN pos >= n // 2 THEN value END) AS m2,
      count(*) FILTER (WHERE value > high) AS n_above,
      count(*) FILTER (WHERE value < low) AS n_below, {spread} AS spread
    FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM ({points}))
    GROUP BY 1, 2)"""


@query("lab_half_split_trend", _half_split_sql(
    f"SELECT p.*, g.low, g.high FROM ({_points_sql}) p LEFT JOIN "
    f"{_ranges_sql.replace(' AS v(', ' AS g(')} ON g.marker = p.event_type",
    "coalesce(stddev_samp(value), 0)"))
def lab_half_split_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        trends.half_split_trend(_ranged(spark, sf_dir), KEYS, "value", ORDER),
        "first_half_mean", "second_half_mean")


@query("lab_trend_response", "SELECT CAST(user_id AS VARCHAR) AS patient_id, event_type AS "
       "standard_item_name, n_points, first_half_mean, second_half_mean, n_above, n_below, "
       "trend_direction FROM (" + _half_split_sql(
           f"SELECT p.*, g.low, g.high, g.spread FROM ({_points_sql}) p JOIN "
           + values_sql([("view", 5.0, 100.0, None), ("click", 40.0, 80.0, None),
                         ("signup", 2.5, 60.0, None), ("error", 0.0, 100.0, None),
                         ("purchase", 10.0, 120.0, 30.0)],
                        "marker, low, high, spread").replace(" AS v(", " AS g(")
           + " ON g.marker = p.event_type",
           "coalesce(max(spread), stddev_samp(value), 0)") + ")")
def lab_trend_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend per patient and item with text ranges of the dictionary and fallback profiles."""
    rows = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.upper("event_type").alias("standard_item_name"), "ts", "event_id", "value")
    got = lab_trends(rows, _lookups(spark), ORDER)
    return rounded(got.withColumn("standard_item_name", F.lower("standard_item_name")),
                   "first_half_mean", "second_half_mean")


@query("lab_forecast", f"""
WITH s AS (
  SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS n, avg(value) AS mean,
    var_pop(value) AS var, regr_slope(value, CAST(pos AS DOUBLE)) AS slope,
    arg_max(value, pos) AS latest
  FROM ({_points_sql}) GROUP BY 1, 2 HAVING count(*) >= 2),
f AS (
  SELECT s.user_id, s.event_type, s.n, s.mean, s.slope, s.latest,
    sum((p.value - s.mean - s.slope * (p.pos - (s.n - 1) / 2)) ** 2) AS rss1,
    sum(((p.pos - (s.n - 1) / 2) ** 2 - (s.n * s.n - 1) / 12) * p.value) AS p2,
    s.n * (s.n * s.n - 1) * (s.n * s.n - 4) / 180 AS q2
  FROM s JOIN ({_points_sql}) p USING (user_id, event_type)
  GROUP BY ALL),
c AS (SELECT *, n >= 4 AND rss1 - p2 * p2 / nullif(q2, 0) < CAST(0.8 AS DOUBLE) * rss1
        AS is_quadratic FROM f),
o AS (
  SELECT c.*, step, mean + slope * (n + step - 1 - (n - 1) / 2)
    + CASE WHEN is_quadratic THEN p2 / q2 *
        ((n + step - 1 - (n - 1) / 2) ** 2 - (n * n - 1) / 12) ELSE 0 END AS forecast_value
  FROM c, (SELECT unnest([1, 2]) AS step))
SELECT user_id, event_type, CAST(n AS BIGINT) AS n_points, round(slope, 6) AS slope,
  coalesce(is_quadratic, FALSE) AS is_quadratic, step, round(forecast_value, 7) AS forecast_value,
  CASE WHEN slope > CAST(0.1 AS DOUBLE) THEN 'increasing'
    WHEN slope < CAST(-0.1 AS DOUBLE) THEN 'decreasing' ELSE 'stable' END AS trend_direction,
  slope > CAST(0.1 AS DOUBLE) AND (latest > mean * CAST(1.1 AS DOUBLE)
    OR max(round(forecast_value, 2)) OVER (PARTITION BY user_id, event_type) > latest)
    AS risk_alert
FROM o""")
def lab_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecasts = trends.forecast(events(spark, sf_dir), KEYS, "value", ORDER)
    return trends.forecast_rows(forecasts).select(
        *KEYS, "n_points", r("slope").alias("slope"), "is_quadratic", "step",
        r("forecast_value", 7).alias("forecast_value"), "trend_direction", "risk_alert")


_range_text_sql = """CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) || '-' ||
      CAST(p_retailprice AS VARCHAR) WHEN 1 THEN '>' || CAST(p_size AS VARCHAR)
    WHEN 2 THEN '' WHEN 3 THEN '<' || CAST(p_retailprice AS VARCHAR) ELSE p_type END"""


@query("range_parse", f"""
SELECT p_partkey, coalesce(TRY_CAST(trim(split_part(t, '-', 1)) AS DOUBLE), 0) AS low,
  coalesce(CASE WHEN contains(t, '-') THEN TRY_CAST(trim(split_part(t, '-', 2)) AS DOUBLE)
    ELSE TRY_CAST(trim(t) AS DOUBLE) * 2 END, 100) AS high
FROM (SELECT p_partkey, replace(replace({_range_text_sql}, '<', ''), '>', '') AS t FROM part)""")
def range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from range texts such as '3-900.5', '>12' and ''."""
    n, size, price = F.col("p_partkey") % 5, F.col("p_size").cast("string"), F.col(
        "p_retailprice").cast("string")
    text = (F.when(n == 0, F.concat(size, F.lit("-"), price))
            .when(n == 1, F.concat(F.lit(">"), size)).when(n == 2, "")
            .when(n == 3, F.concat(F.lit("<"), price)).otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", range_low(text).alias("low"), range_high(text).alias("high"))


@query("text_lab_extract", r"""
SELECT doc_id, i - 1 AS match_no, item_name[i] AS item_name, value[i] AS value,
  nullif(unit[i], '') AS unit
FROM (
  SELECT doc_id, unnest(generate_series(1, len(item_name))) AS i, item_name, value, unit
  FROM (
    SELECT doc_id, regexp_extract_all(text, p, 1) AS item_name,
      regexp_extract_all(text, p, 2) AS value, regexp_extract_all(text, p, 3) AS unit
    FROM documents, (SELECT
      '([一-龥A-Za-z0-9%\-]+)\s*[:：]?\s*([0-9.]+)\s*([A-Za-z/%μ^0-9·/.-]*)' AS p)))""")
def text_lab_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'name: number unit' patterns anywhere in the documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return labs.text_labs(docs)


@query("alias_lookup", f"""
SELECT item_name, standard_name, count(*) AS n FROM (
  SELECT trim(e.item_name) AS item_name,
    coalesce(a.standard_name, b.standard_name, trim(e.item_name)) AS standard_name
  FROM ({_raw_events_sql}) e
  LEFT JOIN {_alias_sql.replace(' AS v(', ' AS a(')} ON a.alias = trim(e.item_name)
  LEFT JOIN {_alias_sql.replace(' AS v(', ' AS b(')} ON b.alias = lower(trim(e.item_name)))
GROUP BY 1, 2""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How raw item names resolve through the alias index."""
    index = dictionary.alias_index(catalog.field_table(spark, FIELDS))
    named = labs.with_standard_name(raw_labs(spark, sf_dir), index)
    return named.groupBy(
        F.trim("item_name").alias("item_name"), F.col("standard_item_name").alias("standard_name")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("json_columns", """
SELECT event_type, count(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS n,
  CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS total
FROM events GROUP BY 1""")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values kept as JSON text, read back with a schema."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(k).alias("n"), F.sum(k).alias("total"))


@query("trajectory_labels", """
WITH p AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS pos
           FROM events WHERE value IS NOT NULL),
f AS (SELECT user_id, event_type, count(*) AS n, arg_min(value, pos) AS baseline, regr_slope(value, pos) AS slope
      FROM p GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id, event_type, round(slope, 6) AS slope, CASE WHEN baseline <= 0 THEN '数据异常'
  WHEN slope / baseline > CAST(0.02 AS DOUBLE) THEN '快速恶化/上升亚型' WHEN slope / baseline > CAST(0.005 AS DOUBLE) THEN '缓慢进展亚型'
  WHEN slope / baseline > CAST(-0.005 AS DOUBLE) THEN '平稳控制亚型' WHEN slope / baseline > CAST(-0.02 AS DOUBLE) THEN '缓慢改善亚型'
  ELSE '治疗改善/下降亚型' END AS label FROM f""")
def trajectory_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtype of every series, from its slope relative to its first value."""
    features = trends.trajectory_features(events(spark, sf_dir), ["user_id", "event_type"], "value", ["ts", "event_id"])
    return features.select("user_id", "event_type", r("slope").alias("slope"),
                           trajectory_label(F.col("slope"), F.col("baseline_value")).alias("label"))


@query("row_defaults", """
SELECT o_orderkey AS ord, CAST(o_custkey AS VARCHAR) AS case_id, coalesce(nullif(o_orderstatus, 'P'), 'p0') AS patient_id, 'v001' AS visit_id,
  CAST(NULL AS VARCHAR) AS unit, strftime(o_orderdate, '%Y-%m-%d') AS test_time
FROM orders WHERE o_custkey % 10 < 9""")
def row_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional attributes of lab rows: the row's value, else the caller's, else null."""
    rows = table(spark, sf_dir, "orders").filter("o_custkey % 10 < 9").select(
        F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("case_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("patient_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("test_time"))
    return labs.with_defaults(labs.filter_case(rows, None), "p0", "v001").select(
        "ord", "case_id", "patient_id", "visit_id", "unit", "test_time")


@query("case_identity", """
WITH first AS (SELECT min(o_custkey) AS c FROM orders)
SELECT o_orderstatus AS kind, count(*) AS n_rows,
  CAST(CASE WHEN min(o_custkey) = max(o_custkey) THEN min(o_custkey) END AS VARCHAR) AS single_case,
  (SELECT arg_min(o_orderpriority, o_orderkey) FROM orders i WHERE i.o_custkey = first.c AND i.o_orderstatus = o.o_orderstatus) AS first_patient
FROM orders o, first WHERE o_custkey = first.c GROUP BY o_orderstatus, first.c
UNION ALL SELECT 'all', count(*), CAST(CASE WHEN min(o_custkey) = max(o_custkey) THEN min(o_custkey) END AS VARCHAR),
  arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_custkey = (SELECT c FROM first)) FROM orders""")
def case_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case that a table is about, if it is about one, and the patient of its first row: per status and for all."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("kind"), F.col("o_custkey").cast("string").alias("case_id"),
        F.col("o_orderpriority").alias("patient_id"), F.col("o_orderkey").alias("ord"), "o_custkey")
    case = str(rows.agg(F.min("o_custkey")).first()[0])
    parts = [(kind[0], labs.filter_case(rows.filter(F.col("kind") == kind[0]), case)) for kind in rows.filter(
        F.col("case_id") == case).select("kind").distinct().collect()]  # a row per order status
    out = None
    for kind, part in [*parts, ("all", rows)]:
        one = part.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows")).crossJoin(
            labs.single_case_id(part).withColumnRenamed("case_id", "single_case")).crossJoin(  # one row each
            labs.first_patient_id(part, "ord", case_id=case).withColumnRenamed("patient_id", "first_patient"))
        out = one if out is None else out.unionByName(one)
    return out
