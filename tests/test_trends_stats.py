import math
import os
import random
import statistics
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from labspark import tables
from labspark.functions import tails
from labspark.operators import learning, ordering, stats, trends

SERIES = {
    "a": [6.2, 6.9, 7.4, 8.1, 8.8],
    "b": [7.8, 8.6, 9.8],
    "c": [100.0, 101.0, 99.0, 100.0, 100.0, 101.0],
    "line": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
    "one": [4.0],
}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, i, v) for k, vs in SERIES.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, v double").repartition(3).cache()


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, equal order values and a null among them."""
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.randint(0, 20) if i != 4 else None, i,
             round(rng.gauss(10, 3), 2)) for i in range(400)]
    return spark.createDataFrame(rows, "k string, t int, id int, v double").repartition(4).cache()


def by_key(df, key="k"):
    return {r[key]: r for r in df.collect()}


def test_trajectory_golden(series):
    got = by_key(trends.trajectory_features(series, ["k"], "v", ["t"]))
    assert "one" not in got
    a, b = got["a"], got["b"]
    assert (a["baseline_value"], a["latest_value"], a["max_value"], a["min_value"]) == (
        6.2, 8.8, 8.8, 6.2)
    assert a["mean"] == pytest.approx(7.48) and a["std"] == pytest.approx(1.0134, abs=1e-4)
    assert a["slope"] == pytest.approx(0.64) and a["change_rate"] == pytest.approx(0.4194, abs=1e-4)
    assert b["mean"] == pytest.approx(8.7333, abs=1e-4) and b["slope"] == pytest.approx(1.0)


def test_trajectory_reversal_flips_the_slope(series):
    forward = by_key(trends.trajectory_features(series, ["k"], "v", ["t"]))
    back = by_key(trends.trajectory_features(
        series.withColumn("t", -F.col("t")), ["k"], "v", ["t"]))
    for k, row in forward.items():
        assert back[k]["slope"] == pytest.approx(-row["slope"], abs=1e-9)
        assert row["min_value"] <= row["mean"] <= row["max_value"]


def test_forecast_golden(series):
    got = by_key(trends.forecast(series, ["k"], "v", ["t"]))
    a, b, c = got["a"], got["b"], got["c"]
    assert a["is_quadratic"] and [round(x, 2) for x in a["forecast"]] == [9.5, 10.24]
    assert (a["trend_direction"], a["risk_alert"]) == ("increasing", True)
    assert not b["is_quadratic"] and [round(x, 2) for x in b["forecast"]] == [10.73, 11.73]
    assert b["risk_alert"]
    assert c["is_quadratic"] and [round(x, 2) for x in c["forecast"]] == [101.8, 103.03]
    assert c["slope"] == pytest.approx(0.085714, abs=1e-6)
    assert (c["trend_direction"], c["risk_alert"]) == ("stable", False)
    assert not got["line"]["is_quadratic"]
    assert got["line"]["forecast"] == pytest.approx([7.0, 8.0])
    steps = trends.forecast_rows(trends.forecast(series, ["k"], "v", ["t"])).filter("k = 'a'")
    assert sorted(r["step"] for r in steps.collect()) == [1, 2]


def test_positions_under_skew_match_plain_positions(skewed):
    plain = ordering.with_positions(skewed, ["k"], ["t", "id"])
    cut = ordering.with_positions(skewed, ["k"], ["t", "id"], max_group_rows=50)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(
        map(tuple, cut.collect()), key=str)
    assert cut.columns == plain.columns
    last = cut.filter("t is null").first()
    assert last["pos"] == cut.filter(F.col("k") == last["k"]).count() - 1


def test_series_operators_under_skew(skewed):
    for operator in (trends.trajectory_features, trends.forecast):
        plain = operator(skewed, ["k"], "v", ["t", "id"])
        cut = operator(skewed, ["k"], "v", ["t", "id"], max_group_rows=50)
        want, got = by_key(plain), by_key(cut)
        assert want.keys() == got.keys()
        for k in want:
            for field, value in want[k].asDict().items():
                assert got[k][field] == (
                    pytest.approx(value, rel=1e-9) if isinstance(value, (float, list)) else value)


def test_hot_series_with_timestamps(spark):
    # one series holds a third of all rows, and many rows share a time
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.timestamp_seconds((F.col("id") * 7919) % 600).alias("t"), "id",
        ((F.col("id") * 31) % 97).cast("double").alias("v"))
    plain = {r["id"]: r["pos"] for r in ordering.with_positions(rows, ["k"], ["t", "id"]).collect()}
    cut = {r["id"]: r["pos"] for r in ordering.with_positions(
        rows, ["k"], ["t", "id"], max_group_rows=100).collect()}
    assert plain == cut and len(cut) == 3000
    # any orderable type, ties in the first order column, many groups over the limit
    plain = {r["id"]: r["pos"] for r in ordering.with_positions(rows, ["t"], ["k", "id"]).collect()}
    cut = {r["id"]: r["pos"] for r in ordering.with_positions(rows, ["t"], ["k", "id"], max_group_rows=1).collect()}
    assert plain == cut


def test_anova_does_not_depend_on_the_level(spark):
    rows = [(f"g{g}", g * 0.001 + (i % 7) * 1e-4) for g in range(3) for i in range(1000)]
    want = stats.anova(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()
    for level, close in ((1e6, 1e-3), (1e8, 1e-1)):
        df = spark.createDataFrame([(g, v + level) for g, v in rows], "g string, v double")
        got = stats.anova(df, "g", "v").first()
        assert got["statistic"] == pytest.approx(want["statistic"], rel=close) and got["ss_between"] > 0


def test_half_split_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(6)], "k string, t int, v double").withColumns(
        {"reference_low": F.lit(-1.0), "reference_high": F.lit(10.0)})
    row = trends.half_split_trend(df, ["k"], "v", ["t"]).first()
    assert (row["k"], row["n_points"], row["trend_direction"]) == (None, 6, "increasing")


def test_half_split(spark):
    rows = [("up", i, float(i)) for i in range(6)] + [("flat", i, 5.0) for i in range(4)]
    rows += [("both", 0, 0.0), ("both", 1, 20.0), ("both", 2, 5.0)] + [("one", 0, 5.0)]
    rows += [("down", i, 6.0 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t int, v double").withColumns(
        {"reference_low": F.lit(-1.0), "reference_high": F.lit(10.0)})
    df = df.withColumn("reference_low", F.when(F.col("k") == "both", 1.0).otherwise(-1.0))
    for limit in (ordering.MAX_GROUP_ROWS, 2):
        got = by_key(trends.half_split_trend(df, ["k"], "v", ["t"], max_group_rows=limit))
        assert {k: r["trend_direction"] for k, r in got.items()} == {
            "up": "increasing", "flat": "stable", "both": "fluctuating", "one": "stable",
            "down": "decreasing"}
        assert got["up"]["first_half_mean"] == 1.0 and got["up"]["second_half_mean"] == 4.0
        assert got["down"]["first_half_mean"] == 5.5  # floor(5 / 2) points in the first half


def test_abnormal_points(spark):
    df = spark.createDataFrame([("k", 0, 5.0), ("k", 1, 50.0), ("k", 2, -5.0)],
                               "k string, t int, v double").withColumns(
        {"reference_low": F.lit(0.0), "reference_high": F.lit(10.0)})
    got = trends.abnormal_points(df, ["k"], "v", ["t"]).orderBy("pos").collect()
    assert [(r["pos"], r["is_abnormal"]) for r in got] == [(0, False), (1, True), (2, True)]


def test_quantiles_ranks_and_description(spark):
    rng = random.Random(3)
    values = [round(rng.expovariate(0.1), 1) for _ in range(500)] + [1.5] * 300 + [None] * 10
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("y", -F.col("x"))
    ordered = sorted(v for v in values if v is not None)

    def quantile(p):
        at = (len(ordered) - 1) * p
        low = ordered[math.floor(at)]
        return low + (ordered[math.ceil(at)] - low) * (at - math.floor(at))

    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = by_key(stats.describe(df, ["x", "y"]), "variable")
        x = got["x"]
        assert x["sample_count"] == 800 and x["missing_rate"] == pytest.approx(10 / 810)
        for field, p in (("quartile_1", 0.25), ("median", 0.5), ("quartile_3", 0.75)):
            assert x[field] == pytest.approx(quantile(p))
        assert got["y"]["median"] == pytest.approx(-quantile(0.5))
        ranks = {r["x"]: r["rank"] for r in ordering.average_ranks(
            df.withColumn("g", F.lit(1)), ["g"], "x").collect()}
        for v in set(ordered):
            first = ordered.index(v)
            assert ranks[v] == first + (ordered.count(v) + 1) / 2
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rough = by_key(stats.describe(df, ["x"], exact=False), "variable")["x"]
    assert rough["median"] == pytest.approx(quantile(0.5), rel=0.05)
    nothing = stats.describe(df.limit(0), ["x"]).first()
    assert nothing["sample_count"] == 0 and nothing["missing_rate"] == 1.0


def test_ranks_of_any_type(spark):
    rows = spark.range(2000).select(
        F.concat(F.lit("k"), F.col("id") % 3).alias("k"), F.concat(F.lit("v"), (F.col("id") * 7) % 40).alias("text"),
        F.timestamp_seconds((F.col("id") * 31) % 500).alias("time"),
        F.struct((F.col("id") % 5).alias("a"), ((F.col("id") * 3) % 4).cast("string").alias("b")).alias("pair"))
    rows = rows.unionByName(rows.limit(5).withColumns({c: F.lit(None).cast(t) for c, t in rows.dtypes}))
    for column in ("text", "time", "pair"):
        for partitions in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            ranked = ordering.average_ranks(rows, ["k"], column)
            assert "SinglePartition" not in ranked._jdf.queryExecution().toString()
            got = {(r["k"], r[column]): r["rank"] for r in ranked.collect()}
            groups = {}
            for r in rows.collect():
                if r[column] is not None:
                    groups.setdefault(r["k"], []).append(r[column])
            want = {(k, v): sum(x < v for x in g) + (g.count(v) + 1) / 2 for k, g in groups.items() for v in set(g)}
            assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ordering.average_ranks(rows.limit(0), ["k"], "text").count() == 0


def test_selected_quantiles_run_no_job_early(spark):
    """Narrow bands on many rows, heavy tails, copies, infinities, and columns without values."""
    rows = spark.range(60_000).select(
        F.exp(F.randn(3) * 4).alias("tail"), (F.col("id") % 3).cast("double").alias("few"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("gaps"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") < 2, float("inf")).when(F.col("id") > 50_000, float("-inf")).otherwise(F.rand(5)).alias("ends"))
    rows.write.mode("overwrite").parquet(path := tempfile.mkdtemp(prefix="quantiles-"))
    rows = spark.read.parquet(path)
    columns = rows.columns
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    probs = (0.0, 0.1, 0.25, 0.5, 0.999, 1.0)
    found = ordering.column_quantiles(rows, columns, probs)
    filled = learning.impute_medians(rows, ["gaps", "none"])
    assert len(tracker.getJobIdsForGroup(None)) == before
    got = {r["variable"]: r for r in found.collect()}
    data = rows.toPandas()
    for c in columns:
        values = sorted(data[c].dropna().tolist())
        for i, p in enumerate(probs):
            if not values:
                assert got[c][f"q{i}"] is None
                continue
            at = (len(values) - 1) * p
            low, high = values[math.floor(at)], values[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert got[c][f"q{i}"] == pytest.approx(want)
    gaps = data["gaps"].dropna().tolist()
    row = filled.agg(F.count("gaps"), F.count("none"), F.max(F.when(F.col("few") == 1, F.col("gaps")))).first()
    assert row[0] == 60_000 and row[1] == 0
    assert filled.where("tail is not null").join(rows.where("gaps is null").select("tail"), "tail").select("gaps").first()[0] == int(
        statistics.median(gaps))


def test_tail_probabilities():
    # textbook values
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_upper(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.f_upper(3.0, 1, 7) == pytest.approx(tails.t_two_sided(math.sqrt(3.0), 7))


def test_intermediate_tables_can_be_deleted(spark):
    rows = spark.range(50).withColumn("k", F.col("id") % 3)
    with tables.temporary_tables(spark):
        ranked = ordering.average_ranks(rows, ["k"], "id")
        assert ranked.count() == 50
        paths = [p for p in tables._WRITTEN if os.path.isdir(p)]
        assert paths
        mine = paths[-1]
    assert not os.path.exists(mine) and mine not in tables._WRITTEN
    with pytest.raises(ZeroDivisionError), tables.temporary_tables(spark):
        tables.written(rows, "gone")
        mine = tables._WRITTEN[-1]
        raise ZeroDivisionError
    assert not os.path.exists(mine)


def test_tails_keep_ten_digits():
    """Closed forms at 1, 2 and 4 degrees of freedom, the normal limit with its next term, far tails, huge degrees."""
    close = {"rel": 1e-10, "abs": 0}
    for t in (1e-3, 0.3, 1.0, 7.0, 1e6):
        assert tails.t_two_sided(t, 1) == pytest.approx(2 * math.atan2(1, t) / math.pi, **close)
    for t in (0.1, 1.0, 5.0):
        assert tails.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), **close)
        angle = math.atan(t / 2)
        assert tails.t_two_sided(t, 4) == pytest.approx(1 - math.sin(angle) * (1 + math.cos(angle) ** 2 / 2), **close)
    for df in (1e9, 1e12):
        for t in (0.5, 1.73, 3.0, 6.0):
            limit = math.erfc(t / math.sqrt(2))
            next_term = 2 * math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t ** 3 + t) / (4 * df)
            assert tails.t_two_sided(t, df) == pytest.approx(limit + next_term, **close)
    for d2 in (3, 50, 1e6, 1e12):
        for f in (0.1, 1.0, 7.0, 40.0):
            assert tails.f_upper(f, 2, d2) == pytest.approx(math.exp(-d2 / 2 * math.log1p(2 * f / d2)), **close)
            assert tails.f_upper(f, 1, d2) == pytest.approx(tails.t_two_sided(math.sqrt(f), d2), **close)
    assert tails.f_upper(1.0, 1e6, 1e6) == pytest.approx(0.5, **close)
    assert tails.f_upper(0.5, 4, 1e12) == pytest.approx(2 * math.exp(-1), rel=1e-9)
    assert tails.f_upper(0.0, 3, 5) == 1.0 and tails.t_two_sided(0.0, 3) == 1.0
    assert tails.f_upper(2.5, 3, 12) + tails.f_upper(1 / 2.5, 12, 3) == pytest.approx(1.0, **close)


def test_group_tests(spark):
    a, b = [1.0, 2.0, 2.0, 3.0, 9.0], [2.0, 4.0, 5.0, 6.0, 6.0, 8.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b] + [("c", 1.0)],
                               "g string, v double")
    t = stats.welch_t_test(df, "g", "v", "a", "b").first()

    def mean(x):
        return sum(x) / len(x)

    def var(x):
        return sum((v - mean(x)) ** 2 for v in x) / (len(x) - 1)

    ea, eb = var(a) / 5, var(b) / 6
    assert t["statistic"] == pytest.approx((mean(a) - mean(b)) / math.sqrt(ea + eb))
    assert t["df"] == pytest.approx((ea + eb) ** 2 / (ea ** 2 / 4 + eb ** 2 / 5))
    assert 0 < t["p_value"] < 1
    u = stats.mann_whitney(df, "g", "v", "a", "b").first()
    brute = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert u["statistic"] == pytest.approx(brute)
    f = stats.anova(df.filter("g != 'c'"), "g", "v").first()
    everyone = a + b
    between = sum(len(x) * (mean(x) - mean(everyone)) ** 2 for x in (a, b))
    within = sum((v - mean(x)) ** 2 for x in (a, b) for v in x)
    assert f["statistic"] == pytest.approx(between / (within / 9))


def test_correlations(spark):
    rng = random.Random(5)
    rows = [(float(i % 7), rng.gauss(0, 1), float((i * i) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, z double")

    def pearson(p, q):
        mp, mq = sum(p) / len(p), sum(q) / len(q)
        return sum((i - mp) * (j - mq) for i, j in zip(p, q)) / math.sqrt(
            sum((i - mp) ** 2 for i in p) * sum((j - mq) ** 2 for j in q))

    def ranks(p):
        s = sorted(p)
        return [s.index(v) + (s.count(v) + 1) / 2 for v in p]

    columns = list(zip(*rows))
    for function, prepare in ((stats.correlation, list), (stats.spearman, ranks)):
        got = {(r["row_no"], r["col_no"]): r["value"] for r in function(df, ["x", "y", "z"]).collect()}
        for i in range(3):
            assert got[(i, i)] == 1.0
            for j in range(3):
                assert got[(i, j)] == got[(j, i)]
                if i != j:
                    assert got[(i, j)] == pytest.approx(
                        pearson(prepare(columns[i]), prepare(columns[j])))


def test_spearman_in_many_tasks_with_frequent_values(spark, monkeypatch):
    """Frequent values are broadcast, others are joined in as many tasks as the rows need: the same matrix."""
    rng = random.Random(8)
    rows = [(float(rng.randrange(3)), rng.choice([0.0, -0.0, rng.gauss(0, 1)]), None if i % 50 == 0 else rng.gauss(0, 1))
            for i in range(2000)]
    df = spark.createDataFrame(rows + rows[:100], "x double, y double, z double")
    want = {(r["row_no"], r["col_no"]): r["value"] for r in stats.spearman(df, ["x", "y", "z"]).collect()}
    monkeypatch.setattr(stats, "TASK_ROWS", 300)
    monkeypatch.setattr(stats, "FREQUENT", 20)
    many = stats.spearman(df, ["x", "y", "z"])
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "RepartitionByExpression" in plan
    got = {(r["row_no"], r["col_no"]): r["value"] for r in many.collect()}
    whole = [r for r in rows + rows[:100] if r[2] is not None]
    x, y, z = ([[r[i] for r in whole] for i in range(3)])

    def ranks(p):
        s = sorted(p)
        first, count = {}, {}
        for i, v in enumerate(s):
            first.setdefault(v, i)
            count[v] = count.get(v, 0) + 1
        return [first[v] + (count[v] + 1) / 2 for v in p]

    for i, p in enumerate((x, y, z)):
        for j, q in enumerate((x, y, z)):
            assert got[(i, j)] == pytest.approx(np.corrcoef(ranks(p), ranks(q))[0, 1]) == pytest.approx(want[(i, j)])


def test_stratified_split(spark):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") % 10 < 7, "a").otherwise("b"))
    first = learning.stratified_split(df, "label", "id")
    again = learning.stratified_split(df.repartition(7), "label", "id", max_group_rows=100)
    sizes = {(r["label"], r["is_test"]): r["count"]
             for r in first.groupBy("label", "is_test").count().collect()}
    assert sizes == {("a", True): 140, ("a", False): 560, ("b", True): 60, ("b", False): 240}
    chosen = {r["id"] for r in first.filter("is_test").collect()}
    assert chosen == {r["id"] for r in again.filter("is_test").collect()}
