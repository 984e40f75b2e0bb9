"""Registered queries that build training tables, train and evaluate."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.operators import learning
from labspark.plans.lab_queries import events
from labspark.plans.registry import query, r, rounded, spread, table
from labspark.sources.readers import dataset_profile
from labspark.tables import written

# The label of the customers, whether an order is dearer than 450,000, is made from no feature; it must be learnt from these.
FEATURES = ["c_acctbal", "n_orders", "mean_price", "min_price"]


def _lab_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lab events of the ordering customer: flag A is creatinine, R glucose."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate",
        "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("subject_id"), F.col("l_returnflag").alias("itemid"),
        F.col("l_quantity").alias("valuenum"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("charttime"))


_wide_sql = """
l AS (SELECT o_custkey AS subject_id, l_returnflag AS item, l_quantity AS v,
        struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_extendedprice) AS t
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT subject_id, avg(v) FILTER (WHERE item = 'A') AS cre,
        avg(v) FILTER (WHERE item = 'R') AS glu, arg_max(v, t) FILTER (WHERE item = 'R') AS last
      FROM l WHERE item IN ('A', 'R') GROUP BY 1),
w AS (SELECT c_custkey AS subject_id, c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN cre END AS cre,
        CASE WHEN c_custkey % 7 <> 0 THEN glu END AS glu, last
      FROM customer LEFT JOIN f ON f.subject_id = c_custkey)"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    patients = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_acctbal").alias("anchor_age"))
    features = learning.subject_features(
        _lab_events(spark, sf_dir), "charttime", creatinine="A", glucose="R")
    wide = learning.patient_wide(patients, features)
    key = F.col("subject_id")
    return wide.withColumns({
        "Creatinine_mean": F.when(key % 5 != 0, F.col("Creatinine_mean")),
        "GLU_mean": F.when(key % 7 != 0, F.col("GLU_mean"))})


@query("subject_wide_imputed", f"""
WITH {_wide_sql},
i AS (SELECT subject_id, coalesce(cre, (SELECT median(cre) FROM w)) AS cre,
        coalesce(glu, (SELECT median(glu) FROM w)) AS glu,
        coalesce(last, (SELECT median(last) FROM w)) AS last FROM w)
SELECT subject_id, round(cre, 6) AS "Creatinine_mean", round(glu, 6) AS "GLU_mean",
  last AS "GLU_latest", CAST(cre > 25 AS INTEGER) AS target FROM i""")
def subject_wide_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient wide table with lab features, median imputation and a threshold target."""
    full = learning.impute_medians(
        _wide(spark, sf_dir), ["Creatinine_mean", "GLU_mean", "GLU_latest"])
    return rounded(learning.with_target(full, threshold=25.0), "Creatinine_mean", "GLU_mean").select(
        "subject_id", "Creatinine_mean", "GLU_mean", "GLU_latest", "target")


@query("subject_coverage", f"""
WITH {_wide_sql}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE cre IS NOT NULL AND glu IS NOT NULL)
  AS n_complete FROM w""")
def subject_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.coverage(_wide(spark, sf_dir), ["Creatinine_mean", "GLU_mean"])


@query("load_profile", """
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_subjects,
  bool_or(event_type = 'view') AS has_view, bool_or(event_type = 'x') AS has_x FROM events""")
def load_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.load_profile(events(spark, sf_dir), "user_id", "event_type", ["view", "x"])


@query("dataset_profile", """
SELECT 'orders' AS dataset_name, count(*) AS row_count, 6 AS column_count,
  'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns
FROM orders""")
def dataset_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = dataset_profile(
        table(spark, sf_dir, "orders"), "orders", sf_dir, "2026-01-01 00:00:00")
    return profile.select(
        "dataset_name", "row_count", "column_count",
        F.array_join("columns", ",").alias("columns"))


@query("stratified_split_sizes", """
SELECT c_mktsegment, CAST(round(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_test,
  count(*) - CAST(round(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_train
FROM customer GROUP BY 1""")
def stratified_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact test and training sizes per class."""
    split = learning.stratified_split(
        table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"),
        "c_mktsegment", "c_custkey")
    return split.groupBy("c_mktsegment").agg(
        F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


@query("class_report", """
WITH c AS (SELECT CAST(quality AS DOUBLE) AS l, CAST((quality + toxic) % 2 AS DOUBLE) AS p
           FROM labels),
k AS (SELECT l AS class FROM c UNION SELECT p FROM c),
s AS (SELECT class, (SELECT count(*) FROM c WHERE l = class) AS support,
        (SELECT count(*) FROM c WHERE p = class) AS predicted,
        (SELECT count(*) FROM c WHERE p = class AND l = class) AS hits FROM k)
SELECT class, support, hits, round(hits / nullif(predicted, 0), 6) AS precision,
  round(hits / nullif(support, 0), 6) AS recall,
  round(2.0 * hits / (predicted + support), 6) AS f1 FROM s""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 per class from confusion counts."""
    rows = table(spark, sf_dir, "labels").select(
        "quality", ((F.col("quality") + F.col("toxic")) % 2).cast("double").alias("prediction"))
    return rounded(learning.class_report(rows, "quality"), "precision", "recall", "f1")


@query("fused_vectors", """
SELECT vec_id, len(embedding) + 1 AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, c_acctbal AS last
FROM embeddings JOIN customer ON c_custkey = vec_id""")
def fused_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and clinical columns of the same case, joined on the key."""
    clinical = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("vec_id"), "c_acctbal")
    fused = learning.fuse_vectors(
        table(spark, sf_dir, "embeddings"), clinical, "vec_id", "embedding", ["c_acctbal"])
    return fused.select(
        "vec_id", F.size("fused").alias("n"), r(F.col("fused")[0]).alias("first"),
        F.element_at("fused", -1).alias("last"))


# --------------------------------------------------------------------- training
# SQL derives what does not depend on the fit: split sizes, classes, the size of the most frequent class among
# the test rows, and that the model is right at least as often; metric values themselves are in the operators' tests.
_customers_sql = """SELECT c_custkey, c_acctbal, coalesce(n_orders, 0) AS n_orders, coalesce(mean_price, 0) AS mean_price,
    coalesce(min_price, 0) AS min_price, (coalesce(max_price, 0) > 450000)::INTEGER AS label
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS max_price,
    avg(o_totalprice) AS mean_price, min(o_totalprice) AS min_price FROM orders GROUP BY 1) ON c_custkey = o_custkey"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, those without orders with zeros."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"),
        F.min("o_totalprice").alias("min_price"))
    return table(spark, sf_dir, "customer").join(
        orders, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(
        0.0, ["n_orders", "mean_price", "max_price", "min_price"]).withColumn(
        "label", (F.col("max_price") > 450000).cast("int"))


def _split_sql(labels: str) -> str:
    """Sizes of the stratified split of the labelled rows ``labels`` (a query with a column label)."""
    return f"""WITH c AS (SELECT label, count(*) AS n FROM ({labels}) WHERE label IS NOT NULL GROUP BY 1)
SELECT CAST(sum(n - round(n * CAST(0.2 AS DOUBLE))) AS BIGINT) AS n_train,
  CAST(sum(round(n * CAST(0.2 AS DOUBLE))) AS BIGINT) AS n_test, count(*) AS n_classes,
  CAST(max(round(n * CAST(0.2 AS DOUBLE))) AS BIGINT) AS n_majority, TRUE AS reaches_majority FROM c"""


def _trained(rows: DataFrame, label: str, key: str, stages: list, scored: str | None = None) -> DataFrame:
    """Fit on the training rows of a stratified split, and score the test rows against their majority."""
    split = written(learning.stratified_split(rows.filter(F.col(label).isNotNull()), label, key), "split")
    model = learning.fit(split.filter("not is_test"), stages)
    test = split.filter("is_test")
    metrics = learning.classification_metrics(model.transform(test), scored or label)
    sizes = split.agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"),
        F.count_distinct(label).alias("n_classes"))
    reaches = (F.col("n_rows") == F.col("n_test")) & (F.col("accuracy") >= F.col("majority_share"))
    # one row each
    return sizes.crossJoin(metrics).crossJoin(learning.majority_share(test, label)).select(
        "n_train", "n_test", "n_classes", "n_majority", reaches.alias("reaches_majority"))


@query("train_forest", _split_sql(_customers_sql))
def train_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest of 100 trees on a stratified split."""
    return _trained(_customers(spark, sf_dir), "label", "c_custkey",
                    learning.classification_stages(FEATURES, "label", "forest"))


@query("train_boosted", _split_sql(_customers_sql))
def train_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees (50 rounds, depth 4)."""
    return _trained(_customers(spark, sf_dir), "label", "c_custkey",
                    learning.classification_stages(FEATURES, "label", "boosted"))


@query("train_regression", """SELECT count(*) FILTER (WHERE c_custkey % 5 <> 0) AS n_train,
  count(*) FILTER (WHERE c_custkey % 5 = 0) AS n_test, TRUE AS beats_mean, TRUE AS beats_linear FROM customer""")
def train_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest regression on a fifth that is held out, against a linear model.

    The target, how far a balance is from the middle times the number of orders, is no line in the features.
    """
    features, target = ["c_acctbal", "n_orders", "max_price"], "exposure"
    rows = written(_customers(spark, sf_dir).withColumns({
        "is_test": F.col("c_custkey") % 5 == 0, target: F.abs(F.col("c_acctbal") - 4500) * F.col("n_orders")}), "customers")
    train, test = rows.filter("not is_test"), rows.filter("is_test")
    forest = learning.fit(train, learning.regression_stages(features, target))
    linear = learning.fit(train, learning.linear_stages(features, target))
    found, baseline = (learning.regression_metrics(m.transform(test), target)["R2"] for m in (forest, linear))
    return rows.agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"),
                    F.lit(found > 0).alias("beats_mean"), F.lit(found >= baseline).alias("beats_linear"))


@query("feature_importance", f"""
WITH c AS ({_customers_sql}),
k AS (SELECT unnest([{{'f': 'c_acctbal', 'r': abs(corr(c_acctbal, label))}}, {{'f': 'n_orders', 'r': abs(corr(n_orders, label))}},
  {{'f': 'mean_price', 'r': abs(corr(mean_price, label))}}, {{'f': 'min_price', 'r': abs(corr(min_price, label))}}]) AS e FROM c)
SELECT arg_max(e.f, e.r) AS top_feature, count(*) AS n, CAST(1 AS DOUBLE) AS total FROM k""")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked importances of a forest: they sum to 1, and the feature that correlates best with the label leads."""
    split = learning.stratified_split(_customers(spark, sf_dir), "label", "c_custkey")
    model = learning.fit(split.filter("not is_test"), learning.classification_stages(FEATURES, "label"))
    return learning.importance_table(model.stages[-1], FEATURES, split).agg(
        F.max_by("feature", "importance").alias("top_feature"), F.count(F.lit(1)).alias("n"),
        r(F.sum("importance")).alias("total"))


@query("train_clusters", """SELECT CAST(3 AS BIGINT) AS n_clusters, count(*) AS n_rows,
  CAST(10 AS BIGINT) AS n_starts, TRUE AS least_cost, TRUE AS cost_of_rows FROM customer""")
def train_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means on standardised features, the best of ten starts: no start has a lower cost, and the cost is that of
    the rows in their clusters."""
    rows = _customers(spark, sf_dir)
    model, costs = learning.fit_clusters(rows, FEATURES, 3)
    best = learning.cluster_centres(model, FEATURES, rows)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.stages[-1].clusterCenters()])
    squares = F.zip_with(vector_to_array("features"), F.get(centres, F.col("prediction")), lambda a, b: (a - b) * (a - b))
    spent = model.transform(rows).agg(F.sum(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b)).alias("spent"))
    # one row each
    return best.agg(
        F.count_distinct("prediction").alias("n_clusters"), F.sum("size").cast("long").alias("n_rows"),
        F.max("inertia").alias("inertia")).crossJoin(spent).select(
        "n_clusters", "n_rows", F.lit(len(costs)).cast("long").alias("n_starts"),
        (F.col("inertia") <= min(costs)).alias("least_cost"),
        (F.abs(F.col("spent") - F.col("inertia")) <= 1e-6 * F.col("inertia")).alias("cost_of_rows"))


@query("trajectory_clusters", """SELECT CAST(3 AS BIGINT) AS n_clusters,
  count(DISTINCT user_id) AS n_patients FROM events WHERE value IS NOT NULL""")
def trajectory_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients clustered by trajectory: every patient is in one of three clusters."""
    clustered = learning.cluster_trajectories(
        events(spark, sf_dir), "user_id", "value", ["ts", "event_id"])
    return learning.cluster_summary(clustered).agg(
        F.count_distinct("cluster_id").alias("n_clusters"), F.sum("patient_count").alias("n_patients"))


@query("train_kidney_risk", _split_sql("""SELECT (avg(l_quantity) > 25.0)::INTEGER AS label
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'A' GROUP BY c_custkey"""))
def train_kidney_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kidney-risk model: imputation, assembly and boosted trees in one pipeline.

    The target comes from all of a patient's creatinine values, the features from the first three lines of each order:
    the model sees a part of what it must foretell, and no copy of it.
    """
    events_ = _lab_events(spark, sf_dir)
    early = learning.subject_features(
        events_.filter(F.col("charttime.l_linenumber") <= 3), "charttime", creatinine="A", glucose="R")
    target = events_.filter("itemid = 'A'").groupBy("subject_id").agg(
        (F.avg("valuenum") > 25.0).cast("int").alias("target"))
    patients = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_acctbal").alias("anchor_age")).join(target, "subject_id")
    return _trained(learning.patient_wide(patients, early), "target", "subject_id", learning.kidney_risk_stages())


@query("train_text_classifier", _split_sql("SELECT lang AS label FROM documents"))
def train_text_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character n-gram TF-IDF with linear support vector machines: language of documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return _trained(docs, "lang", "doc_id", learning.text_stages("text", "lang"), "label_index")


@query("train_network", _split_sql("""SELECT (list_sum(list_transform(embedding[:32], lambda x: CAST(x AS DOUBLE))) >
  list_sum(list_transform(embedding[33:], lambda x: CAST(x AS DOUBLE))))::INTEGER AS label FROM embeddings"""))
def train_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hidden-layer network on standardised vectors: which half of a vector has the greater sum.

    The table's own labels are mostly noise; this label takes all entries together.
    """
    values = F.col("embedding").cast("array<double>")

    def total(start: int) -> Column:
        return F.aggregate(F.slice(values, start, 32), F.lit(0.0), lambda a, x: a + x)

    vectors = learning.as_vector(table(spark, sf_dir, "embeddings").select(
        "vec_id", values.alias("values"), (total(1) > total(33)).cast("int").alias("label")), "values")
    return _trained(vectors, "label", "vec_id", learning.network_stages(64, 2))
