"""Feature tables, splits, MLlib pipelines and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.catalog import CREATININE_THRESHOLD, ITEM_CREATININE, ITEM_GLUCOSE
from labspark.functions.values import trajectory_label
from labspark.operators.grams import CharGrams
from labspark.operators.machines import CountMachines
from labspark.operators.ordering import MAX_GROUP_ROWS, column_quantiles, with_positions
from labspark.operators.trends import trajectory_features
from labspark.session import checkpoint_folder
from labspark.tables import written

SEED = 42
MAX_CLASSES = 10_000
#: Starts of a clustering, of which the one with the least cost stays.
STARTS = 10
TEST_SHARE = 0.2


# ---------------------------------------------------------------------------------------
# Feature tables
# ---------------------------------------------------------------------------------------
def subject_features(labs: DataFrame, order: str, subject: str = "subject_id",
                     item: str = "itemid", value: str = "valuenum",
                     creatinine: object = ITEM_CREATININE,
                     glucose: object = ITEM_GLUCOSE) -> DataFrame:
    """Mean creatinine, mean glucose and last glucose (by ``order``) of every subject."""
    wanted = labs.filter(F.col(item).isin([creatinine, glucose]) & F.col(value).isNotNull())
    of_cre = F.when(F.col(item) == creatinine, F.col(value))
    of_glu = F.when(F.col(item) == glucose, F.col(value))
    return wanted.groupBy(subject).agg(
        F.avg(of_cre).alias("Creatinine_mean"), F.avg(of_glu).alias("GLU_mean"),
        F.max_by(of_glu, F.when(F.col(item) == glucose, F.col(order))).alias("GLU_latest"))


def patient_wide(patients: DataFrame, features: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Every patient with its lab features, nulls where there are none."""
    return patients.join(features, subject, "left")


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact column median (mean of the two middle values).

    The medians are a subquery of the result: no job runs before the result is asked for.
    """
    medians = column_quantiles(df, columns, [0.5]).agg(F.map_from_entries(F.collect_list(
        F.struct("variable", "q0"))).alias("of")).scalar()  # one entry per column
    filled = df.withColumn("__medians", medians)
    return filled.withColumns({c: F.coalesce(F.col(c), F.col("__medians")[c].cast(df.schema[c].dataType))
                               for c in columns}).drop("__medians")


def with_target(df: DataFrame, column: str = "Creatinine_mean",
                threshold: float = CREATININE_THRESHOLD, out: str = "target") -> DataFrame:
    return df.withColumn(out, F.coalesce((F.col(column) > threshold).cast("int"), F.lit(0)))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, most common first."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)


def load_profile(labs: DataFrame, subject: str, item: str, expected: Sequence) -> DataFrame:
    """Rows, distinct subjects and presence of the expected item codes, one row."""
    return labs.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(subject).alias("n_subjects"),
        *[F.coalesce(F.bool_or(F.col(item) == F.lit(e)), F.lit(False)).alias(f"has_{e}")
          for e in expected])


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows have all the features."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(complete).alias("n_complete"))


def fuse_vectors(radiomics: DataFrame, clinical: DataFrame, key: str, vector: str,
                 columns: Sequence[str], out: str = "fused") -> DataFrame:
    """Radiomics vectors and clinical columns of the same case as one array."""
    joined = radiomics.join(clinical.select(key, *columns), key)
    return joined.withColumn(out, F.concat(
        F.col(vector).cast("array<double>"),
        F.array(*[F.col(c).cast("double") for c in columns])))


# ---------------------------------------------------------------------------------------
# Splits
# ---------------------------------------------------------------------------------------
def stratified_split(df: DataFrame, label: str, id_column: str, test_share: float = TEST_SHARE,
                     seed: int = SEED, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Add ``is_test``: an exact share of every class, repeatable for the same ids and seed.

    Ids are drawn by hash.  Only (label, draw, id) is ordered, to find the last test id of each
    class; the rows themselves are compared with that cut where they are, and not shuffled.
    ``is_test`` is null for rows without a label, so neither side holds them.
    """
    draw = F.xxhash64(F.col(id_column), F.lit(seed))
    narrow = df.filter(F.col(label).isNotNull()).select(
        label, draw.alias("__draw"), F.col(id_column).alias("__id"))
    placed = with_positions(narrow, [label], ["__draw", "__id"], "__pos", max_group_rows)
    sizes = narrow.groupBy(label).agg(F.count(F.lit(1)).alias("__size"))
    few_classes = sizes.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES
    cuts = (
        placed.join(F.broadcast(sizes) if few_classes else sizes, label)
        .filter(F.col("__pos") == F.round(F.col("__size") * test_share) - 1)
        .select(F.col(label).alias("__label"), F.col("__draw").alias("__cut"),
                F.col("__id").alias("__last"))
    )
    chosen = (draw < F.col("__cut")) | (
        (draw == F.col("__cut")) & (F.col(id_column) <= F.col("__last")))
    return (
        df.join(F.broadcast(cuts) if few_classes else cuts, F.col(label) == F.col("__label"), "left")
        .withColumn("is_test", F.when(F.col(label).isNotNull(), F.coalesce(chosen, F.lit(False))))
        .drop("__label", "__cut", "__last")
    )


# ---------------------------------------------------------------------------------------
# Pipelines
# ---------------------------------------------------------------------------------------
def classification_stages(features: Sequence[str], label: str, algorithm: str = "forest") -> list:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features",
                                handleInvalid="skip")
    if algorithm == "boosted":
        model = GBTClassifier(labelCol=label, maxIter=50, maxDepth=4, stepSize=0.1, seed=SEED)
    else:
        model = RandomForestClassifier(labelCol=label, numTrees=100, seed=SEED)
    return [assembler, model]


def regression_stages(features: Sequence[str], label: str) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"),
        RandomForestRegressor(labelCol=label, numTrees=100, seed=SEED),
    ]


def linear_stages(features: Sequence[str], label: str) -> list:
    """The baseline that a regression model should reach."""
    return [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"),
            LinearRegression(labelCol=label)]


def clustering_stages(features: Sequence[str], k: int = 3) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="skip"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        KMeans(k=k, seed=SEED, maxIter=300),
    ]


def fit_clusters(train: DataFrame, features: Sequence[str], k: int = 3,
                 starts: int = STARTS) -> tuple[PipelineModel, list[float]]:
    """The best of several k-means fits by training cost, and the costs of all of them.

    The scaled vectors are written once; each start has a seed of its own and reads them.
    """
    *prepare, kmeans = clustering_stages(features, k)
    scaling = fit(train, prepare)
    scaled = written(scaling.transform(train).select("features"), "scaled")
    models = [kmeans.copy({kmeans.seed: SEED + i}).fit(scaled) for i in range(starts)]
    costs = [float(m.summary.trainingCost) for m in models]
    best = models[costs.index(min(costs))]
    return PipelineModel([*scaling.stages, best]), costs


def kidney_risk_stages(features: Sequence[str] = (
        "anchor_age", "GLU_mean", "GLU_latest", "Creatinine_mean"),
        label: str = "target") -> list:
    filled = [f"{f}_filled" for f in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
        GBTClassifier(labelCol=label, maxIter=50, maxDepth=4, stepSize=0.1, seed=SEED),
    ]


def text_stages(text: str, label: str, vocabulary: int = 3000) -> list:
    """Character 1-3-gram TF-IDF and a linear support vector machine per class.

    The machines are fitted in step, over a table of the counts: none holds the vectors in memory.
    """
    return [
        StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip"),
        CharGrams(text=text, out="counts", vocabulary=vocabulary),
        CountMachines(counts="counts", label="label_index", iterations=30),
    ]


def network_stages(size: int, classes: int, vector: str = "raw_features",
                   label: str = "label") -> list:
    return [
        StandardScaler(inputCol=vector, outputCol="features", withMean=True),
        MultilayerPerceptronClassifier(
            labelCol=label, layers=[size, 64, 32, classes], seed=SEED, maxIter=100),
    ]


def fit(train: DataFrame, stages: list) -> PipelineModel:
    """Fit a pipeline; boosting cuts its lineage in the session's checkpoint folder."""
    checkpoint_folder(train.sparkSession)
    return Pipeline(stages=stages).fit(train)


def as_vector(df: DataFrame, array: str, out: str = "raw_features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array)))


# ---------------------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------------------
def class_report(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from confusion counts."""
    confusion = predictions.groupBy(
        F.col(label).cast("double").alias("l"), F.col(prediction).cast("double").alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))
    # each confusion cell counts once for its label and once for its prediction
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )).alias("s")).select("s.*")
    totals = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"))
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return (
        totals.withColumn("precision", precision).withColumn("recall", recall)
        .withColumn("f1", F.coalesce(F.try_divide(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
            F.lit(0.0)))
        .select("class", "support", "hits", "precision", "recall", "f1")
    )


def majority_share(rows: DataFrame, label: str) -> DataFrame:
    """One row: how many rows have the most frequent label, and their share; what a model must reach."""
    return rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("n_majority"), (F.max("n") / F.sum("n")).alias("majority_share"))


def classification_metrics(predictions: DataFrame, label: str,
                           prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1, one row."""
    return class_report(predictions, label, prediction).agg(
        F.sum("support").alias("n_rows"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def regression_metrics(predictions: DataFrame, label: str) -> dict[str, float]:
    evaluator = RegressionEvaluator(labelCol=label)
    return {"MSE": evaluator.setMetricName("mse").evaluate(predictions),
            "R2": evaluator.setMetricName("r2").evaluate(predictions)}


def importance_table(model: Model, features: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, importance), most important first."""
    values = model.featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")


def ranked_attributions(df: DataFrame, key: str, attributions: str, top: int = 10) -> DataFrame:
    """The ``top`` attributions of each row's map by absolute value, as ranked rows."""
    entries = F.transform(F.map_entries(attributions), lambda e: F.struct(
        (-F.abs(e["value"])).alias("o"), e["key"].alias("name"), e["value"].alias("value")))
    ranked = F.slice(F.array_sort(entries), 1, top)
    return df.select(key, F.posexplode(ranked).alias("i", "e")).select(
        key, (F.col("i") + 1).alias("place"), F.col("e.name").alias("name"),
        F.round(F.abs("e.value"), 4).alias("importance"),
        F.round("e.value", 4).alias("contribution"))


def top_factors_line(ranked: DataFrame, key: str, top: int = 3) -> DataFrame:
    """One text line per key with its leading factors."""
    shown = ranked.filter(F.col("place") <= top)
    item = F.concat_ws(" ", "name", F.format_number("contribution", 4))
    return shown.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", item.alias("t")))), lambda s: s["t"]),
        ", ").alias("top_factors"))


# ---------------------------------------------------------------------------------------
# Trajectory clusters
# ---------------------------------------------------------------------------------------
TRAJECTORY_INPUTS = ("baseline_value", "latest_value", "slope", "std")


def cluster_trajectories(df: DataFrame, patient: str, value: str, order: Sequence[str],
                         k: int = 3, max_group_rows: int = MAX_GROUP_ROWS,
                         starts: int = STARTS) -> DataFrame:
    """Each patient's trajectory features with its cluster and the cluster's label.

    Fails when there are fewer patients than clusters.
    """
    features = trajectory_features(df, [patient], value, order, max_group_rows)
    rows = features.limit(k).count()
    if rows < k:
        raise ValueError(f"{rows} patients for {k} clusters")
    model, _ = fit_clusters(features, TRAJECTORY_INPUTS, k, starts)
    scaler, kmeans = model.stages[1], model.stages[2]
    spread = [s if s > 0 else 1.0 for s in scaler.std.toArray()]
    centres = [
        (i, *[float(c * s + m) for c, s, m in zip(centre, spread, scaler.mean.toArray())])
        for i, centre in enumerate(kmeans.clusterCenters())
    ]
    labels = df.sparkSession.createDataFrame(
        centres, "cluster_id int, c_baseline double, c_latest double, c_slope double, c_std double"
    ).select("cluster_id", trajectory_label(F.col("c_slope"), F.col("c_baseline")).alias("label"))
    return (
        model.transform(features).withColumnRenamed("prediction", "cluster_id")
        .join(F.broadcast(labels), "cluster_id")  # k rows
        .select(patient, "cluster_id", "label", *TRAJECTORY_INPUTS)
    )


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Size and mean slope, baseline and latest per cluster; members stay in the input table."""
    return clustered.groupBy("cluster_id", "label").agg(
        F.count(F.lit(1)).alias("patient_count"), F.avg("slope").alias("mean_slope"),
        F.avg("baseline_value").alias("avg_baseline"), F.avg("latest_value").alias("avg_latest")
    ).orderBy(F.desc("mean_slope"))


def cluster_centres(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Size of each cluster and its scaled centre for the first five features, with the inertia."""
    kmeans = model.stages[-1]
    sizes = model.transform(df).groupBy("prediction").agg(F.count(F.lit(1)).alias("size"))
    centres = df.sparkSession.createDataFrame(
        [(i, {f: round(float(v), 3) for f, v in list(zip(features, c))[:5]})
         for i, c in enumerate(kmeans.clusterCenters())],
        "prediction int, centre map<string, double>")
    return sizes.join(F.broadcast(centres), "prediction").withColumn(  # k rows
        "inertia", F.lit(float(kmeans.summary.trainingCost)))
