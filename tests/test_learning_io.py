import gzip
import json
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import IDF, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labspark import catalog, schemas
from labspark.operators import grams, learning, machines, reports
from labspark.sources import dictionaries, readers, writers
from labspark.streaming import gate


# -------------------------------------------------------------------------------- learning
@pytest.fixture(scope="module")
def points(spark):
    return spark.range(400).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"),
        (F.col("id") % 10 > 4).cast("int").alias("label")).cache()


def test_subject_features_and_imputation(spark):
    labs = spark.createDataFrame([
        (1, 50912, 1.0, 1), (1, 50912, 2.0, 2), (1, 50931, 100.0, 1), (1, 50931, 90.0, 3),
        (1, 50931, None, 4), (2, 50912, 0.5, 1), (3, 1, 5.0, 1)],
        "subject_id long, itemid int, valuenum double, charttime int")
    patients = spark.createDataFrame([(1, 60), (2, 50), (3, 40)], "subject_id long, anchor_age int")
    wide = learning.patient_wide(patients, learning.subject_features(labs, "charttime"))
    assert learning.coverage(wide, ["Creatinine_mean", "GLU_mean"]).first()["n_complete"] == 1
    full = {r["subject_id"]: r for r in learning.with_target(learning.impute_medians(
        wide, ["Creatinine_mean", "GLU_mean", "GLU_latest"])).collect()}
    assert (full[1]["Creatinine_mean"], full[1]["GLU_latest"], full[1]["target"]) == (1.5, 90.0, 1)
    assert (full[3]["Creatinine_mean"], full[3]["GLU_mean"], full[3]["target"]) == (1.0, 95.0, 0)
    profile = learning.load_profile(labs, "subject_id", "itemid", [50912, 7]).first()
    assert (profile["n_rows"], profile["n_subjects"], profile["has_50912"], profile["has_7"]) == (
        7, 3, True, False)


@pytest.mark.parametrize("algorithm", ["forest", "boosted"])
def test_classification(points, algorithm, tmp_path):
    split = learning.stratified_split(points, "label", "id")
    stages = learning.classification_stages(["x", "y"], "label", algorithm)
    if algorithm == "forest":
        stages[-1].setNumTrees(10)
    else:
        stages[-1].setMaxIter(5)
    model = learning.fit(split.filter("not is_test"), stages)
    predictions = model.transform(split.filter("is_test"))
    metrics = learning.classification_metrics(predictions, "label").first()
    assert metrics["accuracy"] > 0.95 and metrics["weighted_f1"] > 0.95
    ranked = learning.importance_table(model.stages[-1], ["x", "y"], points).collect()
    assert ranked[0]["feature"] == "x"
    writers.save_model(model, str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(split.filter("is_test"))
    assert learning.classification_metrics(again, "label").first() == metrics


def test_class_report(spark):
    df = spark.createDataFrame([(0, 0.0)] * 3 + [(0, 1.0)] + [(1, 1.0)] * 2 + [(2, 0.0)],
                               "label int, prediction double")
    got = {r["class"]: r for r in learning.class_report(df, "label").collect()}
    assert (got[0.0]["precision"], got[0.0]["recall"]) == (0.75, 0.75)
    assert (got[2.0]["precision"], got[2.0]["recall"], got[2.0]["f1"]) == (0.0, 0.0, 0.0)
    total = learning.classification_metrics(df, "label").first()
    assert total["accuracy"] == pytest.approx(5 / 7)
    assert total["weighted_f1"] == pytest.approx((0.75 * 4 + 0.8 * 2) / 7)


def test_regression_clustering_network_text(spark, points):
    stages = learning.regression_stages(["x", "y"], "x")
    stages[-1].setNumTrees(10)
    model = learning.fit(points, stages)
    assert learning.regression_metrics(model.transform(points), "x")["R2"] > 0.9
    clusters = learning.fit(points, learning.clustering_stages(["x", "y"], 3))
    centres = learning.cluster_centres(clusters, ["x", "y"], points).collect()
    assert sum(r["size"] for r in centres) == 400 and len(centres) == 3
    vectors = learning.as_vector(points.withColumn("a", F.array("x", "y")), "a")
    stages = learning.network_stages(2, 2)
    predictions = learning.fit(vectors, stages).transform(vectors)
    assert learning.classification_metrics(predictions, "label").first()["accuracy"] > 0.9
    texts = spark.createDataFrame(
        [("咳嗽发热" * (i % 3 + 1), "a") if i % 2 else ("腹痛呕吐" * (i % 3 + 1), "b")
         for i in range(40)], "t string, diagnosis string")
    model = learning.fit(texts, learning.text_stages("t", "diagnosis", 100))
    assert learning.classification_metrics(
        model.transform(texts), "label_index").first()["accuracy"] == 1.0


def test_char_grams_equal_brute_force(spark, monkeypatch):
    """Counts of grams of whole texts, over slices, with texts shorter than a gram and characters beyond 16 bits."""
    monkeypatch.setattr(grams, "SLICE_TEXTS", 3)
    monkeypatch.setattr(grams, "SLICE_CHARS", 40)
    texts = ["Abab", "", None, "x", "ab", "\U0001f600a\U0001f600", "a\x00b", "ÄÖ äö", "abc" * 30, "abab"] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)

    def counted(text):
        text = (text or "").lower()
        return Counter(text[i:i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1))

    def number(gram):
        return sum((ord(c) + 1) << (21 * i) for i, c in enumerate(reversed(gram)))

    total = sum(map(counted, texts), Counter())
    for size in (7, 10_000):
        wanted = sorted(total, key=lambda g: (-total[g], number(g)))[:size]
        model = grams.CharGrams(text="t", out="counts", vocabulary=size).fit(rows)
        assert model.getOrDefault("grams") == [number(g) for g in wanted]
        found = {r["id"]: r["counts"] for r in model.transform(rows.withColumn("more", F.lit("m"))).collect()}
        for i, text in enumerate(texts):
            vector = found[i]
            assert vector.size == len(wanted)
            got = {wanted[k]: v for k, v in zip(vector.indices, vector.values)}
            assert got == {g: n for g, n in counted(text).items() if g in set(wanted)}
    with pytest.raises(ValueError):
        grams.CharGrams(text="t", out="counts", vocabulary=5).fit(rows.filter("t = ''"))


def test_text_stages_count_grams_once(spark, tmp_path):
    """Stages after the counting read a table, and do not make grams of the texts again."""
    texts = spark.createDataFrame([("ab" * (i % 3 + 1), "a") if i % 2 else ("cd", "b") for i in range(20)], "t string, k string")
    model = learning.fit(texts, learning.text_stages("t", "k", 50))
    plan = model.transform(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "NGram" not in plan and "split(" not in plan and "lower(" not in plan
    writers.save_model(model, str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert again.transform(texts).filter("prediction = label_index").count() == 20


def test_gram_places(spark):
    """Every gram is found at its place, also when slots are shared, and other numbers at none."""
    rng = random.Random(5)
    numbers = rng.sample(range(1, 1 << 63), 5000)
    find = grams._finder(numbers[:4000])
    assert find(np.array(numbers, np.int64)).tolist() == [*range(4000), *[4000] * 1000]
    assert grams._finder([7])(np.array([7, 8, 7], np.int64)).tolist() == [0, 1, 0]


def test_machines_equal_mllib(spark, monkeypatch):
    """The machines of MLlib's one-against-rest, for rows with large counts, dense and empty vectors, and a constant column."""
    monkeypatch.setattr(machines, "CELLS", 50)  # blocks of four rows
    monkeypatch.setattr(machines, "IN_STEP", 2)
    monkeypatch.setattr(machines, "FEW_SUMS", 2)
    rng = random.Random(3)
    rows = []
    for i in range(300):
        kind = rng.randrange(3)
        counts = [float(rng.choice([0, 0, 1, 2, 3 + 4 * (j % 3 == kind), 254, 255, 70_000][:8 if i % 40 == 0 else 5])) for j in range(11)]
        counts = [*counts, 0.0] if i else [0.0] * 12
        full = Vectors.dense(counts)
        rows.append((float(kind if rng.random() < 0.8 else rng.randrange(3)), full if i % 2 else Vectors.sparse(12, [
            (j, c) for j, c in enumerate(counts) if c])))
    df = spark.createDataFrame(rows, ["label_index", "counts"]).repartition(5)
    model = machines.CountMachines(counts="counts", label="label_index", iterations=8).fit(df)
    features = Normalizer(inputCol="weighted", outputCol="features").transform(
        IDF(inputCol="counts", outputCol="weighted").fit(df).transform(df))
    wanted = OneVsRest(classifier=LinearSVC(maxIter=8), labelCol="label_index").fit(features)
    for got, known in zip(model.stages[-1].models, wanted.models, strict=True):
        assert got.coefficients.toArray() == pytest.approx(known.coefficients.toArray(), rel=1e-6, abs=1e-9)
        assert got.intercept == pytest.approx(known.intercept, rel=1e-6)
    assert [r["prediction"] for r in model.transform(df).collect()] == [
        r["prediction"] for r in wanted.transform(features).collect()]
    with pytest.raises(Exception, match="whole numbers"):
        machines.CountMachines(counts="counts", label="label_index", iterations=1).fit(
            spark.createDataFrame([(0.0, Vectors.dense([0.5, 1.0])), (1.0, Vectors.dense([1.0, 0.0]))], ["label_index", "counts"]))


def test_text_machines_keep_no_vectors_in_memory(spark, monkeypatch):
    """No table is kept in the executors' memory, and classes are fitted by the same jobs: their number doesn't grow with them."""
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda *_: pytest.fail("kept in memory"))
    jobs = []
    for classes in (2, 8):
        texts = spark.createDataFrame([("abcdefgh"[i % classes] * (i % 5 + 1), str(i % classes)) for i in range(80)], "t string, k string")
        spark.sparkContext.setJobGroup(f"classes-{classes}", "")
        learning.fit(texts, learning.text_stages("t", "k", 50))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"classes-{classes}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] < 2 * jobs[0]


def test_kidney_risk(points):
    df = points.select(F.col("id").alias("anchor_age"), F.col("x").alias("GLU_mean"),
                       F.when(F.col("y") > 0, F.col("y")).alias("GLU_latest"),
                       F.col("x").alias("Creatinine_mean"), F.col("label").alias("target"))
    stages = learning.kidney_risk_stages()
    stages[-1].setMaxIter(3)
    assert learning.fit(df, stages).transform(df).filter("prediction = target").count() == 400


def test_trajectory_clusters(spark):
    rows = [(p, t, 50.0 + (p % 3 - 1) * 5.0 * t + p * 0.01) for p in range(30) for t in range(5)]
    df = spark.createDataFrame(rows, "p int, t int, v double")
    clustered = learning.cluster_trajectories(df, "p", "v", ["t"])
    summary = learning.cluster_summary(clustered).collect()
    assert [r["patient_count"] for r in summary] == [10, 10, 10]
    assert [r["label"] for r in summary] == ["快速恶化/上升亚型", "平稳控制亚型", "治疗改善/下降亚型"]
    assert [round(r["mean_slope"], 6) for r in summary] == [5.0, 0.0, -5.0]
    with pytest.raises(ValueError):
        learning.cluster_trajectories(df.filter("p < 2"), "p", "v", ["t"])


def test_attributions(spark):
    df = spark.createDataFrame([("p", {"a": 0.1, "b": -0.5, "c": 0.3})], "k string, m map<string,double>")
    ranked = learning.ranked_attributions(df, "k", "m", 2)
    assert [(r["name"], r["importance"], r["contribution"]) for r in ranked.orderBy("place").collect()] == [
        ("b", 0.5, -0.5), ("c", 0.3, 0.3)]
    assert learning.top_factors_line(ranked, "k").first()["top_factors"] == "b -0.5000, c 0.3000"


def test_fused_vectors(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "k int, e array<float>")
    b = spark.createDataFrame([(1, 60.0)], "k int, age double")
    got = learning.fuse_vectors(a, b, "k", "e", ["age"]).collect()
    assert len(got) == 1 and got[0]["fused"] == [1.0, 2.0, 60.0]


# ---------------------------------------------------------------------------------- reports
def test_model_list_and_records(spark):
    when = datetime(2026, 1, 1)
    task, result = reports.task_records(
        spark, "t1", "m1", "risk", "classification", "forest", "target", ["a"], {"n": 1},
        {"accuracy": 0.5}, 0.6, 0.5, "/models/m1", when)
    listed = reports.list_models(result, task).collect()
    assert [r["model_id"] for r in listed] == [
        "m1", "builtin_model_A", "builtin_model_B", "builtin_model_C"]
    assert (listed[0]["algorithm"], listed[0]["source"]) == ("forest", "database")
    assert json.loads(listed[0]["metric_json"]) == {"accuracy": 0.5}
    assert reports.list_models(result, task, False).count() == 1


def test_report_header_and_sink(spark, tmp_path):
    cases = spark.createDataFrame(
        [("c1", "p1", "diabetes", ["DataQualityWarning: x"]), ("c2", "p2", "?", None)],
        "case_id string, patient_id string, primary_disease string, quality_warnings array<string>")
    header = reports.report_header(cases)
    got = {r["case_id"]: r for r in header.collect()}
    assert got["c1"]["report_kind"] == "data_missing" and got["c2"]["report_kind"] == "disease"
    assert got["c2"]["report_title"] == catalog.DISEASE_MARKERS["default"]["title"]
    writers.write_reports(header, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 2 and {r[0] for r in back.select("report_kind").collect()} == {
        "data_missing", "disease"}


# ---------------------------------------------------------------------------------- sources
def test_table_readers(spark, tmp_path):
    csv = tmp_path / "labs.csv"
    csv.write_text("item_name,value\nGLU,7.8\nWBC,x\n", encoding="utf-8")
    assert readers.read_table(spark, str(csv), "item_name string, value string").count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "labs.xlsx"))
    for name, payload, count in (
            ("list", [{"item_name": "A", "value": 1}, {"item_name": "B", "value": 2}], 2),
            ("labs", {"patient": "p", "labs": [{"item_name": "A", "value": 1}]}, 1),
            ("single", {"item_name": "A", "value": 1}, 1)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(payload, indent=1), encoding="utf-8")
        for schema in (None, "item_name string, value int"):
            got = readers.read_table(spark, str(path), schema)
            assert got.count() == count and got.orderBy("item_name").first()["value"] == 1


def test_gzip_fallback_and_columns(spark, tmp_path):
    with gzip.open(tmp_path / "e.csv.gz", "wt") as f:
        f.write("subject_id,itemid,valuenum\n1,50912,1.5\n")
    path = str(tmp_path / "e.csv")
    df = readers.read_csv_or_gzip(spark, path, ["subject_id", "itemid", "valuenum"])
    assert df.first()["valuenum"] == 1.5
    with pytest.raises(ValueError, match="anchor_age"):
        readers.read_csv_or_gzip(spark, path, ["anchor_age"])
    expected = spark.createDataFrame([(50912,), (50931,)], "itemid int")
    assert [r[0] for r in readers.absent_codes(df, "itemid", expected).collect()] == [50931]


def test_notes_keyed_json_dialogues(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "p1.txt").write_text("GLU 7.8\nline", encoding="utf-8")
    got = readers.read_notes(spark, str(tmp_path / "notes")).collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [("p1", "GLU 7.8\nline")]
    keyed = tmp_path / "keyed.json"
    keyed.write_text(json.dumps({"c1": {"texture_mean": 1.5}, "c2": {"area_mean": 2}}), "utf-8")
    rows = {r["case_id"]: r for r in readers.read_keyed_json(
        spark, str(keyed), schemas.RADIOMICS_FEATURES).collect()}
    assert rows["c1"]["texture_mean"] == 1.5 and rows["c2"]["texture_mean"] is None
    dialogue = tmp_path / "d.json"
    dialogue.write_text(json.dumps({
        "1": {"self_report": " cough ", "diagnosis": "flu"}, "2": {"self_report": "　"},
        "3": "broken"}), "utf-8")
    talks = readers.read_dialogues(spark, str(dialogue))
    assert talks.filter("kept").first()["self_report"] == "cough"
    assert readers.dialogue_counts(talks).first()["skipped"] == 2


def test_profile_and_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    path = str(tmp_path / "datasets")
    for _ in range(2):
        writers.append_rows(readers.dataset_profile(df, "d", "upload", datetime(2026, 1, 1)), path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 and (rows[0]["row_count"], rows[0]["columns"]) == (2, ["id", "s"])


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"fields": {"A": {
        "alias_names": ["x"], "reference_range": {"low": 1, "high": 2},
        "disease_relevance_matrix": {"d": {"weight": 0.9, "is_core": True}}}}}), "utf-8")
    row = dictionaries.load_fields(spark, str(tmp_path / "f.json")).first()
    assert (row["standard_name"], row["reference_range"]) == ("A", "1-2")
    assert row["relevance"]["d"]["weight"] == 0.9
    (tmp_path / "r.json").write_text(json.dumps({"A": {"reference_low": 1, "reference_high": 2}}))
    assert dictionaries.load_ranges(spark, str(tmp_path / "r.json")).first()["critical_low"] is None
    (tmp_path / "u.json").write_text(json.dumps({"A": {"g": 1, "kg": 1000, "standard_unit": "g"}}))
    assert dictionaries.load_units(spark, str(tmp_path / "u.json")).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"models": {"M": {
        "model_id": "M", "model_name": "m", "version": "1", "modality_sensitivity": {},
        "required_modalities": {"time_series_steps": {"min": 2}}}}}))
    model = dictionaries.load_registry(str(tmp_path / "m.json"))[0]
    assert (model["ts_min"], model["sens_ts"], model["f1"]) == (2, 0.5, {})


# -------------------------------------------------------------------------------- streaming
def test_gate_fold(spark):
    rows = [("s", b) for b, n in enumerate((10, 30, 20, 60)) for _ in range(n)] + [("t", 0)] * 3
    got = {r["src"]: r for r in gate.gate_batches(
        spark.createDataFrame(rows, "src string, b int"), "src", "b").collect()}
    assert (got["s"]["fires"], got["s"]["counter"], got["s"]["n_rows"]) == (2, 0, 120)
    assert (got["t"]["fires"], got["t"]["counter"]) == (0, 3)


def test_gate_stream(spark, tmp_path):
    source, fired = tmp_path / "in", []
    counter = gate.SampleGate(spark, str(tmp_path / "state"), fired.append)
    for n in (10, 30, 20, 60):
        spark.range(n).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long").parquet(str(source))
        counter.start(stream, str(tmp_path / "ckpt")).awaitTermination()
    assert fired == [2, 3]
    states = {r["batch_id"]: (r["counter"], r["fires"]) for r in counter.state().collect()}
    assert states == {2: (0, 1), 3: (0, 2)}
    counter.process(spark.range(500), 3)  # a replayed batch changes nothing
    assert fired == [2, 3]


def test_gate_with_keyed_state_survives_restarts(spark, tmp_path):
    """Any cut of the rows into arrivals, also within a batch, gives what the batch form gives."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), day, i) for day in range(12) for i in range(rng.randrange(60))]
    df = spark.createDataFrame(rows, "src string, day int, i int")
    want = {r["src"]: tuple(r)[1:] for r in gate.gate_batches(df, "src", "day", 40).collect()}
    cuts = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    for start, end in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[start:end], df.schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        gate.run_gate(stream, "src", "day", str(tmp_path / "gate"), 40).awaitTermination()
    gate.run_gate(stream, "src", "day", str(tmp_path / "gate"), 40).awaitTermination()  # nothing new
    assert {r["source"]: tuple(r)[1:] for r in gate.gate_states(spark, str(tmp_path / "gate")).collect()} == want


def test_gate_announces_again_after_a_crash(spark, tmp_path):
    calls = []

    def fail_once(batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("crash")

    counter = gate.SampleGate(spark, str(tmp_path), fail_once, threshold=10)
    with pytest.raises(RuntimeError):
        counter.process(spark.range(12), 0)
    counter.process(spark.range(12), 0)  # the replay announces, and counts nothing twice
    counter.process(spark.range(3), 1)
    assert calls == [0, 0]
    last = counter.state().orderBy(F.desc("batch_id")).first()
    assert (last["batch_id"], last["counter"], last["fires"]) == (1, 3, 1)


def test_score_refresh(spark):
    predictions = spark.createDataFrame(
        [("Model_A_TimeSeries", 1, 1.0)] * 9 + [("Model_A_TimeSeries", 1, 0.0)]
        + [("Model_B_NLP_Graph", 1, 0.0)] * 3 + [("Model_C_Multimodal", 1, 1.0)] * 3,
        "model_id string, label int, prediction double")
    config = catalog.config_table(spark).filter("key != 'model_c_base_score'").withColumn(
        "value", F.when(F.col("key").startswith("new"), 77.0).otherwise(F.col("value")))
    got = {r["key"]: r for r in gate.refresh_config(config, predictions, "2026-01-02").collect()}
    assert got["model_a_base_score"]["value"] == 90.0
    assert got["model_b_base_score"]["value"] == 60.0
    assert got["model_c_base_score"]["value"] == 99.0
    assert got["new_samples_since_last_ct"]["value"] == 0.0
    assert got["ct_trigger_threshold"]["value"] == 50.0
    assert got["ct_trigger_threshold"]["updated_at"] is None


def test_best_of_ten_starts(spark):
    rng = random.Random(2)
    rows = [(float(c % 4) * 5 + rng.gauss(0, 0.4), float(c // 4) * 5 + rng.gauss(0, 0.4)) for c in range(12) for _ in range(25)]
    points = spark.createDataFrame(rows, "x double, y double")
    model, costs = learning.fit_clusters(points, ["x", "y"], 12, starts=4)
    assert len(costs) == 4 and model.stages[-1].summary.trainingCost == min(costs)
    assert model.transform(points).select("prediction").distinct().count() == 12


def test_report_bodies_are_written_in_order(spark, tmp_path):
    cases = spark.createDataFrame([(1, "p1", "diabetes"), (2, "p2", None)], "case_id int, patient_id string, primary_disease string")
    labs = spark.createDataFrame([(1, m, float(v), "normal", v) for v in range(40) for m in ("GLU", "ALT")] + [(2, "ALT", 1.0, "high", 0)],
                                 "case_id int, standard_item_name string, value double, abnormal_flag string, t int")
    predictions = spark.createDataFrame([(1, "risk", 0.7, None)], "case_id int, prediction string, probability double, model_reason string")
    weights = spark.createDataFrame([(1, {"a": -2.0, "b": 1.0, "c": 0.5})], "case_id int, contributions map<string,double>")
    lines = reports.report_body(labs, cases, catalog.marker_table(spark), ["t"], predictions, weights, top=2)
    writers.write_report_bodies(lines.repartition(5), str(tmp_path / "reports"))
    written_ = []
    for file in sorted((tmp_path / "reports").glob("part-*.json")):
        written_ += [json.loads(x) for x in file.read_text(encoding="utf-8").splitlines()]
    places = [(r["case_id"], r["section_no"], r["line_no"]) for r in written_]
    assert places == sorted(places) and len(set(places)) == len(places) == lines.count()
    one = [r for r in written_ if r["case_id"] == 1]
    core = [(r["name"], r["number"]) for r in one if r["section"] == "core"]
    assert core == [("GLU", float(v)) for v in range(40)]
    assert [(r["line_no"], r["name"], r["number"]) for r in one if r["section"] == "importance"] == [(0, "a", -2.0), (1, "b", 1.0)]
    assert [(r["name"], r.get("text"), r.get("number")) for r in one if r["section"] == "prediction"] == [
        ("prediction", "risk", None), ("probability", None, 0.7)]
    assert [r["section"] for r in written_ if r["case_id"] == 2] == ["header"] * 3 + ["appendix"]
