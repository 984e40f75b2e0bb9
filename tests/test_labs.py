import pytest
from pyspark.sql import functions as F

from labspark import catalog
from labspark.functions import values
from labspark.operators import dictionary, labs, trends
from labspark.plans.integration import Lookups, case_payload, decide_and_report, standardise


@pytest.fixture(scope="module")
def lookups(spark):
    return Lookups(spark)


@pytest.fixture(scope="module")
def standard(raw_labs, lookups):
    return standardise(raw_labs, lookups).cache()


@pytest.mark.parametrize("text,expected", [
    ("6.2", 6.2), (" 7 ", 7.0), ("1e3", 1000.0), ("1d", None), ("abc", None), ("NaN", None),
    ("", None), (None, None), ("-.5", -0.5)])
def test_to_number(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(values.to_number(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize("text,expected", [
    ("2026-01-05", "2026-01-05 00:00:00"), ("2026/1/5", "2026-01-05 00:00:00"),
    ("2026-01-05 10:20:30", "2026-01-05 10:20:30"), ("05.01.2026", None), (None, None)])
def test_parse_time(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(values.parse_time(F.col("t")).cast("string")).first()[0]
    assert got == expected


@pytest.mark.parametrize("text,low,high", [
    ("3.5-9.5", 3.5, 9.5), (">90", 90.0, 180.0), ("", 0.0, 100.0), (None, 0.0, 100.0),
    ("<5", 5.0, 10.0), ("4-x", 4.0, 100.0)])
def test_range_text(spark, text, low, high):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(values.range_low(F.col("t")), values.range_high(F.col("t"))).first()
    assert tuple(got) == (low, high)


@pytest.mark.parametrize("marker,value,flag", [
    ("GLU", 7.8, "high"), ("GLU", 17.0, "critical_high"), ("HGB", 59.0, "critical_low"),
    ("HGB", 100.0, "low"), ("HGB", None, "normal"), ("WBC", 6.1, "normal"),
    ("Creatinine", 180.0, "high"), ("HbA1c", 8.2, "high"), ("ALT", 41.0, "critical_high"),
    ("XYZ", 3.0, "normal")])
def test_flag(spark, lookups, marker, value, flag):
    df = spark.createDataFrame([(marker, value)], "standard_item_name string, value double")
    assert labs.with_flag(labs.with_reference(df, lookups.ranges)).first()["abnormal_flag"] == flag


@pytest.mark.parametrize("marker,value,unit,out,out_unit", [
    ("GLU", 140.0, "mg/dL", 7.77, "mmol/L"), ("Creatinine", 1.0, "mg/dL", 88.4, "μmol/L"),
    ("Creatinine", 88.0, "umol/L", 88.0, "μmol/L"), ("WBC", 6.1, "10^9/L", 6.1, "10^9/L"),
    ("GLU", 5.0, "stone", 5.0, "stone"), ("GLU", None, "mg/dL", None, "mg/dL")])
def test_unit_conversion(spark, lookups, marker, value, unit, out, out_unit):
    df = spark.createDataFrame(
        [(marker, value, unit)], "standard_item_name string, value double, unit string")
    got = labs.with_standard_unit(df, lookups.units).first()
    assert got["value"] == (pytest.approx(out) if out is not None else None)
    assert got["unit"] == out_unit


def test_unit_round_trip(spark, lookups):
    df = spark.createDataFrame([("GLU", 7.77, "mmol/L")],
                               "standard_item_name string, value double, unit string")
    got = labs.with_standard_unit(df, lookups.units).first()
    assert (got["value"], got["unit"]) == (7.77, "mmol/L")


@pytest.mark.parametrize("raw,name", [
    (" 血糖 ", "GLU"), ("GLUCOSE", "GLU"), ("Cr", "Creatinine"), ("WBC", "WBC"),
    ("unknown item ", "unknown item")])
def test_standard_name(spark, lookups, raw, name):
    df = spark.createDataFrame([(raw,)], "item_name string")
    assert labs.with_standard_name(df, lookups.aliases).first()["standard_item_name"] == name


def test_standard_labs(standard, rows):
    got = rows(standard, "ord")
    assert len(got) == 13
    assert {(r["item_name"], r["abnormal_flag"]) for r in got if r["case_id"] == "p001_c1"} == {
        ("GLU", "high"), ("HbA1c", "high"), ("WBC", "normal"), ("Creatinine", "normal")}
    assert str(min(r["test_time"] for r in got)) == "2026-01-01 00:00:00"


def test_missing_attributes_and_wide_layout(spark, lookups, rows):
    wide = spark.createDataFrame([("c1", "7.8", "x"), ("c2", "5.0", "6.0")],
                                 "case_id string, glu string, WBC string")
    got = rows(standardise(wide, lookups, patient_id="p9"), "case_id", "standard_item_name")
    assert [(r["case_id"], r["standard_item_name"], r["value"], r["unit"], r["patient_id"])
            for r in got] == [
        ("c1", "GLU", 7.8, "mmol/L", "p9"), ("c1", "WBC", None, "10^9/L", "p9"),
        ("c2", "GLU", 5.0, "mmol/L", "p9"), ("c2", "WBC", 6.0, "10^9/L", "p9")]


def test_flag_before_convert(spark, lookups):
    raw = spark.createDataFrame([("c", "GLU", "90", "mg/dL")],
                                "case_id string, item_name string, value string, unit string")
    assert standardise(raw, lookups).first()["abnormal_flag"] == "normal"
    assert standardise(raw, lookups, flag_before_convert=True).first()[
        "abnormal_flag"] == "critical_high"


def test_filter_case(raw_labs):
    assert labs.filter_case(raw_labs, "p002_c1").count() == 4
    assert labs.filter_case(raw_labs, None).count() == 13
    assert labs.filter_case(raw_labs.drop("case_id"), "p002_c1").count() == 13


def test_identity_inference(raw_labs, rows):
    assert labs.single_case_id(raw_labs).first()[0] is None
    assert labs.single_case_id(raw_labs.filter("patient_id = 'p003'")).first()[0] == "p003_c1"
    assert labs.single_case_id(raw_labs, "given").first()[0] == "given"
    assert labs.first_patient_id(raw_labs, "ord", None, "p002_c1").first()[0] == "p002"
    assert labs.first_patient_id(raw_labs, "ord").first()[0] == "p001"
    assert labs.first_patient_id(raw_labs.limit(0), "ord", None, "c").first()[0] == "c"
    assert labs.first_patient_id(raw_labs.limit(0), "ord").first()[0] == "unknown_patient"
    aged = raw_labs.withColumn("age", F.lit("61"))
    got = rows(labs.case_attributes(aged, "ord", "age"), "case_id")
    assert [(r["patient_id"], r["anchor_age"]) for r in got] == [
        ("p001", 61.0), ("p002", 61.0), ("p003", 61.0)]


def test_text_labs(spark, rows):
    docs = spark.createDataFrame([(1, "GLU: 7.8 mmol/L，血红蛋白 130g/L"), (2, "none")],
                                 "doc_id long, text string")
    got = rows(labs.text_labs(docs), "match_no")
    assert [(r["item_name"], r["value"], r["unit"]) for r in got] == [
        ("GLU", "7.8", "mmol/L"), ("血红蛋白", "130", "g/L")]


def test_disease_split(spark, lookups, rows):
    df = spark.createDataFrame(
        [("GLU", "diabetes"), ("WBC", "diabetes"), ("WBC", "nothing"), ("GLU", None)],
        "standard_item_name string, primary_disease string")
    got = rows(labs.split_by_disease(df, lookups.markers), "primary_disease", "standard_item_name")
    assert [(r["primary_disease"], r["standard_item_name"], r["is_core"]) for r in got] == [
        (None, "GLU", False), ("diabetes", "GLU", True), ("diabetes", "WBC", False),
        ("nothing", "WBC", True)]


def test_clinical_features(standard):
    got = case_payload(standard, "ord", ["GLU", "WBC"]).filter("case_id = 'p001_c1'").first()
    assert got["GLU_latest"] == 9.8
    assert got["GLU_mean"] == pytest.approx(8.7333, abs=1e-4)
    assert got["Creatinine_mean"] == 88.0
    assert got["GLU_slope"] == pytest.approx(0.0339, abs=1e-4)
    assert got["CEA_level"] is None and got["WBC_slope"] is None


def test_slopes_latest_and_trend(standard, rows):
    key = ["case_id", "standard_item_name"]
    slopes = rows(trends.slopes_per_day(standard, key, "value", "test_time", "ord"))
    assert [(r["standard_item_name"], round(r["slope_per_day"], 4)) for r in slopes] == [
        ("GLU", 0.0339)]
    latest = {(r["case_id"], r["standard_item_name"]): r["latest_value"]
              for r in rows(trends.latest_values(standard, key, "value", "test_time", "ord"))}
    assert latest[("p001_c1", "GLU")] == 9.8 and len(latest) == 11
    trend = trends.trend_summary(standard, key, "value", "test_time", "ord").filter(
        "case_id = 'p001_c1' and standard_item_name = 'GLU'").first()
    assert (trend["first_value"], trend["last_value"], trend["trend_direction"]) == (7.8, 9.8, "up")
    assert trend["change_rate"] == pytest.approx(0.2564, abs=1e-4)


def test_missing_times_count_as_latest(spark):
    df = spark.createDataFrame(
        [("k", 1.0, "2026-01-01", 0), ("k", 5.0, None, 1), ("k", 3.0, "2026-01-11", 2)],
        "k string, v double, t string, o int").withColumn("t", F.col("t").cast("timestamp"))
    assert trends.latest_values(df, ["k"], "v", "t", "o").first()["latest_value"] == 5.0
    assert trends.slopes_per_day(df, ["k"], "v", "t", "o").first()["slope_per_day"] == 4.0
    empty = trends.trend_summary(df.withColumn("v", F.lit(None).cast("double")), ["k"], "v", "t")
    assert empty.first()["trend_direction"] == "unknown"


def test_decide_and_report(spark, raw_labs, lookups, rows):
    radiomics = spark.createDataFrame(
        [("p001_c1", 14.2), ("p002", 18.7)], "case_id string, texture_mean double")
    text = spark.createDataFrame([("p001_c1", "blood sugar")], "case_id string, self_report string")
    artifacts = spark.createDataFrame([("p001_c1", "motion", 2)],
                                      "case_id string, artifact_type string, artifact_level int")
    records = decide_and_report(
        raw_labs, lookups, "ord", ["GLU"], text, radiomics, artifacts=artifacts)
    got = {r["case_id"]: r for r in rows(records)}
    assert set(got) == {"p001_c1", "p002_c1", "p003_c1"}
    first = got["p001_c1"]
    assert first["target_disease"] == "Diabetes_Nephropathy" and first["patient_id"] == "p001"
    assert first["selected_model"] == "Model_A_TimeSeries"
    assert (first["time_series_steps"], first["has_group_E_radiomics"]) == (3, True)
    assert first["missing_rate"] == 0.5 and got["p003_c1"]["missing_rate"] == 0.83
    assert (first["core_lines"], first["appendix_lines"], first["abnormal_lines"]) == (4, 2, 4)
    assert first["report_title"] == catalog.DISEASE_MARKERS["diabetes"]["title"]
    assert first["artifact_metrics"]["artifact_type"] == "motion"
    assert got["p003_c1"]["artifact_metrics"] is None


def test_alias_indexes(spark, lookups):
    later = dictionary.alias_index(catalog.field_table(spark, [
        {"standard_name": "A", "alias_names": ["x"]}, {"standard_name": "B", "alias_names": ["X"]}]))
    got = {r["alias"]: r["standard_name"] for r in later.collect()}
    assert got == {"A": "A", "a": "A", "B": "B", "b": "B", "x": "B", "X": "B"}
    rich = dictionary.rich_alias_index(catalog.field_table(spark, [
        {"standard_name": "A", "alias_names": ["x"]}, {"standard_name": "B", "alias_names": ["X"]}]))
    got = {r["alias"]: r["standard_name"] for r in rich.collect()}
    assert got["x"] == "A" and got["X"] == "B"
