import pytest
from pyspark.sql import functions as F

from labspark import catalog
from labspark.functions import values
from labspark.operators import fusion, routing


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


@pytest.fixture(scope="module")
def fragments(spark):
    entity = "array<struct<entity:string,standard_name:string,negation_status:boolean>>"
    return {
        "d_group_nlp": frame(
            spark, "case_id string, primary_disease string, total_entities int,"
                   f" negation_count int, has_nodule boolean, disease_list array<string>, entities {entity}",
            ("case_1", "diabetes", 8, 0, False, ["a"], [
                ("高血压", "hypertension", False), ("远处转移", "distant_metastasis", True)]),
            ("case_2", "x", 1, None, None, None, [("转移", "metastasis", True)])),
        "d_group_stats": frame(spark, "case_id string, GLU_latest double", ("case_1", 8.8)),
        "group_b_quality": frame(
            spark, "case_id string, image_quality_score double, artifact_severity string,"
                   " motion_blur_present boolean",
            ("case_1", 0.95, "none", False), ("case_3", None, "Moderate", None)),
        "group_e_radiomics": frame(
            spark, "case_id string, texture_mean double, texture_std double, glcm_entropy double,"
                   " fragment_case_id string",
            ("case_1", 55.2, 12.7, 3.45, "case_1"), ("case_2", None, 1.0, 2.0, "case_9")),
    }


def test_wide_table(fragments):
    wide = {r["case_id"]: r for r in fusion.wide_table(fragments, timestamp="t0").collect()}
    one, two, three = wide["case_1"], wide["case_2"], wide["case_3"]
    done = one["modality_completeness"]
    assert (done["overall_missing_rate"], done["total_modalities_present"]) == (0.33, 4)
    assert one["quality_artifact_warning"] is False
    assert (one["has_negated_finding"], one["negation_count"], one["distant_metastasis"]) == (
        True, 0, False)
    assert one["has_imaging_nodule"] is False and one["disease_list"] == ["a"]
    assert one["connected_groups"] == [
        "d_group_nlp", "d_group_stats", "group_b_quality", "group_e_radiomics"]
    assert (two["negation_count"], two["distant_metastasis"]) == (1, None)
    assert two["radiomics_texture_mean"] == 1.5 and one["radiomics_texture_mean"] == 55.2
    assert two["alignment_warnings"] == ["fragment of case case_9"]
    assert three["quality_artifact_warning"] is True and three["primary_disease"] is None
    assert three["timestamp"] == "t0"


def test_unknown_namespace(fragments):
    with pytest.raises(ValueError):
        fusion.gather_namespaces({"other": fragments["d_group_stats"]})


def test_prefixed_features(spark):
    got = {r["case_id"]: r for r in fusion.prefixed_features({
        "group_a_simulation": frame(spark, "case_id string, lesion_elasticity double", ("c", None)),
        "group_b_quality": frame(spark, "case_id string, quality_score double", ("c", 0.5)),
        "group_e_radiomics": frame(
            spark, "case_id string, texture_mean double, glcm_entropy double", ("c", 2.0, 4.0)),
        "d_group_stats": frame(spark, "case_id string, GLU_slope double", ("c", 0.64), ("d", 1.0)),
    }).collect()}
    c, d = got["c"], got["d"]
    assert (c["A_lesion_elasticity"], c["B_artifact_level"], c["B_quality_artifact_warning"]) == (
        0.0, "unknown", True)
    assert (c["E_radiomics_mean"], c["E_radiomics_std"], c["E_shape_compactness"]) == (3.0, 1.0, 0.0)
    assert (c["total_groups_connected"], c["overall_missing_rate"]) == (4, 0.3333)
    assert d["A_lesion_elasticity"] is None and d["D_GLU_slope"] == 1.0


def test_sidecar(spark):
    cases = frame(spark, "case_id string, patient_id string", ("c1", "p1"), ("c2", "p2"), ("c3", "p3"))
    features = frame(spark, "case_id string, v int", ("c1", 1), ("p1", 9), ("p2", 2))
    got = {r["case_id"]: r["side"] for r in fusion.sidecar(cases, features, "side").collect()}
    assert got["c1"]["v"] == 1 and got["c2"]["v"] == 2 and got["c3"] is None


def test_nlp_flags(spark):
    entities = frame(
        spark, "case_id string, standard_name string, negation_status boolean, start int",
        ("c", "distant_metastasis", True, 5), ("c", "distant_metastasis", False, 9),
        ("c", "x", True, 1), ("d", "x", False, 1))
    got = {r["case_id"]: r for r in fusion.nlp_flags(entities).collect()}
    assert (got["c"]["negation_count"], got["c"]["distant_metastasis"]) == (2, False)
    assert (got["d"]["has_negated_finding"], got["d"]["distant_metastasis"]) == (None, None)


PROFILES = "patient_id string, primary_disease string, time_series_steps int," \
           " nlp_entities_count int, has_group_E_radiomics boolean, missing_rate double"
LIVE = {"Model_A_TimeSeries": 85.0, "Model_B_NLP_Graph": 80.0, "Model_C_Multimodal": 90.0}


def test_routing_golden(spark):
    profiles = frame(spark, PROFILES, ("p1", "Diabetes_Nephropathy", 6, 2, False, 0.08),
                     ("p2", "Lung_Oncology", 1, 10, True, 0.22))
    got = {(r["patient_id"], r["model_id"][6]): r for r in
           routing.ranked_models(profiles, live=LIVE).collect()}
    want = {("p1", "A"): (72.0, 1.0, 0.024), ("p1", "B"): (63.4, 0.8889, 0.1657),
            ("p1", "C"): (55.3, 0.7333, 0.584), ("p2", "A"): (59.2, 0.7778, 0.3327),
            ("p2", "B"): (68.7, 1.0, 0.066), ("p2", "C"): (73.7, 1.0, 0.066)}
    for key, (score, fit, penalty) in want.items():
        assert (got[key]["score"], got[key]["modality_fit"], got[key]["missing_penalty"]) == (
            pytest.approx(score), pytest.approx(fit), pytest.approx(penalty))
    assert got[("p1", "A")]["is_winner"] and got[("p2", "C")]["is_winner"]
    assert "radiomics" in got[("p1", "C")]["lost_because"]
    decisions = {r["patient_id"]: r for r in routing.route(profiles, live=LIVE).collect()}
    assert decisions["p1"]["selected_model"] == "Model_A_TimeSeries"
    assert decisions["p2"]["selected_model"] == "Model_C_Multimodal"
    assert decisions["p2"]["target_disease_cn"] == catalog.DISEASE_NAMES["Lung_Oncology"]
    assert decisions["p1"]["all_model_scores"]["Model_B_NLP_Graph"] == pytest.approx(63.4)


def test_routing_history_fallbacks(spark):
    profiles = frame(spark, PROFILES, ("p", "Lung_Oncology", 6, 10, True, 0.0),
                     ("q", "other", 6, 10, True, 0.0))
    got = {(r["patient_id"], r["model_id"][6]): r["historical_f1"]
           for r in routing.ranked_models(profiles).collect()}
    assert got[("p", "C")] == 0.94 and got[("q", "A")] == 0.5
    assert routing.live_scores(catalog.config_table(spark)) == LIVE
    assert routing.route_simple(profiles).filter("patient_id = 'p'").first()[
        "selected_model"] == "Model_C_Multimodal"


@pytest.mark.parametrize("disease,cea,want", [
    (None, 9.0, "Lung_Oncology"), (None, 8.0, "Diabetes_Nephropathy"),
    (None, None, "Diabetes_Nephropathy"), ("X", 9.0, "X")])
def test_default_disease(spark, disease, cea, want):
    df = frame(spark, "d string, c double", (disease, cea))
    assert df.select(routing.default_disease(F.col("d"), F.col("c"))).first()[0] == want


def test_labels(spark):
    df = frame(spark, "s double, b double", (0.03, 1.0), (0.01, 1.0), (0.0, 1.0), (-0.01, 1.0),
               (-0.03, 1.0), (1.0, 0.0))
    got = [r[0] for r in df.select(values.trajectory_label(F.col("s"), F.col("b"))).collect()]
    assert got == ["快速恶化/上升亚型", "缓慢进展亚型", "平稳控制亚型", "缓慢改善亚型", "治疗改善/下降亚型", "数据异常"]
    names = frame(spark, "l string", ("疑似糖尿病肾病",), ("肾功能异常",), ("ALT high",), ("?",), (None,))
    assert [r[0] for r in names.select(values.disease_of_label(F.col("l"))).collect()] == [
        "diabetes", "kidney_disease", "liver_disease", "default", "default"]


def test_router_columns(spark):
    df = frame(spark, "patient_id string, clinical_features int, _labs int", ("p", 1, 2))
    assert routing.router_columns(df).columns == ["patient_id", "clinical_features"]
