"""Registered queries that align tables per case, route cases and build reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark import catalog
from labspark.catalog import CONFIG_SEEDS, DISEASE_MARKERS, MODEL_REGISTRY, SIMPLE_REGISTRY
from labspark.functions.values import disease_of_label
from labspark.operators import fusion, labs, learning, reports, routing
from labspark.plans.integration import decide_and_report
from labspark.plans.lab_queries import (
    RANGES, _flag_sql, _lookups, _standard_sql, events, raw_labs)
from labspark.plans.registry import ORACLE, query, r, rounded, table, values_sql
from labspark.session import checkpoint_folder
from labspark.streaming import gate

# ------------------------------------------------------------------------------- namespaces
# doc_id is the case; every table lacks some cases.


def _fragments(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("primary_disease"),
        (F.col("n_chars") % 50).cast("int").alias("total_entities"),
        F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 5).cast("int"))
        .alias("negation_count"),
        (F.col("lang") == "en").alias("has_nodule"))
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("case_id"), F.col("quality").cast("double").alias("GLU_latest"),
        (F.col("toxic") * 0.5).alias("GLU_slope"))
    talk = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(
        F.count(F.lit(1)).cast("double").alias("lesion_volume_cm3"))
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("case_id"),
        F.when(F.col("page_id") % 4 != 0, (F.char_length("url") % 100) / 50.0)
        .alias("image_quality_score"),
        F.when(F.col("page_id") % 5 == 0, "Severe").when(F.col("page_id") % 5 == 1, "none")
        .alias("artifact_severity"),
        (F.col("page_id") % 6 == 0).alias("motion_blur_present"))
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("case_id"),
        F.when(F.col("label") > 4, F.col("embedding")[0].cast("double")).alias("texture_mean"),
        F.col("embedding")[1].cast("double").alias("texture_std"),
        F.when(F.col("label") != 3, F.col("embedding")[2].cast("double")).alias("glcm_entropy"),
        (F.col("vec_id") + F.when(F.col("label") == 9, 1).otherwise(0)).alias("fragment_case_id"))
    return {"d_group_nlp": docs, "d_group_stats": labels, "group_a_simulation": talk,
            "group_b_quality": pages, "group_e_radiomics": vectors}


_fragments_sql = """
nlp AS (SELECT doc_id AS case_id, lang AS primary_disease, n_chars % 50 AS total_entities,
    CASE WHEN doc_id % 2 = 0 THEN n_chars % 5 END AS negation_count, lang = 'en' AS has_nodule
  FROM documents),
st AS (SELECT doc_id AS case_id, quality AS glu, toxic * CAST(0.5 AS DOUBLE) AS slope FROM labels),
sim AS (SELECT conv_id AS case_id, count(*) AS vol FROM conversations GROUP BY 1),
q AS (SELECT page_id AS case_id,
    CASE WHEN page_id % 4 <> 0 THEN (length(url) % 100) / CAST(50 AS DOUBLE) END AS score,
    CASE page_id % 5 WHEN 0 THEN 'Severe' WHEN 1 THEN 'none' END AS severity,
    page_id % 6 = 0 AS blur FROM pages),
rad AS (SELECT vec_id AS case_id, label,
    CASE WHEN label > 4 THEN CAST(embedding[1] AS DOUBLE) END AS tm,
    CAST(embedding[2] AS DOUBLE) AS ts,
    CASE WHEN label <> 3 THEN CAST(embedding[3] AS DOUBLE) END AS ge FROM embeddings),
spine AS (SELECT case_id FROM nlp UNION SELECT case_id FROM st UNION SELECT case_id FROM sim
  UNION SELECT case_id FROM q UNION SELECT case_id FROM rad),
j AS (SELECT spine.case_id, nlp.case_id IS NOT NULL AS h1, st.case_id IS NOT NULL AS h2,
    rad.case_id IS NOT NULL AS h3, sim.case_id IS NOT NULL AS h4, q.case_id IS NOT NULL AS h5,
    nlp.* EXCLUDE (case_id), st.* EXCLUDE (case_id), sim.* EXCLUDE (case_id),
    q.* EXCLUDE (case_id), rad.* EXCLUDE (case_id),
    h1::INT + h2::INT + h3::INT + h4::INT + h5::INT AS present
  FROM spine LEFT JOIN nlp USING (case_id) LEFT JOIN st USING (case_id)
  LEFT JOIN sim USING (case_id) LEFT JOIN q USING (case_id) LEFT JOIN rad USING (case_id))"""
_warning_sql = """coalesce(score < CAST(0.6 AS DOUBLE), FALSE)
    OR coalesce(lower(severity) IN ('severe', 'moderate'), FALSE) OR coalesce(blur, FALSE)"""


# columns that no fragment of these queries has
_absent_sql = ", ".join(f'NULL AS "{c}"' for c in (
    "disease_list", "Creatinine_latest", "HbA1c_latest", "ALT_latest", "GLU_baseline", "GLU_change_rate",
    "sim_vessel_density", "sim_tissue_elasticity", "sim_thermal_diffusivity", "image_snr_db",
    "patho_seg_dice", "patho_cell_density", "patho_mitosis_count", "patho_ki67_pct",
    "radiomics_glcm_contrast", "radiomics_shape_sphericity"))


@query("case_align", f"""
WITH {_fragments_sql}
SELECT case_id, primary_disease, total_entities AS nlp_total_entities, negation_count,
  has_nodule AS has_imaging_nodule, glu AS "GLU_latest", slope AS "GLU_slope",
  vol AS sim_lesion_volume, score AS image_quality_score, severity AS artifact_severity,
  blur AS has_motion_blur,
  CASE WHEN tm IS NOT NULL THEN round(tm, 6) WHEN h3 THEN
    round(CASE WHEN ge IS NOT NULL THEN (ts + ge) / 2 ELSE ts END, 2) + 0 END
    AS radiomics_texture_mean,
  round(ts, 6) AS radiomics_texture_std, round(ge, 6) AS radiomics_glcm_entropy,
  {_warning_sql} AS quality_artifact_warning, present AS total_groups_connected,
  CASE WHEN label = 9 THEN 1 ELSE 0 END AS n_warnings, {_absent_sql}
FROM j""")
def case_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five namespaces aligned on the case id, one shuffle of the key."""
    wide = fusion.wide_table(_fragments(spark, sf_dir))
    return rounded(
        wide.withColumn("n_warnings", F.size("alignment_warnings")), "radiomics_texture_mean",
        "radiomics_texture_std", "radiomics_glcm_entropy").drop(
        "modality_completeness", "connected_groups", "alignment_warnings", "timestamp")


@query("case_completeness", f"""
WITH {_fragments_sql}
SELECT case_id, h1 AS has_clinical_nlp, h2 AS has_time_series_labs, h3 AS "has_radiomics_E",
  h4 AS "has_simulation_A", h5 AS "has_quality_B", FALSE AS "has_pathology_C",
  present AS total_modalities_present, 6 AS total_modalities_expected,
  round(1 - present / CAST(6 AS DOUBLE), 2) AS overall_missing_rate
FROM j""")
def case_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fusion.wide_table(_fragments(spark, sf_dir))
    return wide.select("case_id", "modality_completeness.*")


@query("quality_warning", f"""
WITH {_fragments_sql}
SELECT {_warning_sql} AS warned, count(*) AS n FROM q GROUP BY 1""")
def quality_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _fragments(spark, sf_dir)["group_b_quality"]
    warned = fusion.quality_warning(
        F.col("image_quality_score"), F.col("artifact_severity"), F.col("motion_blur_present"))
    return pages.groupBy(warned.alias("warned")).agg(F.count(F.lit(1)).alias("n"))


@query("prefixed_features", f"""
WITH {_fragments_sql}
SELECT case_id, CASE WHEN h4 THEN CAST(vol AS DOUBLE) END AS "A_lesion_elasticity",
  CASE WHEN h5 THEN coalesce(severity, 'unknown') END AS "B_artifact_level",
  CASE WHEN h5 THEN coalesce(score, 1) END AS "B_quality_score",
  CASE WHEN h5 THEN coalesce(score, 1) < CAST(0.6 AS DOUBLE) END AS "B_quality_artifact_warning",
  CASE WHEN h3 THEN round(coalesce(tm, 0), 6) END AS "E_texture_mean",
  CASE WHEN h1 THEN coalesce(total_entities, 0) END AS "D_entity_count",
  CASE WHEN h1 THEN coalesce(negation_count, 0) END AS "D_negation_count",
  glu AS "D_GLU_latest",
  CASE WHEN h3 THEN round(list_avg([x FOR x IN [tm, ts, ge] IF x IS NOT NULL]), 6) END
    AS "E_radiomics_mean",
  CASE WHEN h3 THEN round(list_stddev_pop([x FOR x IN [tm, ts, ge] IF x IS NOT NULL]), 6) END
    AS "E_radiomics_std",
  present AS total_groups_connected, round(1 - present / CAST(6 AS DOUBLE), 4)
    AS overall_missing_rate
FROM j""")
def prefixed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefixed alignment variant with defaults."""
    parts = _fragments(spark, sf_dir)
    renamed = {
        "group_a_simulation": parts["group_a_simulation"].withColumnRenamed(
            "lesion_volume_cm3", "lesion_elasticity"),
        "group_b_quality": parts["group_b_quality"].select(
            "case_id", F.col("artifact_severity").alias("artifact_level"),
            F.col("image_quality_score").alias("quality_score")),
        "group_e_radiomics": parts["group_e_radiomics"].drop("fragment_case_id"),
        "d_group_nlp": parts["d_group_nlp"].select(
            "case_id", F.col("total_entities").alias("entity_count"), "negation_count"),
        "d_group_stats": parts["d_group_stats"].select("case_id", "GLU_latest"),
    }
    wide = fusion.prefixed_features(renamed)
    return rounded(wide, "E_texture_mean", "E_radiomics_mean", "E_radiomics_std").select(
        "case_id", "A_lesion_elasticity", "B_artifact_level", "B_quality_score",
        "B_quality_artifact_warning", "E_texture_mean", "D_entity_count", "D_negation_count",
        "D_GLU_latest", "E_radiomics_mean", "E_radiomics_std", "total_groups_connected",
        "overall_missing_rate")


@query("sidecar_features", """
SELECT c.c_custkey AS case_id, coalesce(a.s_acctbal, b.s_acctbal) AS balance
FROM customer c LEFT JOIN supplier a ON a.s_suppkey * 3 = c.c_custkey
LEFT JOIN supplier b ON b.s_suppkey * 3 = c.c_nationkey""")
def sidecar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier features by case key, else by the second key."""
    cases = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_id"), F.col("c_nationkey").cast("long").alias("patient_id"))
    features = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 3).alias("case_id"), "s_acctbal")
    return fusion.sidecar(cases, features, "side").select(
        "case_id", F.col("side.s_acctbal").alias("balance"))


# ---------------------------------------------------------------------------------- routing
def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient profiles: customers with their order counts."""
    steps = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("o_orderkey").cast("int").alias("time_series_steps"))
    key = F.col("c_custkey")
    disease = (F.when(F.col("c_mktsegment") == "BUILDING", "Diabetes_Nephropathy")
               .when(F.col("c_mktsegment") == "MACHINERY", "Lung_Oncology")
               .when(F.col("c_mktsegment") == "FURNITURE", "Hepatopathy"))
    return (
        table(spark, sf_dir, "customer").join(steps, key == F.col("o_custkey"), "left")
        .select(
            key.cast("string").alias("patient_id"),
            routing.default_disease(disease, F.col("c_acctbal") / 500).alias("primary_disease"),
            F.coalesce("time_series_steps", F.lit(0)).alias("time_series_steps"),
            (key % 12).cast("int").alias("nlp_entities_count"),
            (F.col("c_nationkey") % 2 == 0).alias("has_group_E_radiomics"),
            ((key % 10) / 20.0).alias("missing_rate")))


_profiles_sql = """SELECT CAST(c_custkey AS VARCHAR) AS patient_id,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Diabetes_Nephropathy' WHEN 'MACHINERY' THEN
      'Lung_Oncology' WHEN 'FURNITURE' THEN 'Hepatopathy' ELSE CASE WHEN c_acctbal / 500 > 8
      THEN 'Lung_Oncology' ELSE 'Diabetes_Nephropathy' END END AS primary_disease,
    coalesce(steps, 0) AS steps, c_custkey % 12 AS entities, c_nationkey % 2 = 0 AS rad,
    (c_custkey % 10) / CAST(20 AS DOUBLE) AS missing
  FROM customer LEFT JOIN (SELECT o_custkey, count(o_orderkey) AS steps FROM orders GROUP BY 1)
    ON o_custkey = c_custkey"""


def _scores_sql(registry: list[dict], profiles: str = _profiles_sql) -> str:
    """Scores of every profile and model, written as plain joins and arithmetic."""
    models = values_sql(
        [(m["model_id"], i, m["ts_min"], m["nlp_min"], m["rad_required"], m["sens_ts"],
          m["sens_nlp"], m["sens_rad"]) for i, m in enumerate(registry)],
        "model_id, place, ts_min, nlp_min, rad_required, sens_ts, sens_nlp, sens_rad")
    history = [
        (m["model_id"], disease, score) for m in registry
        for disease, score in (m["f1"].items() if isinstance(m["f1"], dict) else ())]
    flat = [(m["model_id"], m["f1"]) for m in registry if not isinstance(m["f1"], dict)]
    joined = (
        f"LEFT JOIN {values_sql(history, 'model_id, primary_disease, f1').replace(' AS v(', ' AS h(')}"
        " USING (model_id, primary_disease)" if history else
        f"JOIN {values_sql(flat, 'model_id, f1').replace(' AS v(', ' AS h(')} USING (model_id)")
    return f"""
  SELECT *, round(greatest(0, CAST(0.5 AS DOUBLE) * hist + CAST(0.3 AS DOUBLE) * fit
      - CAST(0.2 AS DOUBLE) * pen) * 100, 1) AS score
  FROM (
    SELECT *,
      ((CASE WHEN ts_min > 0 THEN least(1, steps / CAST(ts_min AS DOUBLE)) ELSE 1 END)
        + (CASE WHEN nlp_min > 0 THEN least(1, entities / CAST(nlp_min AS DOUBLE)) ELSE 1 END)
        + (CASE WHEN rad_required AND NOT rad THEN CAST(0.2 AS DOUBLE) ELSE 1 END)) / 3 AS fit,
      least(1, CASE WHEN ts_min > 0 AND steps < ts_min
          THEN sens_ts * (1 - steps / CAST(ts_min AS DOUBLE)) / 2 ELSE 0 END
        + CASE WHEN nlp_min > 0 AND entities < nlp_min
          THEN sens_nlp * (1 - entities / CAST(nlp_min AS DOUBLE)) / 2 ELSE 0 END
        + CASE WHEN rad_required AND NOT rad THEN sens_rad * CAST(0.8 AS DOUBLE) ELSE 0 END
        + missing * CAST(0.3 AS DOUBLE)) AS pen
    FROM (SELECT p.*, m.*, coalesce(h.f1, CAST(0.5 AS DOUBLE)) AS hist
          FROM ({profiles}) p CROSS JOIN {models.replace(' AS v(', ' AS m(')} {joined}))"""


@query("route_models", f"""
SELECT patient_id, primary_disease, model_id,
  row_number() OVER (PARTITION BY patient_id ORDER BY score DESC, place) AS model_rank,
  score, hist AS historical_f1, round(fit, 4) AS modality_fit, round(pen, 4) AS missing_penalty
FROM ({_scores_sql(MODEL_REGISTRY)})""")
def route_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile against every model, ranked, scored in place."""
    return routing.ranked_models(_profiles(spark, sf_dir)).select(
        "patient_id", "primary_disease", "model_id", "model_rank", "score", "historical_f1",
        "modality_fit", "missing_penalty")


@query("route_decisions", f"""
SELECT patient_id, primary_disease AS target_disease, model_id AS selected_model,
  score AS winning_score, missing > CAST(0.3 AS DOUBLE) AS needs_review
FROM ({_scores_sql(MODEL_REGISTRY)})
QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY score DESC, place) = 1""")
def route_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(_profiles(spark, sf_dir)).select(
        "patient_id", "target_disease", "selected_model", "winning_score", "needs_review")


@query("route_simple", f"""
SELECT patient_id, model_id AS selected_model, score AS winning_score
FROM ({_scores_sql(SIMPLE_REGISTRY)})
QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY score DESC, place) = 1""")
def route_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_simple(_profiles(spark, sf_dir)).select(
        "patient_id", "selected_model", "winning_score")


_payload_sql = f"""SELECT case_id AS patient_id, 'Diabetes_Nephropathy' AS primary_disease,
    max(n) AS steps, 0 AS entities, any_value(r) AS rad,
    round(1 - (CASE WHEN max(n) > 0 THEN 1 ELSE 0 END + any_value(r)::INT) / CAST(6 AS DOUBLE), 2)
      AS missing
  FROM (SELECT s.case_id, count(raw) AS n, any_value(u.s_suppkey) IS NOT NULL AS r
        FROM ({_standard_sql}) s LEFT JOIN supplier u ON CAST(u.s_suppkey * 3 AS VARCHAR) = s.case_id
        GROUP BY s.case_id, s.standard_item_name)
  GROUP BY case_id"""


@query("raw_labs_to_decisions", f"""
SELECT patient_id AS case_id, target_disease, selected_model, winning_score, core_lines,
  time_series_steps, appendix_lines
FROM (
  SELECT patient_id, primary_disease AS target_disease, model_id AS selected_model,
    score AS winning_score
  FROM ({_scores_sql(MODEL_REGISTRY, _payload_sql)})
  QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY score DESC, place) = 1)
JOIN (SELECT case_id, count(*) FILTER (WHERE standard_item_name IN ('view', 'click'))
        AS core_lines, count(*) FILTER (WHERE standard_item_name NOT IN ('view', 'click'))
        AS appendix_lines FROM ({_standard_sql}) GROUP BY 1) l ON l.case_id = patient_id
JOIN (SELECT case_id, CAST(max(n) AS INTEGER) AS time_series_steps FROM (
        SELECT case_id, standard_item_name, count(raw) AS n FROM ({_standard_sql}) GROUP BY 1, 2)
      GROUP BY 1) s ON s.case_id = patient_id""")
def raw_labs_to_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy lab rows to one routing decision and report record per case."""
    lookups = _lookups(spark)
    lookups.markers = catalog.marker_table(spark, MARKERS)
    radiomics = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 3).cast("string").alias("case_id"), "s_acctbal")
    records = decide_and_report(
        raw_labs(spark, sf_dir), lookups, "ord", ["view"], radiomics_features=radiomics)
    return records.select(
        "case_id", "target_disease", "selected_model", "winning_score", "core_lines",
        "time_series_steps", "appendix_lines")


@query("label_diseases", """
SELECT CASE WHEN contains(p_name, 'ring') OR contains(p_type, 'PROMO') THEN 'diabetes'
    WHEN contains(p_name, 'bolt') THEN 'kidney_disease' ELSE 'default' END AS disease,
  count(*) AS n FROM part GROUP BY 1""")
def label_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword rules on a label text, first rule wins."""
    label = F.concat_ws(" ", "p_name", "p_type")
    rules = [("diabetes", ["ring", "PROMO"]), ("kidney_disease", ["bolt"])]
    return table(spark, sf_dir, "part").groupBy(
        disease_of_label(label, rules).alias("disease")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------------- reports
MARKERS = {
    "diabetes": {"primary": ["view", "click"], "secondary": ["signup"]},
    "kidney_disease": {"primary": ["error"], "secondary": []},
    "default": {"primary": ["signup", "purchase"], "secondary": ["view"]},
}
_disease_case = "CASE user_id % 3 WHEN 0 THEN 'diabetes' WHEN 1 THEN 'kidney_disease' ELSE 'other' END"
_primary_sql = values_sql(
    [(d, m) for d, c in MARKERS.items() for m in c["primary"]], "disease, marker")
_lines_sql = f"""SELECT e.user_id, e.event_type, {_flag_sql} AS abnormal_flag,
    CASE WHEN m.marker IS NOT NULL THEN 'core' ELSE 'appendix' END AS section
  FROM events e LEFT JOIN {values_sql(RANGES, 'marker, low, high, unit, crit_low, crit_high')
                           .replace(' AS v(', ' AS g(')} ON g.marker = e.event_type
  LEFT JOIN {_primary_sql.replace(' AS v(', ' AS m(')} ON m.marker = e.event_type
    AND m.disease = CASE WHEN {_disease_case} = 'other' THEN 'default' ELSE {_disease_case} END"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("case_id")
    disease = (F.when(case % 3 == 0, "diabetes").when(case % 3 == 1, "kidney_disease")
               .otherwise("other"))
    return events(spark, sf_dir).select(F.col("user_id").alias("case_id")).distinct().select(
        case, case.alias("patient_id"), disease.alias("primary_disease"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labs.with_flag(labs.with_reference(
        events(spark, sf_dir), catalog.range_table(spark, RANGES), "event_type")).select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("standard_item_name"),
        "abnormal_flag")


@query("marker_split_report", f"""
SELECT user_id AS case_id, event_type AS standard_item_name, section, abnormal_flag,
  count(*) AS n FROM ({_lines_sql}) GROUP BY ALL""")
def marker_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines by section and flag."""
    lines = reports.report_lines(
        _flagged(spark, sf_dir), _cases(spark, sf_dir), catalog.marker_table(spark, MARKERS))
    return lines.groupBy("case_id", "standard_item_name", "section", "abnormal_flag").agg(
        F.count(F.lit(1)).alias("n"))


@query("report_records", f"""
SELECT user_id AS case_id, CASE user_id % 3
    WHEN 0 THEN '{DISEASE_MARKERS['diabetes']['title']}'
    WHEN 1 THEN '{DISEASE_MARKERS['kidney_disease']['title']}'
    ELSE '{DISEASE_MARKERS['default']['title']}' END AS report_title,
  count(*) FILTER (WHERE section = 'core') AS core_lines,
  count(*) FILTER (WHERE section = 'appendix') AS appendix_lines,
  count(*) FILTER (WHERE abnormal_flag <> 'normal') AS abnormal_lines,
  any_value(s.s_acctbal) AS artifact_score
FROM ({_lines_sql}) LEFT JOIN supplier s ON s.s_suppkey = user_id
GROUP BY user_id""")
def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per case with header, line counts and artifact metrics."""
    artifacts = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("case_id"), F.col("s_acctbal").alias("score"))
    records = reports.report_records(
        _flagged(spark, sf_dir), _cases(spark, sf_dir), catalog.marker_table(spark, MARKERS),
        artifacts=artifacts)
    return records.select(
        "case_id", "report_title", "core_lines", "appendix_lines", "abnormal_lines",
        F.col("artifact_metrics.score").alias("artifact_score"))


def _by_case_sql(what: str) -> str:
    return (f"CASE case_id % 3 WHEN 0 THEN '{DISEASE_MARKERS['diabetes'][what]}' WHEN 1 THEN"
            f" '{DISEASE_MARKERS['kidney_disease'][what]}' ELSE '{DISEASE_MARKERS['default'][what]}' END")


@query("report_lines_full", f"""
WITH c AS (SELECT DISTINCT user_id AS case_id FROM events),
l AS (SELECT user_id AS case_id, event_type AS name, section, value, abnormal_flag, ts, event_id FROM
  ({_lines_sql.replace("SELECT e.user_id,", "SELECT e.value, e.ts, e.event_id, e.user_id,")})),
p AS (SELECT s_suppkey AS case_id, s_name, s_acctbal, s_nationkey FROM supplier JOIN c ON c.case_id = s_suppkey),
a AS (SELECT case_id, unnest([{{'k': 'age', 'v': case_id % 7 - 3.0}}, {{'k': 'slope', 'v': case_id % 5 - 2.5}},
  {{'k': 'latest', 'v': case_id % 11 / 4.0}}, {{'k': 'mean', 'v': 0.25}}]) AS e FROM c)
SELECT case_id, 0 AS section_no, 'header' AS section, 0 AS line_no, 'report_title' AS name, NULL AS number,
  {_by_case_sql('title')} AS text, NULL AS flag FROM c
UNION ALL SELECT case_id, 0, 'header', 1, 'clinical_summary', NULL, {_by_case_sql('summary')}, NULL FROM c
UNION ALL SELECT case_id, 0, 'header', 2, 'report_kind', NULL, 'disease', NULL FROM c
UNION ALL SELECT case_id, CASE section WHEN 'core' THEN 1 ELSE 2 END, section,
  row_number() OVER (PARTITION BY case_id, section ORDER BY name, ts, event_id) - 1, name, value, NULL, abnormal_flag FROM l
UNION ALL SELECT case_id, 3, 'prediction', 0, 'prediction', NULL, s_name, NULL FROM p
UNION ALL SELECT case_id, 3, 'prediction', 1, 'probability', s_acctbal, NULL, NULL FROM p
UNION ALL SELECT case_id, 4, 'importance', row_number() OVER (PARTITION BY case_id ORDER BY abs(e.v) DESC, e.k) - 1,
  e.k, round(e.v, 4), NULL, NULL FROM a QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY abs(e.v) DESC, e.k) <= 3
UNION ALL SELECT case_id, 5, 'artifacts', 0, 'psnr', s_nationkey, NULL, NULL FROM p""")
def report_lines_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports as lines: header, core and appendix labs, prediction, ranked importance, artifact metrics."""
    rows = events(spark, sf_dir)
    found = labs.with_flag(labs.with_reference(rows, catalog.range_table(spark, RANGES), "event_type")).select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("standard_item_name"), "value", "abnormal_flag",
        "ts", "event_id")
    cases = _cases(spark, sf_dir)
    suppliers = cases.select("case_id").join(
        table(spark, sf_dir, "supplier"), F.col("case_id") == F.col("s_suppkey"))
    case = F.col("case_id")
    weights = cases.select("case_id", F.create_map(
        F.lit("age"), (case % 7 - 3.0).cast("double"), F.lit("slope"), (case % 5 - 2.5).cast("double"),
        F.lit("latest"), (case % 11 / 4.0).cast("double"), F.lit("mean"), F.lit(0.25)).alias("contributions"))
    return reports.report_body(
        found, cases, catalog.marker_table(spark, MARKERS), ["ts", "event_id"],
        suppliers.select("case_id", F.col("s_name").alias("prediction"), F.col("s_acctbal").alias("probability")),
        weights, suppliers.select("case_id", F.col("s_nationkey").alias("psnr")), top=3)


@query("report_kinds", """
SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'data_missing' ELSE 'disease' END AS report_kind,
  count(*) AS n FROM orders GROUP BY 1""")
def report_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.col("o_orderpriority").startswith("1")
    warnings = F.when(urgent, F.array(F.lit("x"), F.lit("DataQualityWarning: missing")))
    return table(spark, sf_dir, "orders").groupBy(
        reports.report_kind(warnings).alias("report_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("model_list", """
SELECT model_id, algorithm, task_status, source, test_score FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS model_id, c_mktsegment AS algorithm,
    CASE WHEN c_custkey IS NOT NULL THEN 'Completed' END AS task_status,
    'database' AS source, o_totalprice AS test_score
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey <> 7
  UNION ALL SELECT 'builtin_model_A', 'XGBoost', NULL, 'builtin', CAST(0.89 AS DOUBLE)
  UNION ALL SELECT 'builtin_model_B', 'LinearSVC + TF-IDF', NULL, 'builtin', CAST(0.425 AS DOUBLE)
  UNION ALL SELECT 'builtin_model_C', 'MLP (64→32→2)', NULL, 'builtin', CAST(0.9474 AS DOUBLE))""")
def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results (orders) with their tasks (customers, some missing), plus the built-in cards."""
    results = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("model_id"),
        F.col("o_custkey").cast("string").alias("task_id"),
        F.col("o_orderpriority").alias("model_name"), F.lit("classification").alias("task_type"),
        F.col("o_totalprice").alias("test_score"), F.col("o_orderdate").alias("created_time"))
    tasks = table(spark, sf_dir, "customer").filter("c_nationkey <> 7").select(
        F.col("c_custkey").cast("string").alias("task_id"),
        F.col("c_mktsegment").alias("algorithm_name"), F.lit("t").alias("target_variable"),
        F.lit("Completed").alias("status"))
    return reports.list_models(results, tasks).select(
        "model_id", "algorithm", "task_status", "source", "test_score")


# ------------------------------------------------------------------------- monitoring of models
@query("sample_gate", """
WITH b AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS n
           FROM events GROUP BY 1, 2),
g AS (SELECT event_type, count(*) AS n_batches, sum(n) AS n_rows,
        list_reduce(list(struct_pack(c := n, f := 0) ORDER BY d),
          lambda s, x: struct_pack(
            c := CASE WHEN s.c >= 50 THEN 0 ELSE s.c END + x.c,
            f := s.f + CASE WHEN s.c >= 50 THEN 1 ELSE 0 END)) AS s
      FROM b GROUP BY 1)
SELECT event_type, n_batches, CAST(n_rows AS BIGINT) AS n_rows,
  CASE WHEN s.c >= 50 THEN 0 ELSE s.c END AS counter,
  s.f + CASE WHEN s.c >= 50 THEN 1 ELSE 0 END AS fires FROM g""")
def sample_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retraining gate over daily batches of every source."""
    rows = table(spark, sf_dir, "events").select(
        "event_type", F.to_date("ts").alias("day"))
    return gate.gate_batches(rows, "event_type", "day")


@query("sample_gate_stream", ORACLE["sample_gate"])
def sample_gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same gate over a stream of files that arrive in three parts, with a restart after each part."""
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"))
    folder = f"{checkpoint_folder(spark).rstrip('/')}/gate-{uuid.uuid4().hex}"
    first, second = rows.select(F.percentile_approx(F.unix_date("day"), [0.33, 0.66])).first()[0]
    day = F.unix_date("day")
    # the second cut falls into a day: its rows come in two parts
    half = F.pmod(F.xxhash64("event_type"), F.lit(2)) == 0
    parts = [day <= first, (day > first) & ((day < second) | ((day == second) & half)),
             (day > second) | ((day == second) & ~half)]
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{folder}/arrived")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{folder}/arrived")
        gate.run_gate(arrived, "event_type", "day", folder).awaitTermination()
    return gate.gate_states(spark, folder).withColumnRenamed("source", "event_type")


_config_sql = values_sql([(k, v) for k, v, _ in CONFIG_SEEDS], "key, value")


@query("score_refresh", f"""
SELECT c.key, coalesce(n.value, c.value) AS value
FROM {_config_sql.replace(' AS v(', ' AS c(')} LEFT JOIN (
  SELECT CASE o_orderstatus WHEN 'P' THEN 'model_a_base_score' WHEN 'F' THEN 'model_b_base_score'
      ELSE 'model_c_base_score' END AS key,
    round(least(99, greatest(60, 100 * avg(CASE WHEN o_custkey % 4 = o_orderkey % 4
      OR o_totalprice > 90000 THEN 1 ELSE 0 END))), 6) AS value
  FROM orders GROUP BY 1
  UNION ALL SELECT 'new_samples_since_last_ct', 0) n USING (key)""")
def score_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores recomputed from predictions and written into the configuration."""
    status = F.col("o_orderstatus")
    hit = (F.col("o_custkey") % 4 == F.col("o_orderkey") % 4) | (F.col("o_totalprice") > 90000)
    predictions = table(spark, sf_dir, "orders").select(
        F.when(status == "P", "Model_A_TimeSeries").when(status == "F", "Model_B_NLP_Graph")
        .otherwise("Model_C_Multimodal").alias("model_id"),
        F.lit(1).alias("label"), hit.cast("int").alias("prediction"))
    refreshed = gate.refresh_config(
        catalog.config_table(spark), predictions, "2026-01-01 00:00:00")
    return refreshed.select("key", r("value").alias("value"))


@query("ranked_attributions", """
SELECT o_custkey, name, place, round(abs(value), 4) AS importance, round(value, 4) AS contribution
FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(value) DESC, name) AS place
  FROM (SELECT o_custkey, o_orderpriority AS name,
          sum(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) / CAST(1003.7 AS DOUBLE) AS value
        FROM orders GROUP BY 1, 2))
WHERE place <= 3""")
def ranked_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest contributions of every customer's map."""
    signed = F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    parts = table(spark, sf_dir, "orders").groupBy(
        "o_custkey", F.col("o_orderpriority").alias("name")).agg(
        (F.sum(signed) / 1003.7).alias("value"))
    maps = parts.groupBy("o_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    return learning.ranked_attributions(maps, "o_custkey", "m", 3)


@query("top_factors", f"""
SELECT o_custkey, string_agg(name || ' ' || format('{{:,.4f}}', contribution), ', ' ORDER BY place) AS top_factors
FROM ({ORACLE['ranked_attributions']}) GROUP BY 1""")
def top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per customer with its three strongest contributions."""
    return learning.top_factors_line(ranked_attributions(spark, sf_dir), "o_custkey")
