"""Schemas of the tables the library reads and writes, as DDL text.

``struct`` turns one into a StructType; it needs a running session.
"""

from __future__ import annotations

from pyspark.sql import types as T


def struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


LABS = (
    "case_id string, patient_id string, visit_id string, item_name string, value string,"
    " unit string, test_time string")

FIELD_DICTIONARY = (
    "standard_name string, chinese_name string, english_name string, abbreviation string,"
    " alias_names array<string>, data_type string, unit string, category string,"
    " reference_range string,"
    " relevance map<string, struct<weight: double, is_core: boolean,"
    " threshold_alert: string, note: string>>, ord int")

REFERENCE_RANGES = (
    "marker string, reference_low double, reference_high double, reference_unit string,"
    " critical_low double, critical_high double")

UNIT_FACTORS = (
    "marker string, unit string, factor double, standard_unit string, standard_factor double")

DISEASE_MARKERS = ("disease string, marker string, role string")

TREND_PROFILES = (
    "standard_name string, profile_low double, profile_high double, profile_unit string,"
    " spread double, title string")

CONFIG = ("key string, value double, description string")

DATASETS = (
    "dataset_name string, source string, row_count long, column_count int,"
    " columns array<string>, created_time timestamp")

ANALYSIS_TASKS = (
    "task_id string, dataset_id string, task_type string, target_variable string,"
    " feature_variables string, algorithm_name string, parameter_json string, status string,"
    " created_time timestamp")

MODEL_RESULTS = (
    "model_id string, task_id string, model_name string, task_type string, train_score double,"
    " test_score double, metric_json string, model_path string, created_time timestamp")

LAB_EVENTS = ("subject_id long, itemid int, valuenum double, charttime timestamp")

SUBJECTS = ("subject_id long, anchor_age int, gender string")

DIALOGUE = ("self_report string, diagnosis string")

ARTIFACT = (
    "case_id string, artifact_type string, artifact_level int, psnr double, ssim double,"
    " lpips double, edge_preservation double, lesion_visibility_score double,"
    " organ_quality_score double, restored_status boolean, note string")

TEXT_FEATURES = ("self_report string")

RADIOMICS_FEATURES = ("texture_mean double, area_mean double, smoothness double")

PATIENT_PROFILE = (
    "patient_id string, primary_disease string, time_series_steps int,"
    " nlp_entities_count int, has_group_E_radiomics boolean, missing_rate double")

# one row per clause with entities; doc_id takes the type of the documents' id
SPAN_CLAUSES = (
    "doc_id long, clause_no int, clause string, spans array<struct<entity: string,"
    " entity_type: string, start: int, end: int, standard_name: string, confidence: double,"
    " sentence_no: int, in_clause_at: int>>")
