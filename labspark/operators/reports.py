"""Report rows per case, model lists and task records."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark import schemas
from labspark.catalog import BUILTIN_MODELS, DISEASE_MARKERS, local_table
from labspark.operators.labs import split_by_disease
from labspark.operators.learning import ranked_attributions
from labspark.operators.ordering import with_positions


def _by_disease(disease: Column, what: str, markers: Mapping | None = None) -> Column:
    table = markers or DISEASE_MARKERS
    out = F.lit(table["default"][what])
    for name, cfg in table.items():
        if name != "default":
            out = F.when(disease == name, cfg[what]).otherwise(out)
    return out


def report_kind(warnings: Column) -> Column:
    """'data_missing' when a data quality warning is present, else 'disease'."""
    hit = F.exists(F.coalesce(warnings, F.array().cast("array<string>")),
                   lambda w: F.contains(w, F.lit("DataQualityWarning")))
    return F.when(hit, "data_missing").otherwise("disease")


def report_header(cases: DataFrame) -> DataFrame:
    """Title, summary and kind of every case's report.

    ``cases`` has case_id, patient_id, primary_disease and optionally clinical_summary (an
    override) and quality_warnings.
    """
    disease = F.coalesce("primary_disease", F.lit("default"))
    own = F.col("clinical_summary") if "clinical_summary" in cases.columns else F.lit(None)
    warnings = (F.col("quality_warnings") if "quality_warnings" in cases.columns
                else F.array().cast("array<string>"))
    return cases.withColumns({
        "report_title": _by_disease(disease, "title"),
        "clinical_summary": F.coalesce(own.cast("string"), _by_disease(disease, "summary")),
        "report_kind": report_kind(warnings)})


def report_lines(labs: DataFrame, cases: DataFrame, markers: DataFrame) -> DataFrame:
    """Lab lines of every report, marked core or appendix by the case's disease.

    Lines stay rows: a case with any number of results never becomes one array.
    """
    with_disease = labs.join(cases.select("case_id", "primary_disease"), "case_id")
    return split_by_disease(with_disease, markers).withColumn(
        "section", F.when(F.col("is_core"), "core").otherwise("appendix")).drop("is_core")


def count_marker_lines(cases: DataFrame, markers: DataFrame) -> DataFrame:
    """Core, appendix and abnormal line counts of every case.

    ``marker_lines`` holds the case's core markers of any disease, ``all_lines`` and
    ``all_abnormal`` count every line.
    """
    sets = markers.groupBy("disease").agg(F.collect_set(
        F.when(F.col("role") == "primary", F.col("marker"))).alias("__primary"))
    known = sets.select(F.col("disease").alias("__known"))
    chosen = (
        cases.join(known, F.col("primary_disease") == F.col("__known"), "left")
        .withColumn("__set", F.coalesce("__known", F.lit("default")))
        .join(sets, F.col("__set") == F.col("disease"), "left")
    )

    def total(lines: Column, field: str) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda a, m: a + m[field])

    core = F.filter("marker_lines", lambda m: F.array_contains(
        F.col("__primary"), m["standard_item_name"]))
    return chosen.withColumns({
        "core_lines": total(core, "lines"),
        "appendix_lines": F.col("all_lines") - total(core, "lines"),
        "abnormal_lines": F.col("all_abnormal"),
    }).drop("__known", "__set", "__primary", "disease")


def with_artifacts(cases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifact metrics of the case as one struct, null when there are none."""
    packed = artifacts.select("case_id", F.struct(
        *[c for c in artifacts.columns if c != "case_id"]).alias("artifact_metrics"))
    return cases.join(packed, "case_id", "left")


def report_records(labs: DataFrame, cases: DataFrame, markers: DataFrame,
                   predictions: DataFrame | None = None,
                   artifacts: DataFrame | None = None) -> DataFrame:
    """One record per case: header, line counts by section and flag, prediction, artifacts."""
    lines = report_lines(labs, cases, markers)
    counts = lines.groupBy("case_id").agg(
        F.count_if(F.col("section") == "core").alias("core_lines"),
        F.count_if(F.col("section") == "appendix").alias("appendix_lines"),
        F.count_if(F.col("abnormal_flag") != "normal").alias("abnormal_lines"))
    records = report_header(cases).join(counts, "case_id", "left")
    if predictions is not None:
        records = records.join(predictions, "case_id", "left")
    if artifacts is not None:
        records = with_artifacts(records, artifacts)
    return records


#: Sections of a report in their order.
SECTIONS = ("header", "core", "appendix", "prediction", "importance", "artifacts")


def _line(section: str, place: Column, name: Column, number: Column | None = None, text: Column | None = None,
          flag: Column | None = None) -> list[Column]:
    def or_null(value: Column | None, kind: str) -> Column:
        return F.lit(None).cast(kind) if value is None else value.cast(kind)

    return ["case_id", F.lit(SECTIONS.index(section)).alias("section_no"), F.lit(section).alias("section"),
            place.cast("long").alias("line_no"), name.alias("name"), or_null(number, "double").alias("number"),
            or_null(text, "string").alias("text"), or_null(flag, "string").alias("flag")]


def _field_lines(rows: DataFrame, section: str) -> DataFrame:
    """One line per filled column of one row per case, in the order of the columns."""
    kinds = dict(rows.dtypes)
    fields = [F.struct(
        F.lit(i).alias("i"), F.lit(c).alias("name"),
        (F.lit(None).cast("double") if kinds[c] == "string" else F.col(c).cast("double")).alias("number"),
        (F.col(c) if kinds[c] == "string" else F.lit(None).cast("string")).alias("text"))
        for i, c in enumerate(c for c in rows.columns if c != "case_id")]
    lines = rows.select("case_id", F.explode(F.array(*fields)).alias("f")).where(
        "f.number is not null or f.text is not null")
    return lines.select(*_line(section, F.col("f.i"), F.col("f.name"), F.col("f.number"), F.col("f.text")))


def report_body(labs: DataFrame, cases: DataFrame, markers: DataFrame, order: list[str],
                predictions: DataFrame | None = None, attributions: DataFrame | None = None,
                artifacts: DataFrame | None = None, top: int = 10) -> DataFrame:
    """The whole report of every case as ordered lines: header, core and appendix labs, prediction, importance, artifacts.

    ``labs`` has case_id, standard_item_name, value, abnormal_flag and the columns of ``order``, which place
    the lines of one item; ``predictions`` and ``artifacts`` one row per case; ``attributions`` case_id and a map
    ``contributions``, of which the ``top`` largest are ranked. Lines stay rows (case_id, section_no, section, line_no, name,
    number, text, flag): neither a report nor its labs ever meet in one array.
    """
    head = report_header(cases).select("case_id", "report_title", "clinical_summary", "report_kind")
    lines = _field_lines(head, "header")
    split = with_positions(report_lines(labs, cases, markers), ["case_id", "section"],
                           ["standard_item_name", *order], "__place")
    for section in ("core", "appendix"):
        lines = lines.unionByName(split.where(F.col("section") == section).select(*_line(
            section, F.col("__place"), F.col("standard_item_name"), F.col("value"), flag=F.col("abnormal_flag"))))
    if predictions is not None:
        lines = lines.unionByName(_field_lines(predictions, "prediction"))
    if attributions is not None:
        ranked = ranked_attributions(attributions, "case_id", "contributions", top)
        lines = lines.unionByName(ranked.select(*_line(
            "importance", F.col("place") - 1, F.col("name"), F.col("contribution"))))
    if artifacts is not None:
        lines = lines.unionByName(_field_lines(artifacts, "artifacts"))
    return lines


def list_models(results: DataFrame, tasks: DataFrame, include_builtin: bool = True) -> DataFrame:
    """Stored model results with their task, then the built-in models, newest first."""
    stored = results.join(tasks.select(
        "task_id", F.col("algorithm_name").alias("algorithm"), "target_variable",
        F.col("status").alias("task_status")), "task_id", "left").withColumn(
        "source", F.lit("database"))
    if include_builtin:
        cards = local_table(results.sparkSession, BUILTIN_MODELS, (
            "model_id string, model_name string, task_type string, algorithm string,"
            " test_score double")).withColumn("source", F.lit("builtin"))
        stored = stored.unionByName(cards, allowMissingColumns=True)
    return stored.orderBy(F.desc_nulls_last("created_time"), "model_id")


def task_records(spark, task_id: str, model_id: str, name: str, task_type: str, algorithm: str,
                 target: str, features: list[str], parameters: dict, metrics: dict,
                 train_score: float, test_score: float, model_path: str,
                 created_time) -> tuple[DataFrame, DataFrame]:
    """(analysis task row, model result row) of one training run, JSON columns included."""
    task = local_table(spark, [(
        task_id, "dataset", task_type, target, json.dumps(features, ensure_ascii=False),
        algorithm, json.dumps(parameters), "Completed", created_time)], schemas.ANALYSIS_TASKS)
    result = local_table(spark, [(
        model_id, task_id, name, task_type, train_score, test_score,
        json.dumps(metrics, ensure_ascii=False), model_path, created_time)],
        schemas.MODEL_RESULTS)
    return task, result
