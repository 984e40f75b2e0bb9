"""Aligning several modality tables into one wide table per case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.catalog import NAMESPACE_COLUMNS, QUALITY_THRESHOLD, TEXTURE_FIELDS

NAMESPACES = tuple(NAMESPACE_COLUMNS)
# types of namespace fields that are no numbers, for columns that no fragment has
_OTHER_TYPES = {
    "primary_disease": "string", "negation_count": "long", "total_entities": "long",
    "has_nodule": "boolean", "disease_list": "array<string>", "artifact_severity": "string",
    "motion_blur_present": "boolean",
}
# flag names of the completeness struct, in its order
COMPLETENESS = {
    "has_clinical_nlp": "d_group_nlp", "has_time_series_labs": "d_group_stats",
    "has_radiomics_E": "group_e_radiomics", "has_simulation_A": "group_a_simulation",
    "has_quality_B": "group_b_quality", "has_pathology_C": "group_c_pathology",
}


def gather_namespaces(fragments: Mapping[str, DataFrame], key: str = "case_id",
                      names: Sequence[str] = NAMESPACES) -> DataFrame:
    """One row per case with one struct per namespace, null where the case has no fragment.

    All namespaces are unioned and grouped once, so the key is shuffled a single time however
    many namespaces there are.  Of several fragments of a case the largest struct is kept.
    A ``fragment_case_id`` column holding another id than the key is noted as a warning.
    """
    parts = []
    for name, df in fragments.items():
        if name not in names:
            raise ValueError(f"unknown namespace: {name}")
        own = F.col("fragment_case_id").cast("string") if "fragment_case_id" in df.columns \
            else F.lit(None).cast("string")
        values = [c for c in df.columns if c not in (key, "fragment_case_id")]
        parts.append(df.select(
            F.col(key), F.struct(*values).alias(name),
            F.when(own != F.col(key).cast("string"), own).alias("__other")))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    present = [n for n in names if n in fragments]
    grouped = united.groupBy(key).agg(
        *[F.max(n).alias(n) for n in present], F.max("__other").alias("__other"))
    missing = [n for n in names if n not in fragments]
    empty = T.StructType([T.StructField("__none", T.BooleanType())])
    return grouped.withColumns({n: F.lit(None).cast(empty) for n in missing}).withColumn(
        "alignment_warnings",
        F.array_compact(F.array(F.when(
            F.col("__other").isNotNull(),
            F.concat(F.lit("fragment of case "), F.col("__other")))))).drop("__other")


def _fields(df: DataFrame, struct: str) -> set[str]:
    return {f.name for f in df.schema[struct].dataType.fields}


def _mean_of(columns: list[Column]) -> Column:
    values = F.array_compact(F.array(*[c.cast("double") for c in columns]))
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(values) > 0, total / F.size(values))


def radiomics_mean(df: DataFrame, struct: str = "group_e_radiomics") -> Column:
    """texture_mean, or the mean of the texture fields that are there (2 digits)."""
    have = _fields(df, struct)
    fields = [F.col(f"{struct}.{f}") for f in TEXTURE_FIELDS if f in have]
    derived = F.round(_mean_of(fields), 2) if fields else F.lit(None).cast("double")
    given = F.col(f"{struct}.texture_mean") if "texture_mean" in have else F.lit(None)
    return F.coalesce(given.cast("double"), derived)


def radiomics_moments(columns: Sequence[str]) -> tuple[Column, Column]:
    """Row-wise mean and population standard deviation of numeric columns."""
    values = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    mean = _mean_of([F.col(c) for c in columns])
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return mean, F.when(F.size(values) > 0, F.sqrt(squares / F.size(values)))


def nlp_flags(entities: DataFrame, case: str = "case_id", order: str = "start") -> DataFrame:
    """Per case: negated findings and whether distant metastasis is affirmed."""
    negated = F.coalesce(F.col("negation_status"), F.lit(False))
    distant = F.when(F.col("standard_name") == "distant_metastasis", F.col(order))
    return entities.groupBy(case).agg(
        F.count_if(negated).alias("negation_count"),
        F.max(F.when(negated, True)).alias("has_negated_finding"),
        F.min_by(~negated, distant).alias("distant_metastasis"))


def _array_flags(df: DataFrame) -> dict[str, Column]:
    """The same flags where a case carries its entities as an array."""
    entities = F.col("d_group_nlp.entities")
    count = F.size(F.filter(entities, lambda e: F.coalesce(e["negation_status"], F.lit(False))))
    distant = F.get(F.filter(
        entities, lambda e: e["standard_name"] == "distant_metastasis"), F.lit(0))
    supplied = F.col("d_group_nlp.negation_count") if "negation_count" in _fields(
        df, "d_group_nlp") else F.lit(None).cast("long")
    return {
        "has_negated_finding": F.when(count > 0, F.lit(True)),
        "negation_count": F.when(
            count > 0, F.coalesce(supplied, count)).otherwise(supplied),
        "distant_metastasis": F.when(
            distant.isNotNull(), ~F.coalesce(distant["negation_status"], F.lit(False))),
    }


def quality_warning(score: Column, severity: Column, motion_blur: Column,
                    threshold: float = QUALITY_THRESHOLD) -> Column:
    """Low score, severe or moderate artifacts, or motion blur; false without quality data."""
    return (
        F.coalesce(score < threshold, F.lit(False))
        | F.coalesce(F.lower(severity).isin("severe", "moderate"), F.lit(False))
        | F.coalesce(motion_blur, F.lit(False))
    )


def completeness(flags: Mapping[str, Column], digits: int = 2) -> Column:
    """Presence flags, number present / expected and the overall missing rate."""
    present = sum((f.cast("int") for f in flags.values()), F.lit(0))
    expected = len(flags)
    return F.struct(
        *[f.alias(n) for n, f in flags.items()],
        present.alias("total_modalities_present"),
        F.lit(expected).alias("total_modalities_expected"),
        F.round(1 - present / expected, digits).alias("overall_missing_rate"))


def wide_table(fragments: Mapping[str, DataFrame], key: str = "case_id",
               patients: DataFrame | None = None, timestamp: str | None = None) -> DataFrame:
    """The aligned wide table: renamed features, completeness, quality warning, connections.

    Every column of all six namespaces is there, null where no fragment has it, so the schema
    does not depend on the input.  ``timestamp`` is a job parameter, so that a rerun gives the same rows.
    """
    gathered = gather_namespaces(fragments, key)
    features: dict[str, Column] = {}
    for name, mapping in NAMESPACE_COLUMNS.items():
        have = _fields(gathered, name)
        for raw, flat in mapping.items():
            features[flat or raw] = F.col(f"{name}.{raw}") if raw in have else F.lit(None).cast(
                _OTHER_TYPES.get(raw, "double"))
    if "group_e_radiomics" in fragments:
        features["radiomics_texture_mean"] = radiomics_mean(gathered)
    if "d_group_nlp" in fragments and "entities" in _fields(gathered, "d_group_nlp"):
        features.update(_array_flags(gathered))
    quality = _fields(gathered, "group_b_quality")

    def of_quality(field: str, kind: str) -> Column:
        return F.col(f"group_b_quality.{field}") if field in quality else F.lit(None).cast(kind)

    warning = quality_warning(
        of_quality("image_quality_score", "double"), of_quality("artifact_severity", "string"),
        of_quality("motion_blur_present", "boolean"))
    flags = {flag: F.col(ns).isNotNull() for flag, ns in COMPLETENESS.items()}
    connected = F.array_compact(F.array(*[
        F.when(F.col(ns).isNotNull(), F.lit(ns)) for ns in NAMESPACES]))
    wide = gathered.select(
        key, *[c.alias(n) for n, c in features.items()],
        completeness(flags).alias("modality_completeness"),
        warning.alias("quality_artifact_warning"),
        connected.alias("connected_groups"), F.size(connected).alias("total_groups_connected"),
        "alignment_warnings", F.lit(timestamp).cast("string").alias("timestamp"))
    return wide if patients is None else wide.join(patients, key, "left")


# The prefixed variant's columns and defaults, per namespace
PREFIXED = {
    "group_a_simulation": [("lesion_elasticity", "A_lesion_elasticity", 0.0)],
    "group_b_quality": [("artifact_level", "B_artifact_level", "unknown"),
                        ("quality_score", "B_quality_score", 1.0)],
    "group_c_labels": [("dice", "C_dice", 0.0), ("iou", "C_iou", 0.0)],
    "group_e_radiomics": [("texture_mean", "E_texture_mean", 0.0),
                          ("glcm_entropy", "E_glcm_entropy", 0.0),
                          ("shape_compactness", "E_shape_compactness", 0.0)],
    "d_group_nlp": [("entity_count", "D_entity_count", 0),
                    ("negation_count", "D_negation_count", 0)],
}


def prefixed_features(fragments: Mapping[str, DataFrame], key: str = "case_id") -> DataFrame:
    """Variant with prefixed columns; defaults fill missing fields of present namespaces."""
    names = [*PREFIXED, "d_group_stats"]
    gathered = gather_namespaces(fragments, key, names)
    out: dict[str, Column] = {}
    for name, columns in PREFIXED.items():
        have = _fields(gathered, name)
        there = F.col(name).isNotNull()
        for raw, flat, default in columns:
            value = F.lit(default)
            if raw in have:
                value = F.coalesce(F.col(f"{name}.{raw}"), value)
            out[flat] = F.when(there, value)
    out["B_quality_artifact_warning"] = out["B_quality_score"] < QUALITY_THRESHOLD
    if "group_e_radiomics" in fragments:
        numeric = [
            f"group_e_radiomics.{f.name}"
            for f in gathered.schema["group_e_radiomics"].dataType.fields
            if isinstance(f.dataType, T.NumericType)]
        mean, std = radiomics_moments(numeric)
        out["E_radiomics_mean"], out["E_radiomics_std"] = mean, std
    for field in sorted(_fields(gathered, "d_group_stats") - {"__none"}):
        out[f"D_{field}"] = F.col(f"d_group_stats.{field}")
    present = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    filled = sum((c.isNotNull().cast("int") for c in out.values()), F.lit(0))
    return gathered.select(
        key, *[c.alias(n) for n, c in out.items()],
        present.alias("total_groups_connected"),
        F.round(1 - present / len(names), 4).alias("overall_missing_rate"),
        filled.alias("feature_count"))


def sidecar(cases: DataFrame, features: DataFrame, out: str, case: str = "case_id",
            patient: str = "patient_id") -> DataFrame:
    """Features by case id, else by patient id, as one struct column (null when neither)."""
    packed = features.select(
        F.col(case).alias("__key"), F.struct(*[c for c in features.columns if c != case])
        .alias("__value"))
    by_case = packed.withColumnsRenamed({"__key": "__k1", "__value": "__v1"})
    by_patient = packed.withColumnsRenamed({"__key": "__k2", "__value": "__v2"})
    return (
        cases.join(by_case, F.col(case) == F.col("__k1"), "left")
        .join(by_patient, F.col(patient) == F.col("__k2"), "left")
        .withColumn(out, F.coalesce("__v1", "__v2"))
        .drop("__k1", "__v1", "__k2", "__v2")
    )
