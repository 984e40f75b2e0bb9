"""Composed jobs: from raw lab rows to features, decisions and report rows, all cases at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark import catalog
from labspark.functions.names import strip_blanks
from labspark.functions.values import disease_of_label, to_number
from labspark.operators import dictionary, fusion, labs, reports, routing, trends


class Lookups:
    """The lookup tables a job joins with; each default is built when first used."""

    def __init__(self, spark: SparkSession, fields: DataFrame | None = None,
                 ranges: DataFrame | None = None, units: DataFrame | None = None,
                 markers: DataFrame | None = None, profiles: DataFrame | None = None):
        self.spark = spark
        given = {"fields": fields, "ranges": ranges, "units": units, "markers": markers,
                 "profiles": profiles}
        self.__dict__.update({k: v for k, v in given.items() if v is not None})

    @cached_property
    def fields(self) -> DataFrame:
        return catalog.field_table(self.spark)

    @cached_property
    def aliases(self) -> DataFrame:
        return dictionary.alias_index(self.fields)

    @cached_property
    def ranges(self) -> DataFrame:
        return catalog.range_table(self.spark)

    @cached_property
    def units(self) -> DataFrame:
        return catalog.unit_table(self.spark)

    @cached_property
    def markers(self) -> DataFrame:
        return catalog.marker_table(self.spark)

    @cached_property
    def profiles(self) -> DataFrame:
        return catalog.profile_table(self.spark)


def standardise(raw: DataFrame, lookups: Lookups, **defaults) -> DataFrame:
    return labs.standard_labs(raw, lookups.aliases, lookups.ranges, lookups.units, **defaults)


def summarise_cases(standard: DataFrame, order: str, slope_markers: Sequence[str],
                    age_column: str | None = None,
                    core_markers: DataFrame | None = None) -> DataFrame:
    """One row per case with everything later steps need from its lab rows.

    Patient id, anchor age, clinical features, longest series and line counts per marker come
    from one pass: rows are reduced to (case, marker) first and to the case after that, so lab
    rows are shuffled once, already aggregated.  ``marker_lines`` has one entry for each of the
    ``core_markers`` (a table with a column marker) that the case has, so its length is bounded by
    them; all other markers only count in ``all_lines`` and ``all_abnormal``.
    """
    first = F.col(order)
    extra = [
        F.min_by("patient_id", first).alias("patient"), F.min(first).alias("first"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("abnormal_flag") != "normal").alias("abnormal")]
    if age_column:
        extra.append(F.min_by(F.col(age_column).cast("string"), first).alias("age"))
    per_marker = trends.marker_summaries(
        standard, "case_id", "standard_item_name", "value", "test_time", order, extra)
    core = F.lit(False)
    if core_markers is not None:
        known = core_markers.select(F.col("marker").alias("__marker")).distinct().withColumn("__core", F.lit(True))
        per_marker = per_marker.join(known, F.col("standard_item_name") == F.col("__marker"), "left")
        core = F.coalesce("__core", F.lit(False))
    aggregates = [
        F.coalesce(F.min_by("patient", "first"), F.col("case_id"), F.lit("unknown_patient"))
        .alias("patient_id"),
        F.max("n").cast("int").alias("time_series_steps"),
        *trends.feature_aggregates("standard_item_name", slope_markers),
        F.collect_list(F.when(core, F.struct("standard_item_name", "lines", "abnormal"))).alias("marker_lines"),
        F.sum("lines").alias("all_lines"), F.sum("abnormal").alias("all_abnormal")]
    if age_column:
        aggregates.append(F.round(to_number(F.min_by("age", "first")), 2).alias("anchor_age"))
    return per_marker.groupBy("case_id").agg(*aggregates)


def case_payload(standard: DataFrame, order: str, slope_markers: Sequence[str],
                 text_features: DataFrame | None = None,
                 radiomics_features: DataFrame | None = None,
                 age_column: str | None = None, core_markers: DataFrame | None = None) -> DataFrame:
    """The case summary with its sidecar features."""
    payload = summarise_cases(standard, order, slope_markers, age_column, core_markers)
    for name, table in (("text_features", text_features),
                        ("radiomics_features", radiomics_features)):
        if table is not None:
            payload = fusion.sidecar(payload, table, name)
    return payload


def with_profile(payload: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Add the router's input: disease, entity count, radiomics presence, missing rate.

    ``entities`` has one row per entity with its case_id.
    """
    if entities is not None:
        counts = entities.groupBy("case_id").agg(
            F.count(F.lit(1)).cast("int").alias("nlp_entities_count"))
        payload = payload.join(counts, "case_id", "left")
    count = F.col("nlp_entities_count") if entities is not None else F.lit(None).cast("int")

    def there(column: str):
        return F.col(column).isNotNull() if column in payload.columns else F.lit(False)

    has_series = F.coalesce("time_series_steps", F.lit(0)) > 0
    has_text = there("text_features") | (F.coalesce(count, F.lit(0)) > 0)
    has_radiomics = there("radiomics_features")
    present = sum((c.cast("int") for c in (has_series, has_text, has_radiomics)), F.lit(0))
    disease = F.col("primary_disease") if "primary_disease" in payload.columns else F.lit(None)
    return payload.withColumns({
        "primary_disease": routing.default_disease(
            disease.cast("string"), F.col("CEA_level").cast("double")),
        "nlp_entities_count": F.coalesce(count, F.lit(0)),
        "has_group_E_radiomics": has_radiomics,
        "missing_rate": F.round(1 - present / 6, 2)})


def decide_and_report(raw: DataFrame, lookups: Lookups, order: str,
                      slope_markers: Sequence[str], text_features: DataFrame | None = None,
                      radiomics_features: DataFrame | None = None,
                      entities: DataFrame | None = None, artifacts: DataFrame | None = None,
                      live: Mapping[str, float] | None = None) -> DataFrame:
    """Routing decision and report record of every case, from raw lab rows.

    The report's disease follows from the name of the routed disease by the keyword rules.
    Decisions and line counts are computed on the case summary; no step goes back to the rows.
    """
    payload = case_payload(
        standardise(raw, lookups), order, slope_markers, text_features, radiomics_features,
        core_markers=lookups.markers.filter("role = 'primary'"))
    decided = routing.decide(with_profile(payload, entities), live=live).withColumn(
        "primary_disease", disease_of_label(F.col("target_disease_cn")))
    records = reports.count_marker_lines(
        reports.report_header(decided), lookups.markers).drop(
        "marker_lines", "all_lines", "all_abnormal", "models")
    return records if artifacts is None else reports.with_artifacts(records, artifacts)


def lab_trends(standard: DataFrame, lookups: Lookups, order: Sequence[str],
               keys: Sequence[str] = ("patient_id", "standard_item_name")) -> DataFrame:
    """Half-split direction per patient and item with bounds from the dictionary's text range.

    Items are matched ignoring case; items missing from the dictionary take their bounds and
    unit from the fallback profiles, and items of neither are left out.  The direction's spread
    is the profile's, else the series' own.
    """
    fields = trends.with_text_range(lookups.fields).select(
        F.lower("standard_name").alias("__item"), "chinese_name", F.col("unit").alias("f_unit"),
        F.col("reference_low").alias("f_low"), F.col("reference_high").alias("f_high"))
    profiles = lookups.profiles.withColumn("__item", F.lower("standard_name")).drop(
        "standard_name")
    known = fields.join(profiles, "__item", "full").select(
        "__item", F.coalesce("chinese_name", "title").alias("chinese_name"),
        F.coalesce("f_unit", "profile_unit").alias("item_unit"),
        F.coalesce("f_low", "profile_low").alias("reference_low"),
        F.coalesce("f_high", "profile_high").alias("reference_high"), "spread")
    item = F.lower(strip_blanks(F.col(keys[-1])))
    bounded = standard.drop("reference_low", "reference_high").join(
        known, item == F.col("__item")).drop("__item")
    return trends.half_split_trend(bounded, keys, "value", order, spread="spread")
