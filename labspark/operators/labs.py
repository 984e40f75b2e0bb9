"""Cleaning and standardising lab rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.names import strip_blanks
from labspark.functions.values import abnormal_flag, drop_nan, parse_time, to_number

WIDE_ID_COLUMNS = ("case_id", "patient_id", "visit_id", "test_time", "id", "ord")


def filter_case(df: DataFrame, case_id: str | None) -> DataFrame:
    """Rows of one case; all rows when no id is given or the table has no case column."""
    if not case_id or "case_id" not in [c.lower() for c in df.columns]:
        return df
    return df.filter(F.col("case_id").cast("string") == F.lit(case_id))


def with_defaults(df: DataFrame, patient_id: str | None = None,
                  visit_id: str | None = None) -> DataFrame:
    """Fill the optional attributes: row value, else the caller's default, else null."""
    present = {c.lower() for c in df.columns}
    defaults = {"case_id": None, "patient_id": patient_id, "visit_id": visit_id,
                "unit": None, "test_time": None}
    added = {}
    for name, default in defaults.items():
        fallback = F.lit(default).cast("string")
        added[name] = (
            F.coalesce(F.col(name).cast("string"), fallback) if name in present else fallback)
    return df.withColumns(added)


def is_long_layout(df: DataFrame) -> bool:
    return {"item_name", "value"} <= {c.lower() for c in df.columns}


def wide_to_long(df: DataFrame, id_columns: Sequence[str] = WIDE_ID_COLUMNS) -> DataFrame:
    """One row per item of every wide row."""
    ids = [c for c in df.columns if c.lower() in id_columns]
    items = [c for c in df.columns if c.lower() not in id_columns]
    as_text = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in items])
    return as_text.unpivot(ids, items, "item_name", "value")


def with_standard_name(df: DataFrame, alias_index: DataFrame, name: str = "item_name",
                       out: str = "standard_item_name") -> DataFrame:
    """Exact alias, else lower-case alias, else the trimmed raw name.

    ``alias_index`` holds unique (alias, standard_name) pairs.
    """
    trimmed = strip_blanks(F.col(name))
    exact = alias_index.select(
        F.col("alias").alias("__a1"), F.col("standard_name").alias("__s1"))
    lower = alias_index.select(
        F.col("alias").alias("__a2"), F.col("standard_name").alias("__s2"))
    return (
        df.join(exact, trimmed == F.col("__a1"), "left")
        .join(lower, F.lower(trimmed) == F.col("__a2"), "left")
        .withColumn(out, F.coalesce("__s1", "__s2", trimmed))
        .drop("__a1", "__a2", "__s1", "__s2")
    )


def with_reference(df: DataFrame, ranges: DataFrame,
                   marker: str = "standard_item_name") -> DataFrame:
    """Attach reference and critical bounds; markers without a range get nulls."""
    return df.join(
        ranges.withColumnRenamed("marker", "__marker"),
        F.col(marker) == F.col("__marker"), "left").drop("__marker")


def with_flag(df: DataFrame, value: str = "value", out: str = "abnormal_flag") -> DataFrame:
    return df.withColumn(out, abnormal_flag(
        F.col(value), F.col("reference_low"), F.col("reference_high"),
        F.col("critical_low"), F.col("critical_high")))


def with_standard_unit(df: DataFrame, units: DataFrame, marker: str = "standard_item_name",
                       value: str = "value", unit: str = "unit") -> DataFrame:
    """Convert to the marker's standard unit; unknown markers and units stay as they are.

    Values are rounded to 4 digits wherever marker, value and unit are present.
    """
    factors = units.select(
        F.col("marker").alias("__marker"), F.col("unit").alias("__unit"),
        "factor", "standard_unit", "standard_factor")
    same_unit = F.col(unit) == F.col("standard_unit")
    converted = (
        F.when(F.col("factor").isNotNull() & ~same_unit,
               F.col(value) / F.col("factor") * F.col("standard_factor"))
        .otherwise(F.col(value)))
    known = F.col(marker).isNotNull() & F.col(value).isNotNull() & F.col(unit).isNotNull()
    return (
        df.join(factors, (F.col(marker) == F.col("__marker")) & (F.col(unit) == F.col("__unit")),
                "left")
        .withColumns({
            value: F.when(known, F.round(converted, 4)).otherwise(F.col(value)),
            unit: F.when(known, F.coalesce("standard_unit", unit)).otherwise(F.col(unit)),
        })
        .drop("__marker", "__unit", "factor", "standard_unit", "standard_factor")
    )


def standard_labs(df: DataFrame, alias_index: DataFrame, ranges: DataFrame, units: DataFrame,
                  patient_id: str | None = None, visit_id: str | None = None,
                  flag_before_convert: bool = False) -> DataFrame:
    """Raw lab rows (long or wide) to standardised rows with unit, bounds and flag.

    Units are converted before flagging so that value and range share a unit;
    ``flag_before_convert=True`` compares the raw value instead.
    """
    long = df if is_long_layout(df) else wide_to_long(df)
    value = F.col("value")
    if dict(long.dtypes)[next(c for c in long.columns if c.lower() == "value")] == "string":
        value = to_number(value)
    rows = with_defaults(long, patient_id, visit_id).withColumn(
        "value", drop_nan(value.cast("double")))
    named = with_standard_name(rows, alias_index)
    bounded = with_reference(named, ranges).withColumn(
        "unit", F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.col("reference_unit")))
    if flag_before_convert:
        result = with_standard_unit(with_flag(bounded), units)
    else:
        result = with_flag(with_standard_unit(bounded, units))
    if dict(result.dtypes)["test_time"] == "string":  # dates and timestamps stay as they are
        result = result.withColumn("test_time", parse_time(F.col("test_time")))
    return result.withColumn("test_time", F.col("test_time").cast("timestamp")).drop(
        "reference_unit", "critical_low", "critical_high")


def text_labs(df: DataFrame, text: str = "text") -> DataFrame:
    """Lab values written as 'name[:] number [unit]' in free text, one row per match."""
    # Fixed value: the pattern
    pattern = r"(?U)([一-龥A-Za-z0-9%\-]+)\s*[:：]?\s*([0-9.]+)\s*([A-Za-z/%μ^0-9·/.-]*)"
    # whole matches in one pass over the text, then the groups of each short match
    matches = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    zipped = F.transform(matches, lambda m: F.struct(*[
        F.regexp_extract(m, pattern, i).alias(n)
        for i, n in enumerate(("item_name", "value", "unit"), 1)]))
    other = [c for c in df.columns if c != text]
    return (
        df.select(*other, F.posexplode(zipped).alias("match_no", "__m"))
        .select(*other, "match_no",
                F.col("__m")["item_name"].alias("item_name"),
                F.col("__m")["value"].alias("value"),
                F.nullif(F.col("__m")["unit"], F.lit("")).alias("unit"))
    )


def single_case_id(df: DataFrame, case_id: str | None = None) -> DataFrame:
    """One row: the given id, else the table's only case id, else null."""
    low, high = F.min("case_id"), F.max("case_id")
    only = F.when(low == high, low)
    return df.agg(F.coalesce(F.lit(case_id).cast("string"), only).alias("case_id"))


def case_attributes(df: DataFrame, order: str, age_column: str | None = None) -> DataFrame:
    """Patient id and anchor age of each case, from its first row by ``order``."""
    aggregates = [
        F.coalesce(F.min_by("patient_id", order), F.col("case_id"),
                   F.lit("unknown_patient")).alias("patient_id")]
    if age_column:
        age = F.min_by(F.col(age_column).cast("string"), F.col(order))
        aggregates.append(F.round(to_number(age), 2).alias("anchor_age"))
    return df.groupBy("case_id").agg(*aggregates)


def first_patient_id(df: DataFrame, order: str, patient_id: str | None = None,
                     case_id: str | None = None) -> DataFrame:
    """One row: given id, else first row of the case, else of the table, else the case id."""
    of_case = F.lit(None).cast("string") if case_id is None else F.min_by(
        F.col("patient_id"), F.when(F.col("case_id") == case_id, F.col(order)))
    return df.agg(F.coalesce(
        F.lit(patient_id).cast("string"), of_case, F.min_by("patient_id", order),
        F.lit(case_id).cast("string"), F.lit("unknown_patient")).alias("patient_id"))


def split_by_disease(labs: DataFrame, markers: DataFrame, disease: str = "primary_disease",
                     marker: str = "standard_item_name", out: str = "is_core") -> DataFrame:
    """Mark rows of the disease's primary markers; unknown diseases use the default set."""
    primary = markers.filter(F.col("role") == "primary").select(
        F.col("disease").alias("__d"), F.col("marker").alias("__m")).distinct()
    known = markers.select(F.col("disease").alias("__k")).distinct()
    return (
        labs.join(known, F.col(disease) == F.col("__k"), "left")
        .withColumn("__set", F.coalesce("__k", F.lit("default")))
        .join(primary, (F.col("__set") == F.col("__d")) & (F.col(marker) == F.col("__m")), "left")
        .withColumn(out, F.col("__d").isNotNull())
        .drop("__k", "__set", "__d", "__m")
    )


def flag_counts(df: DataFrame, keys: Sequence[str], flag: str = "abnormal_flag",
                where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys, flag).agg(F.count(F.lit(1)).alias("n"))
