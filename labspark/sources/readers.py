"""Reading lab tables, dialogues, keyed JSON and notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark import schemas


def _extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    name = name.removesuffix(".gz")
    return name.rsplit(".", 1)[-1] if "." in name else ""


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A lab dataset by extension: csv, json or parquet; anything else is an error."""
    kind = _extension(path)
    if kind == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if kind == "json":
        return read_json_records(spark, path, schema)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: .{kind}")


def read_json_records(spark: SparkSession, path: str,
                      schema: str | T.StructType | None = None) -> DataFrame:
    """JSON as a list of records, an object with a ``labs`` list, or a single object."""
    if schema is not None:
        schema = schemas.struct(schema)
        wrapped = T.StructType([T.StructField("labs", T.ArrayType(schema)), *schema.fields])
        df = spark.read.schema(wrapped).json(path, multiLine=True)
        packed = F.struct(*schema.names)
        rows = F.when(F.col("labs").isNotNull(), F.col("labs")).otherwise(F.array(packed))
        return df.select(F.inline(rows))
    df = spark.read.json(path, multiLine=True)
    return df.select(F.inline("labs")) if "labs" in df.columns else df


def read_csv_or_gzip(spark: SparkSession, path: str, required: Sequence[str],
                     schema: str | T.StructType | None = None, partitions: int | None = None) -> DataFrame:
    """``path`` or ``path.gz``; gzip cannot be split, so its rows are spread out after reading."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    try:
        df = reader.csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        df = reader.csv(path + ".gz")
        df = df.repartition(partitions) if partitions else df.repartition(
            spark.sparkContext.defaultParallelism)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def absent_codes(df: DataFrame, item: str, expected: DataFrame) -> DataFrame:
    """Expected item codes that do not occur."""
    return expected.join(df.select(item).distinct(), item, "left_anti")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """One document per file; the id is the file stem."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"))


def parse_keyed_json(texts: DataFrame, value: str | T.StructType, key: str = "case_id",
                     text: str = "value") -> DataFrame:
    """JSON texts of the form ``{key: {...}}``, one row per key.

    Every value is parsed on its own: one that is no object gives a row of nulls, not a lost text.
    """
    value = schemas.struct(value)
    entries = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    rows = texts.select(F.explode(entries).alias(key, "__t")).select(
        key, F.from_json("__t", value).alias("__v"))
    fields = [f for f in value.names if f != key]
    return rows.select(key, *[F.col(f"__v.{f}").alias(f) for f in fields])


def read_keyed_json(spark: SparkSession, path: str, value: str | T.StructType,
                    key: str = "case_id") -> DataFrame:
    """Files of the form that :func:`parse_keyed_json` takes, each read whole."""
    return parse_keyed_json(spark.read.text(path, wholetext=True), value, key)


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Files of keyed dialogue records with a ``kept`` mark."""
    return dialogues(read_keyed_json(spark, path, schemas.DIALOGUE, "record_id"))


def dialogues(rows: DataFrame) -> DataFrame:
    """Dialogue records with a ``kept`` mark: both texts present after trimming."""
    trimmed = rows.withColumns({
        c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
        for c in ("self_report", "diagnosis")})
    return trimmed.withColumn(
        "kept", (F.col("self_report") != "") & (F.col("diagnosis") != ""))


def dialogue_counts(dialogues: DataFrame) -> DataFrame:
    return dialogues.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"))


def dataset_profile(df: DataFrame, name: str, source: str, created_time) -> DataFrame:
    """The row that registers a dataset: counts, columns, source and time."""
    return df.agg(
        F.lit(name).alias("dataset_name"), F.lit(source).alias("source"),
        F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.lit(created_time).cast("timestamp").alias("created_time"))
