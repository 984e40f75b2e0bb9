"""Writing reports, run records, tables and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_reports(records: DataFrame, path: str, partition: str = "report_kind") -> None:
    """Report records as JSON lines, one folder per report kind."""
    records.write.mode("overwrite").partitionBy(partition).json(path)


def write_report_bodies(lines: DataFrame, path: str) -> None:
    """The lines of whole reports as JSON lines, those of a case one after the other and in order.

    Files hold ranges of (case, section, line), sorted as they are written, so a report of any length streams through;
    a very long one goes on in the next file.
    """
    place = ["case_id", "section_no", "line_no"]
    lines.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("overwrite").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append run records (datasets, tasks, model results)."""
    rows.write.mode("append").parquet(path)


def write_version(table: DataFrame, root: str, version: int | str) -> str:
    """Write a table under a new version folder; readers of the old one are not disturbed."""
    path = f"{root.rstrip('/')}/version={version}"
    table.write.mode("overwrite").parquet(path)
    return path


def save_model(model: PipelineModel, path: str) -> None:
    """Scaler, model and feature names stay together in one pipeline."""
    model.write().overwrite().save(path)
