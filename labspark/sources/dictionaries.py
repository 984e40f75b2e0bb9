"""Loading dictionaries and registries from their JSON files.

These are configuration files of fixed shape and small size, read once on the driver.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from labspark import catalog


def _load(path: str):
    return json.loads(Path(path).read_text(encoding="utf-8"))


def load_fields(spark: SparkSession, path: str) -> DataFrame:
    """Field dictionary, as a list of fields or as a mapping from standard name to field."""
    fields = _load(path).get("fields", [])
    if isinstance(fields, dict):
        fields = [{"standard_name": name, **field} for name, field in fields.items()]
    rows = []
    for field in fields:
        row = dict(field)
        row["relevance"] = row.pop("disease_relevance_matrix", row.get("relevance"))
        bounds = row.get("reference_range")
        if isinstance(bounds, dict):
            row["reference_range"] = f"{bounds.get('low')}-{bounds.get('high')}"
        rows.append(row)
    return catalog.field_table(spark, rows)


def load_ranges(spark: SparkSession, path: str) -> DataFrame:
    rows = [
        (marker, _number(r.get("reference_low")), _number(r.get("reference_high")), r.get("unit"),
         _number(r.get("critical_low")), _number(r.get("critical_high")))
        for marker, r in _load(path).items()
    ]
    return catalog.range_table(spark, rows)


def load_units(spark: SparkSession, path: str) -> DataFrame:
    factors = {}
    for marker, cfg in _load(path).items():
        standard = cfg["standard_unit"]
        factors[marker] = (
            standard, {u: float(f) for u, f in cfg.items() if u != "standard_unit"})
    return catalog.unit_table(spark, factors)


def load_markers(spark: SparkSession, path: str) -> DataFrame:
    return catalog.marker_table(spark, _load(path))


def load_registry(path: str) -> list[dict]:
    """Model registry in the shape the routing functions take."""
    models = []
    for model in _load(path)["models"].values():
        needs, sensitivity = model["required_modalities"], model["modality_sensitivity"]
        models.append({
            "model_id": model["model_id"], "model_name": model["model_name"],
            "version": model["version"],
            "ts_min": needs.get("time_series_steps", {}).get("min", 0),
            "nlp_min": needs.get("nlp_entities_count", {}).get("min", 0),
            "rad_required": needs.get("has_group_E_radiomics", False),
            "sens_ts": sensitivity.get("time_series_missing", 0.5),
            "sens_nlp": sensitivity.get("nlp_missing", 0.5),
            "sens_rad": sensitivity.get("radiomics_missing", 0.5),
            "f1": model.get("historical_f1_score", {}),
        })
    return models


def _number(value) -> float | None:
    return None if value is None else float(value)
