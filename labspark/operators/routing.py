"""Scoring every patient profile against the model registry.

The registry is a handful of models, so it travels as literals in the plan: each profile row
computes all its scores in place, and choosing the winner needs neither a join nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.catalog import (
    CONFIG_KEY_OF_MODEL, DISEASE_NAMES, MODEL_REGISTRY, ROUTING_WEIGHTS, SIMPLE_REGISTRY)


def default_disease(primary_disease: Column, cea: Column) -> Column:
    """Given disease, else lung when CEA > 8, else diabetes."""
    # Disease ids and the CEA bound
    return F.coalesce(
        primary_disease,
        F.when(cea > 8, "Lung_Oncology").otherwise("Diabetes_Nephropathy"))


def router_columns(payload: DataFrame) -> DataFrame:
    """Only the four contract columns that are there."""
    contract = ("patient_id", "clinical_features", "text_features", "radiomics_features")
    return payload.select(*[c for c in contract if c in payload.columns])


def live_scores(config: DataFrame) -> dict[str, float]:
    """Model id -> live score (0-100) from the configuration table (at most one row a model)."""
    model_of = {k: m for m, k in CONFIG_KEY_OF_MODEL.items()}
    rows = config.filter(F.col("key").isin(list(model_of)) & F.col("value").isNotNull()).groupBy(
        "key").agg(F.max("value").alias("value")).collect()
    return {model_of[r["key"]]: r["value"] for r in rows}


def _need(have: Column, minimum: int) -> Column:
    """Share of the needed amount that is there, at most 1."""
    return F.lit(1.0) if minimum <= 0 else F.least(
        F.lit(1.0), F.greatest(have, F.lit(0)) / F.lit(float(minimum)))


def _shortfall(have: Column, minimum: int) -> Column:
    return F.lit(0.0) if minimum <= 0 else F.greatest(
        F.lit(0.0), 1 - have / F.lit(float(minimum)))


def case_fit(model: Mapping) -> tuple[Column, Column]:
    """(modality fit, missing penalty) of the profile columns for one model, both 0..1."""
    steps = F.coalesce("time_series_steps", F.lit(0))
    entities = F.coalesce("nlp_entities_count", F.lit(0))
    radiomics = F.coalesce("has_group_E_radiomics", F.lit(False))
    missing = F.coalesce("missing_rate", F.lit(0.0))
    lacks = F.lit(False) if not model["rad_required"] else ~radiomics
    fit = (
        _need(steps, model["ts_min"]) + _need(entities, model["nlp_min"])
        + F.when(lacks, 0.2).otherwise(1.0)) / 3.0
    penalty = (
        F.lit(float(model["sens_ts"])) * _shortfall(steps, model["ts_min"]) * 0.5
        + F.lit(float(model["sens_nlp"])) * _shortfall(entities, model["nlp_min"]) * 0.5
        + F.when(lacks, F.lit(model["sens_rad"] * 0.8)).otherwise(0.0)
        + missing * 0.3)
    return fit, F.least(F.lit(1.0), penalty)


def _history(model: Mapping, live: Mapping[str, float] | None) -> tuple[Column, str]:
    """Live score, else the registry F1 of the disease, else 0.5."""
    if live and model["model_id"] in live:
        return F.lit(live[model["model_id"]] / 100.0), "live"
    f1 = model["f1"]
    if not isinstance(f1, Mapping):
        return F.lit(float(f1)), "registry"
    out = F.lit(0.5)
    for disease, score in f1.items():
        out = F.when(F.col("primary_disease") == disease, score).otherwise(out)
    return out, "registry"


def _losing_reasons(model: Mapping) -> Column:
    reasons = []
    if model["rad_required"]:
        reasons.append(F.when(
            ~F.coalesce("has_group_E_radiomics", F.lit(False)), "radiomics missing"))
    for column, minimum, what in (
            ("time_series_steps", model["ts_min"], "time series steps"),
            ("nlp_entities_count", model["nlp_min"], "text entities")):
        have = F.coalesce(column, F.lit(0))
        reasons.append(F.when(
            have < minimum, F.concat(F.lit(f"{what} "), have.cast("string"),
                                     F.lit(f" below {minimum}"))))
    return F.array_compact(F.array(*reasons))


def score_models(profiles: DataFrame, registry: Sequence[Mapping] | None = None,
                 live: Mapping[str, float] | None = None,
                 weights: tuple[float, float, float] = ROUTING_WEIGHTS) -> DataFrame:
    """Add ``models``: scored models of every profile, best first (registry order on ties)."""
    registry = list(registry or MODEL_REGISTRY)
    alpha, beta, gamma = weights
    entries = []
    for i, model in enumerate(registry):
        history, source = _history(model, live)
        fit, penalty = case_fit(model)
        score = F.lit(alpha) * history + F.lit(beta) * fit - F.lit(gamma) * penalty
        entries.append(F.struct(
            F.round(F.greatest(F.lit(0.0), score) * 100, 1).alias("score"),
            F.lit(-i).alias("place"), F.lit(model["model_id"]).alias("model_id"),
            history.alias("historical_f1"), F.round(fit, 4).alias("modality_fit"),
            F.round(penalty, 4).alias("missing_penalty"), F.lit(source).alias("score_source"),
            _losing_reasons(model).alias("reasons")))
    return profiles.withColumn("models", F.sort_array(F.array(*entries), asc=False))


def decide(profiles: DataFrame, registry: Sequence[Mapping] | None = None,
           live: Mapping[str, float] | None = None,
           weights: tuple[float, float, float] = ROUTING_WEIGHTS) -> DataFrame:
    """Add the decision to every profile: winner, its score, all scores and a reason text."""
    best = F.col("models")[0]
    disease = F.coalesce(F.col("primary_disease"), F.lit(""))
    named = F.lit("")
    for key, name in DISEASE_NAMES.items():
        named = F.when(disease == key, name).otherwise(named)

    def line(m: Column) -> Column:
        lost = F.when(F.size(m["reasons"]) > 0, F.array_join(m["reasons"], "; ")).otherwise(
            F.lit("lower overall score"))
        return F.concat(
            m["model_id"], F.lit(": "), m["score"].cast("string"),
            F.when(m["model_id"] == best["model_id"], F.lit(" (selected)"))
            .otherwise(F.concat(F.lit(" ("), lost, F.lit(")"))))

    return score_models(profiles, registry, live, weights).withColumns({
        "target_disease": disease, "target_disease_cn": named,
        "selected_model": best["model_id"], "winning_score": best["score"],
        "all_model_scores": F.map_from_arrays(
            F.transform("models", lambda m: m["model_id"]),
            F.transform("models", lambda m: m["score"])),
        "routing_reason": F.array_join(F.transform("models", line), "\n"),
        "needs_review": F.coalesce("missing_rate", F.lit(0.0)) > 0.3})


def route(profiles: DataFrame, registry: Sequence[Mapping] | None = None,
          live: Mapping[str, float] | None = None,
          weights: tuple[float, float, float] = ROUTING_WEIGHTS) -> DataFrame:
    """The decision columns of every profile."""
    return decide(profiles, registry, live, weights).select(
        "patient_id", "target_disease", "target_disease_cn", "selected_model", "winning_score",
        "all_model_scores", "routing_reason", "needs_review")


def route_simple(profiles: DataFrame) -> DataFrame:
    """The variant with one fixed F1 per model."""
    return route(profiles, SIMPLE_REGISTRY)


def ranked_models(profiles: DataFrame, registry: Sequence[Mapping] | None = None,
                  live: Mapping[str, float] | None = None,
                  weights: tuple[float, float, float] = ROUTING_WEIGHTS) -> DataFrame:
    """One row per profile and model with rank, score parts and losing reasons."""
    return (
        score_models(profiles, registry, live, weights)
        .select("patient_id", "primary_disease", F.posexplode("models").alias("i", "m"))
        .select("patient_id", "primary_disease", (F.col("i") + 1).alias("model_rank"),
                F.col("m.model_id").alias("model_id"), F.col("m.score").alias("score"),
                F.col("m.historical_f1").alias("historical_f1"),
                F.col("m.modality_fit").alias("modality_fit"),
                F.col("m.missing_penalty").alias("missing_penalty"),
                (F.col("i") == 0).alias("is_winner"),
                F.when(F.col("i") > 0, F.array_join("m.reasons", "; ")).alias("lost_because"))
    )
