"""Field dictionary: alias indexes, matching, fuzzy mapping, validation and registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labspark import catalog
from labspark.functions.names import (
    clean_field_name, compact_name, name_tokens, similarity, strip_blanks)
from labspark.operators.similar import BoundedScorer, Scorer, best_matches
from labspark.tables import numbered

HIGH_CONFIDENCE, REVIEW = 0.85, 0.60

# Fields every dictionary row must carry, and accepted data types
REQUIRED_FIELDS = [
    "standard_name", "chinese_name", "english_name", "abbreviation", "alias_names",
    "data_type", "unit", "reference_range", "category", "disease_relevance_matrix",
]
DATA_TYPES = ["float", "int", "categorical", "numeric"]


def alias_index(fields: DataFrame) -> DataFrame:
    """Unique alias -> standard name, original and lower-case; the later field wins."""
    names = F.transform(
        F.concat(F.array("standard_name"), F.coalesce("alias_names", F.array().cast("array<string>"))),
        lambda a: strip_blanks(a))
    both = F.concat(names, F.transform(names, lambda a: F.lower(a)))
    return (
        fields.filter(F.col("standard_name").isNotNull())
        .select("standard_name", "ord", F.explode(both).alias("alias"))
        .groupBy("alias").agg(F.max_by("standard_name", "ord").alias("standard_name"))
    )


def rich_alias_index(fields: DataFrame) -> DataFrame:
    """Unique alias -> standard name over all name columns; the earlier entry wins.

    ``alias_ord`` is the place of first registration (field, name, case) and breaks ties in fuzzy
    matching.
    """
    names = F.concat(
        F.array("standard_name", "chinese_name", "english_name", "abbreviation"),
        F.coalesce("alias_names", F.array().cast("array<string>")))
    return (
        fields.select("standard_name", "ord", F.posexplode(names).alias("i", "name"))
        .withColumn("name", strip_blanks(F.col("name"))).filter(F.col("name") != "")
        .select("standard_name", F.posexplode(F.array("name", F.lower("name"))).alias("k", "alias"),
                "ord", "i")
        .withColumn("alias_ord", F.struct(F.col("ord").cast("long").alias("ord"), "i", "k"))
        .groupBy("alias")
        .agg(F.min_by("standard_name", "alias_ord").alias("standard_name"),
             F.min("alias_ord").alias("alias_ord"))
    )


def field_meta(fields: DataFrame, name: str) -> DataFrame:
    """The row of one standard name (case-sensitive)."""
    return fields.filter(F.col("standard_name") == name)


def match_fields(names: DataFrame, fields: DataFrame, name: str = "raw_name") -> DataFrame:
    """Membership of the trimmed lower-case name in each field's alias list; first field wins.

    Unmatched names stay with ``matched = false``.
    """
    aliases = (
        fields.select("standard_name", "ord", F.explode("alias_names").alias("__alias"))
        .withColumn("__alias", F.lower(strip_blanks(F.col("__alias")))).filter(F.col("__alias") != "")
        .groupBy("__alias").agg(F.min_by("standard_name", "ord").alias("standard_name"))
    )
    return (
        names.join(aliases, F.lower(strip_blanks(F.col(name))) == F.col("__alias"), "left")
        .withColumn("matched", F.col("standard_name").isNotNull()).drop("__alias")
    )


def _exact_tiers(names: DataFrame, index: DataFrame) -> DataFrame:
    """First alias hit among: whole name, compact name, then each token and its compact form."""
    candidates = F.concat(
        F.array("cleaned", compact_name(F.col("cleaned"))),
        F.flatten(F.transform(
            name_tokens(F.col("cleaned")), lambda t: F.array(t, compact_name(t)))))
    hits = (
        names.select("raw_name", F.posexplode(candidates).alias("tier", "alias"))
        .filter(F.col("alias") != "")
        .join(index.select("alias", F.col("standard_name").alias("hit")), "alias")
        .groupBy("raw_name")
        .agg(F.min_by("hit", "tier").alias("exact_name"),
             F.min_by("alias", "tier").alias("exact_alias"))
    )
    return names.join(hits, "raw_name", "left")


def map_fields(names: DataFrame, index: DataFrame, name: str = "raw_name",
               scorer: Scorer | BoundedScorer = similarity) -> DataFrame:
    """Map every distinct raw name: exact tiers first, then the most similar alias.

    Status bands: exact_match, high_confidence (>= 0.85), needs_manual_review (>= 0.60),
    unmapped.  ``scorer`` takes two columns: :func:`similarity` or ``matching_block_ratio``, whose bounds
    spare most pairs, or another one, which is asked for every pair.
    """
    # aggregated by name once more, which needs no shuffle, so that cleaning is done once and not in every later expression
    distinct = names.select(F.col(name).alias("raw_name")).distinct().groupBy("raw_name").agg(
        F.first(clean_field_name(F.col("raw_name"))).alias("cleaned"))
    tiers = _exact_tiers(distinct, index)
    open_names = tiers.filter(F.col("exact_name").isNull() & (F.col("cleaned") != ""))
    best = best_matches(open_names.select("raw_name", "cleaned"), index.filter(F.col("alias") != ""), scorer)
    same = F.col("l.raw_name").eqNullSafe(F.col("r.raw_name"))
    scored = tiers.alias("l").join(best.alias("r"), same, "left").select("l.*", "r.best")
    exact = F.col("exact_name").isNotNull()
    score = F.when(F.col("cleaned") == "", F.lit(0.0)).otherwise(F.col("best.score"))
    mapped = score >= REVIEW
    return scored.select(
        "raw_name",
        F.when(exact, F.col("exact_name")).when(mapped, F.col("best.standard"))
        .alias("standard_name"),
        F.when(exact, F.col("exact_alias")).when(mapped, F.col("best.alias"))
        .alias("matched_alias"),
        F.when(exact, F.lit(1.0)).otherwise(F.round(score, 4)).alias("confidence"),
        F.when(exact, "exact_match").when(score >= HIGH_CONFIDENCE, "high_confidence")
        .when(mapped, "needs_manual_review").otherwise("unmapped").alias("status"))


def mapping_stats(mapped: DataFrame) -> DataFrame:
    return mapped.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("standard_name").isNotNull()).alias("mapped"),
        F.count_if(F.col("status") == "exact_match").alias("exact"))


def dictionary_stats(fields: DataFrame, index: DataFrame) -> DataFrame:
    """Number of fields and of alias entries, one row."""
    parts = fields.select("standard_name", F.lit(None).cast("string").alias("alias")).union(
        index.select(F.lit(None).cast("string"), "alias"))
    return parts.agg(
        F.count_distinct("standard_name").alias("total_fields"),
        F.count("alias").alias("total_alias_entries"))


def validate_fields(rows: DataFrame) -> DataFrame:
    """Add ``violations``: what is wrong with each candidate dictionary row.

    A missing column counts as a missing value.  ``reference_range`` must be a struct or map
    with low and high, ``alias_names`` an array, ``data_type`` one of the accepted types.
    """
    types = dict(rows.dtypes)
    checks: list[Column] = []
    for name in REQUIRED_FIELDS:
        missing = F.lit(True) if name not in types else F.col(name).isNull()
        checks.append(F.when(missing, f"missing {name}"))
    kind = types.get("reference_range", "")
    if kind.startswith("struct"):
        inner = {f.name for f in rows.schema["reference_range"].dataType.fields}
        for bound in ("low", "high"):
            bad = F.lit(bound not in inner)
            checks.append(F.when(
                F.col("reference_range").isNotNull() & bad, f"reference_range without {bound}"))
    elif kind.startswith("map"):
        for bound in ("low", "high"):
            bad = ~F.map_contains_key("reference_range", bound)
            checks.append(F.when(bad, f"reference_range without {bound}"))
    elif kind:
        checks.append(F.when(F.col("reference_range").isNotNull(), "reference_range not a map"))
    matrix = types.get("disease_relevance_matrix", "map")
    if not matrix.startswith(("map", "struct")):
        checks.append(F.when(
            F.col("disease_relevance_matrix").isNotNull(), "disease_relevance_matrix not a map"))
    if "alias_names" in types and not types["alias_names"].startswith("array"):
        checks.append(F.when(F.col("alias_names").isNotNull(), "alias_names not a list"))
    if "data_type" in types:
        checks.append(F.when(
            ~F.col("data_type").isin(DATA_TYPES), "data_type not accepted"))
    return rows.withColumn("violations", F.array_compact(F.array(*checks)))


def _as_stored(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Candidate rows with the columns and types of the dictionary."""
    types, kinds = dict(fields.dtypes), dict(rows.dtypes)
    out = rows
    if "relevance" in types and "disease_relevance_matrix" in kinds and "relevance" not in kinds:
        out = out.withColumnRenamed("disease_relevance_matrix", "relevance")
        kinds["relevance"] = kinds.pop("disease_relevance_matrix")
    if types.get("reference_range") == "string" and kinds.get("reference_range", "string") != "string":
        bounds = F.col("reference_range")
        out = out.withColumn("reference_range", F.concat_ws(
            "-", bounds["low"].cast("string"), bounds["high"].cast("string")))
        kinds["reference_range"] = "string"
    relevance = types.get("relevance", "")
    if relevance.startswith("map<string,struct") and kinds.get("relevance") not in (None, relevance):
        entry = fields.schema["relevance"].dataType.valueType
        out = out.withColumn("relevance", F.transform_values("relevance", lambda _, v: F.struct(*[
            (v if f.name == "weight" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in entry.fields])))
    return out


def register_fields(rows: DataFrame, fields: DataFrame,
                    order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(dictionary with the new valid rows, rejected rows with a reason).

    Of valid rows with one new name the first by ``order`` (without it: by content) is added and
    the others are rejected.  Ranges and relevance take the dictionary's form, and new rows get
    the next ``ord``, so that both alias indexes find them.
    """
    checked = validate_fields(rows)
    known = fields.select("standard_name").distinct().withColumn("__known", F.lit(True))
    content = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in rows.columns])))
    first = Window.partitionBy("standard_name", F.size("violations") > 0).orderBy(
        *([order] if order else []), content)
    judged = checked.withColumn("__nth", F.row_number().over(first)).join(
        known, "standard_name", "left").withColumn(
        "reason",
        F.when(F.size("violations") > 0, F.array_join("violations", "; "))
        .when(F.col("__known"), "already registered")
        .when(F.col("__nth") > 1, "already registered")).drop("__known", "__nth")
    accepted = _as_stored(judged.filter(F.col("reason").isNull()).drop("violations", "reason"), fields)
    if "ord" in fields.columns:
        kind = fields.schema["ord"].dataType
        last = fields.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("__last"))
        # numbered over range partitions: the new names are as many as the dictionary gains
        placed = numbered(accepted, [F.col(c) for c in ([order] if order else []) + ["standard_name"]], "__place")
        accepted = placed.crossJoin(F.broadcast(last)).withColumn(  # one row
            "ord", (F.col("__last") + F.col("__place") + 1).cast(kind)).drop("__place", "__last")
    merged = fields.unionByName(
        accepted.select(*[c for c in accepted.columns if c in fields.columns]),
        allowMissingColumns=True)
    return merged, judged.filter(F.col("reason").isNotNull())


def register_aliases(mappings: DataFrame, fields: DataFrame,
                     order: str) -> tuple[DataFrame, DataFrame]:
    """Append raw names to the alias list of their standard field.

    Returns (dictionary, skipped mappings with a reason).  Of equal new names (ignoring case)
    the first by ``order`` is added; the alias lists stay as long as the dictionary makes them.
    """
    known = fields.select(F.col("standard_name").alias("__std")).distinct()
    # aliases as rows: a mapping meets its own name only, not the whole list of the field
    aliases = fields.select("standard_name", F.explode("alias_names").alias("__alias")).select(
        "standard_name", F.lower(strip_blanks(F.col("__alias"))).alias("__low"), F.lit(True).alias("__have")).distinct()
    cleaned = mappings.withColumns({
        "raw_name": strip_blanks(F.coalesce("raw_name", F.lit(""))),
        "standard_name": strip_blanks(F.coalesce("standard_name", F.lit("")))})
    first = (
        cleaned.groupBy("standard_name", F.lower("raw_name").alias("__low"))
        .agg(F.min(order).alias("__first"))
    )
    judged = (
        cleaned.withColumn("__low", F.lower("raw_name"))
        .join(first, ["standard_name", "__low"])
        .join(known, F.col("standard_name") == F.col("__std"), "left")
        .join(aliases, ["standard_name", "__low"], "left")
        .withColumn(
            "reason",
            F.when((F.col("raw_name") == "") | (F.col("standard_name") == ""), "blank name")
            .when(F.col("__std").isNull(), "unknown field")
            .when(F.col("__have"), "already an alias")
            .when(F.col(order) != F.col("__first"), "already an alias"))
    )
    new = (
        judged.filter(F.col("reason").isNull()).groupBy("standard_name")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "raw_name"))),
            lambda s: s["raw_name"]).alias("__new"))
    )
    merged = (
        fields.join(new, "standard_name", "left")
        .withColumn("alias_names", F.concat(
            F.coalesce("alias_names", F.array().cast("array<string>")),
            F.coalesce("__new", F.array().cast("array<string>"))))
        .select(*fields.columns)
    )
    skipped = judged.filter(F.col("reason").isNotNull()).select(*mappings.columns, "reason")
    return merged, skipped


def core_markers(fields: DataFrame, disease: str | None = None,
                 min_weight: float = 0.5) -> DataFrame:
    """Core markers by weight, heaviest first; all diseases when none is named."""
    exploded = fields.select(
        "standard_name", "chinese_name", "ord", F.explode("relevance").alias("disease", "entry"))
    rows = exploded.filter((F.col("entry.weight") >= min_weight) & F.col("entry.is_core"))
    if disease is not None:
        rows = rows.filter(F.col("disease") == disease)
    return rows.select(
        "disease", "standard_name", "chinese_name", F.col("entry.weight").alias("weight"),
        F.col("entry.threshold_alert").alias("threshold_alert"),
        F.col("entry.note").alias("note"), "ord").orderBy("disease", F.desc("weight"), "ord")


def seed_if_empty(table: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """The table, or the defaults (without any given: the built-in dictionary rows) when it holds nothing."""
    if not table.isEmpty():
        return table
    return catalog.default_field_table(table.sparkSession) if defaults is None else defaults
