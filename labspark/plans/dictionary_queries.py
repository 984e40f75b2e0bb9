"""Registered queries over the field dictionary; dictionaries are built from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark import catalog
from labspark.functions.names import clean_field_name, compact_name, matching_block_ratio
from labspark.operators import dictionary
from labspark.plans.registry import ORACLE, query, rounded, table, values_sql
from labspark.tables import numbered

# Field dictionary of these queries: item words of part names.
FIELDS = [
    {"standard_name": "Ring", "english_name": "metal ring",
     "alias_names": ["ring", "small ring", "red ring"]},
    {"standard_name": "Widget", "english_name": "machine widget",
     "alias_names": ["widget", "hot widgit", "large widget"]},
    {"standard_name": "Gear", "english_name": "toothed gear",
     "alias_names": ["gear", "new geer", "small ring"]},
    {"standard_name": "Bolt", "english_name": "steel bolt", "alias_names": ["old bolts", "blue bold"]},
]
_alias_rows = [
    (a.strip().lower(), f["standard_name"], i)
    for i, f in enumerate(FIELDS) for a in f["alias_names"]]


def _rich_rows() -> list[tuple[str, str, int]]:
    seen: dict[str, tuple[str, int]] = {}
    for i, f in enumerate(FIELDS):
        names = [f["standard_name"], None, f["english_name"], None, *f["alias_names"]]
        for j, name in enumerate(names):
            for k, alias in enumerate((name, name.lower())) if name else ():
                seen.setdefault(alias, (f["standard_name"], i * 100_000 + j * 2 + k))
    return [(a, s, o) for a, (s, o) in seen.items()]


def _fields(spark: SparkSession) -> DataFrame:
    return catalog.field_table(spark, FIELDS)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names as they might be typed: spelling, case, brackets and dots vary by part."""
    n, name = F.col("p_partkey") % 4, F.col("p_name")
    return table(spark, sf_dir, "part").select(
        F.when(n == 0, name).when(n == 1, F.upper(name))
        .when(n == 2, F.concat(F.lit(" "), name, F.lit("  (x) ")))
        .otherwise(F.concat(F.substring(name, 1, 5), F.lit("."), F.substring(name, 6, 99)))
        .alias("raw_name"))


_names_sql = """SELECT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
    WHEN 2 THEN ' ' || p_name || '  (x) '
    ELSE substr(p_name, 1, 5) || '.' || substr(p_name, 6) END AS raw_name FROM part"""
_clean_sql = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    trim(regexp_replace(raw_name, '\s+', ' ', 'g')), '\([^)]*\)', '', 'g'),
    '[,;:]+', ' ', 'g'), '([a-zA-Z0-9])\.([a-zA-Z0-9])', '\1\2', 'g'), '\s+', ' ', 'g')))"""


@query("clean_names", f"""
SELECT cleaned, regexp_replace(cleaned, '[^a-z0-9]', '', 'g') AS compact, count(*) AS n
FROM (SELECT {_clean_sql} AS cleaned FROM ({_names_sql})) GROUP BY 1, 2""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _names(spark, sf_dir).select(clean_field_name(F.col("raw_name")).alias("cleaned"))
    return cleaned.groupBy("cleaned", compact_name(F.col("cleaned")).alias("compact")).agg(
        F.count(F.lit(1)).alias("n"))


@query("dictionary_match", f"""
SELECT p.p_partkey, p.p_name AS raw_name, m.standard_name,
  m.standard_name IS NOT NULL AS matched
FROM part p LEFT JOIN (SELECT alias, arg_min(standard_name, ord) AS standard_name FROM
  {values_sql(_alias_rows, 'alias, standard_name, ord')} GROUP BY 1) m
  ON m.alias = lower(trim(p.p_name))""")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("raw_name"))
    return dictionary.match_fields(names, _fields(spark)).select(
        "p_partkey", "raw_name", "standard_name", "matched")


@query("fuzzy_map", f"""
WITH n AS (SELECT raw_name, {_clean_sql} AS c FROM (SELECT DISTINCT raw_name FROM ({_names_sql}))),
a AS (SELECT * FROM {values_sql(_rich_rows(), 'alias, standard_name, o')}),
tok AS (SELECT raw_name, unnest(string_split(c, ' ')) AS t,
          generate_subscripts(string_split(c, ' '), 1) AS i FROM n),
cand AS (
  SELECT raw_name, 0 AS tier, c AS alias FROM n
  UNION ALL SELECT raw_name, 1, regexp_replace(c, '[^a-z0-9]', '', 'g') FROM n
  UNION ALL SELECT raw_name, 2 * i, t FROM tok
  UNION ALL SELECT raw_name, 2 * i + 1, regexp_replace(t, '[^a-z0-9]', '', 'g') FROM tok),
hit AS (SELECT raw_name, arg_min(a.standard_name, tier) AS s, arg_min(a.alias, tier) AS al
        FROM cand JOIN a USING (alias) GROUP BY 1),
sim AS (SELECT raw_name, a.alias, a.standard_name, o,
          1 - levenshtein(c, a.alias) / greatest(length(c), length(a.alias)) AS score
        FROM n, a),
best AS (SELECT raw_name, arg_max(alias, struct_pack(x := score, y := -o)) AS alias,
           arg_max(standard_name, struct_pack(x := score, y := -o)) AS standard_name,
           max(score) AS score FROM sim GROUP BY 1)
SELECT n.raw_name, coalesce(hit.s, CASE WHEN score >= CAST(0.6 AS DOUBLE) THEN best.standard_name END)
    AS standard_name,
  coalesce(hit.al, CASE WHEN score >= CAST(0.6 AS DOUBLE) THEN best.alias END) AS matched_alias,
  CASE WHEN hit.s IS NOT NULL THEN 1.0 ELSE round(score, 4) END AS confidence,
  CASE WHEN hit.s IS NOT NULL THEN 'exact_match'
    WHEN score >= CAST(0.85 AS DOUBLE) THEN 'high_confidence'
    WHEN score >= CAST(0.6 AS DOUBLE) THEN 'needs_manual_review' ELSE 'unmapped' END AS status
FROM n LEFT JOIN hit USING (raw_name) LEFT JOIN best USING (raw_name)""")
def fuzzy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tiers, then the most similar alias, for every distinct typed name."""
    return dictionary.map_fields(
        _names(spark, sf_dir), dictionary.rich_alias_index(_fields(spark)))


def _words(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Distinct lower-case words of the texts of a table."""
    return table(spark, sf_dir, name).select(
        F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''").distinct()


def _words_sql(name: str) -> str:
    return f"""SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word
  FROM {name}) WHERE word <> ''"""


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of one field per benchmark word, registered in the order of the alphabet."""
    words = numbered(_words(spark, sf_dir, "benchmark"), [F.col("word")], "ord")
    return dictionary.rich_alias_index(words.select(
        F.col("word").alias("standard_name"), "ord",
        *[F.lit(None).cast("string").alias(c) for c in ("chinese_name", "english_name", "abbreviation")],
        F.lit(None).cast("array<string>").alias("alias_names")))


@query("fuzzy_words", f"""
WITH a AS (SELECT word AS alias, row_number() OVER (ORDER BY word) AS o FROM ({_words_sql('benchmark')})),
n AS ({_words_sql('conversations')}),
sim AS (SELECT word, alias, struct_pack(x := 1 - levenshtein(word, alias) / greatest(length(word), length(alias)), y := -o) AS s
        FROM n, a),
best AS (SELECT word, arg_max(alias, s) AS alias, max(s).x AS score FROM sim GROUP BY 1)
SELECT word AS raw_name, CASE WHEN score >= CAST(0.6 AS DOUBLE) THEN alias END AS standard_name,
  CASE WHEN score >= CAST(0.6 AS DOUBLE) THEN alias END AS matched_alias, round(score, 4) AS confidence,
  CASE WHEN score = 1 THEN 'exact_match' WHEN score >= CAST(0.85 AS DOUBLE) THEN 'high_confidence'
    WHEN score >= CAST(0.6 AS DOUBLE) THEN 'needs_manual_review' ELSE 'unmapped' END AS status
FROM best""")
def fuzzy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark word most like each word of the conversations; both lists grow with the data."""
    names = _words(spark, sf_dir, "conversations").withColumnRenamed("word", "raw_name")
    return dictionary.map_fields(names, _vocabulary(spark, sf_dir))


@query("mapping_stats", f"""
SELECT count(*) AS total, count(standard_name) AS mapped, count(*) FILTER (WHERE status = 'exact_match') AS exact
FROM ({ORACLE['fuzzy_map']})""")
def mapping_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many typed names were mapped, and how many exactly."""
    return dictionary.mapping_stats(fuzzy_map(spark, sf_dir))


@query("fuzzy_map_blocks")
def fuzzy_map_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of typed names by matching blocks, which SQL lacks."""
    return dictionary.map_fields(
        _names(spark, sf_dir), dictionary.rich_alias_index(_fields(spark)), scorer=matching_block_ratio)


_brands_sql = """SELECT p_brand AS standard_name, list_sort(list(DISTINCT p_type)) AS alias_names
  FROM part GROUP BY 1"""


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary from the data: one field per brand, its part types as aliases."""
    return table(spark, sf_dir, "part").groupBy(
        F.col("p_brand").alias("standard_name")).agg(
        F.array_sort(F.collect_set("p_type")).alias("alias_names"))


@query("alias_register", f"""
WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN lower(p_type) ELSE p_name END
             AS raw_name, CASE WHEN p_size > 10 THEN p_brand ELSE p_name END AS standard_name FROM part),
b AS ({_brands_sql}),
f AS (SELECT standard_name, lower(raw_name) AS low, arg_min(raw_name, p_partkey) AS raw_name,
        min(p_partkey) AS first FROM m GROUP BY 1, 2),
fresh AS (SELECT f.* FROM f JOIN b USING (standard_name)
        WHERE NOT list_contains(list_transform(b.alias_names, lambda x: lower(x)), f.low))
SELECT b.standard_name, array_to_string(b.alias_names, ',') || CASE WHEN count(fresh.low) > 0
    THEN ',' || string_agg(fresh.raw_name, ',' ORDER BY fresh.first) ELSE '' END AS alias_names
FROM b LEFT JOIN fresh USING (standard_name) GROUP BY b.standard_name, b.alias_names""")
def alias_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New part names appended to the alias lists of their brand."""
    merged, _ = dictionary.register_aliases(
        _mappings(spark, sf_dir), _brands(spark, sf_dir), "p_partkey")
    return merged.select("standard_name", F.array_join("alias_names", ",").alias("alias_names"))


def _mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.lower("p_type"))
        .otherwise(F.col("p_name")).alias("raw_name"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(F.col("p_name")).alias("standard_name"))


@query("alias_register_skipped", f"""
WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN lower(p_type) ELSE p_name END
             AS raw_name, CASE WHEN p_size > 10 THEN p_brand ELSE p_name END AS standard_name FROM part),
b AS ({_brands_sql}),
f AS (SELECT m.*, min(p_partkey) OVER (PARTITION BY standard_name, lower(raw_name)) AS first FROM m)
SELECT f.p_partkey, f.raw_name, f.standard_name,
  CASE WHEN b.standard_name IS NULL THEN 'unknown field' ELSE 'already an alias' END AS reason
FROM f LEFT JOIN b USING (standard_name)
WHERE b.standard_name IS NULL OR f.p_partkey <> f.first
  OR list_contains(list_transform(b.alias_names, lambda x: lower(x)), lower(f.raw_name))""")
def alias_register_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, skipped = dictionary.register_aliases(
        _mappings(spark, sf_dir), _brands(spark, sf_dir), "p_partkey")
    return skipped


@query("core_markers", """
SELECT p_type AS disease, p_brand AS standard_name, round(avg(p_size) / 50, 6) AS weight
FROM part GROUP BY 1, 2
HAVING avg(p_size) / 50 >= CAST(0.5 AS DOUBLE) AND max(p_size) > 45""")
def core_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core markers per disease from a relevance map built per brand."""
    entry = F.struct(
        (F.avg("p_size") / 50).alias("weight"), (F.max("p_size") > 45).alias("is_core"),
        F.lit("").alias("threshold_alert"), F.lit("").alias("note"))
    per_type = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(entry.alias("e"))
    fields = per_type.groupBy(F.col("p_brand").alias("standard_name")).agg(
        F.map_from_entries(F.collect_list(F.struct("p_type", "e"))).alias("relevance"),
        F.lit("").alias("chinese_name"), F.lit(0).alias("ord"))
    return rounded(dictionary.core_markers(fields), "weight").select(
        "disease", "standard_name", "weight")


@query("dictionary_validate", """
SELECT violations, count(*) AS n FROM (
  SELECT array_to_string(list_filter([
    CASE WHEN p_size % 10 = 0 THEN 'missing english_name' END,
    CASE WHEN p_size % 7 = 0 THEN 'missing unit' END,
    CASE WHEN p_size % 6 = 0 THEN 'missing reference_range' END,
    'missing category',
    CASE WHEN p_type NOT IN ('SMALL', 'LARGE') THEN 'data_type not accepted' END],
    lambda x: x IS NOT NULL), '; ') AS violations FROM part)
GROUP BY 1""")
def dictionary_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with candidate dictionary rows made from parts."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("standard_name"), F.col("p_name").alias("chinese_name"),
        F.when(size % 10 != 0, F.col("p_name")).alias("english_name"),
        F.col("p_brand").alias("abbreviation"), F.array("p_type").alias("alias_names"),
        F.when(F.col("p_type") == "SMALL", "int").when(F.col("p_type") == "LARGE", "float")
        .otherwise(F.col("p_type")).alias("data_type"),
        F.when(size % 7 != 0, "mm").alias("unit"),
        F.when(size % 6 != 0, F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")))
        .alias("reference_range"),
        F.create_map(F.col("p_type"), size).alias("disease_relevance_matrix"))
    checked = dictionary.validate_fields(rows)
    return checked.groupBy(F.array_join("violations", "; ").alias("violations")).agg(
        F.count(F.lit(1)).alias("n"))


@query("dictionary_register", """
WITH names AS (SELECT p_brand AS standard_name FROM part UNION ALL SELECT p_name FROM part),
counted AS (SELECT standard_name, count(*) AS n,
  standard_name IN (SELECT p_brand FROM part) AS known FROM names GROUP BY 1)
SELECT standard_name, 'new' AS outcome, 1 AS n FROM counted WHERE NOT known
UNION ALL
SELECT standard_name, 'already registered', n - CASE WHEN known THEN 0 ELSE 1 END FROM counted
WHERE known OR n > 1""")
def dictionary_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registering brand and part names, repeats included: new once, or already there."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.col("p_brand").alias("standard_name")).union(parts.select("p_name"))
    rows = names.withColumns({
        "chinese_name": F.col("standard_name"), "english_name": F.col("standard_name"),
        "abbreviation": F.col("standard_name"), "alias_names": F.array("standard_name"),
        "data_type": F.lit("float"), "unit": F.lit("mm"), "category": F.lit("part"),
        "reference_range": F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")),
        "disease_relevance_matrix": F.create_map(F.lit("d"), F.lit(1))})
    known = _brands(spark, sf_dir)
    merged, rejected = dictionary.register_fields(rows, known)
    new = merged.join(known.select("standard_name"), "standard_name", "left_anti")
    outcomes = new.select("standard_name", F.lit("new").alias("outcome")).union(
        rejected.select("standard_name", "reason"))
    return outcomes.groupBy("standard_name", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("dictionary_stats", f"""
SELECT (SELECT count(DISTINCT p_brand) FROM part) AS total_fields,
  (SELECT count(DISTINCT a) FROM (
     SELECT unnest([standard_name, lower(standard_name)]) AS a FROM ({_brands_sql})
     UNION ALL SELECT unnest(list_concat(alias_names,
       list_transform(alias_names, lambda x: lower(x)))) FROM ({_brands_sql})))
    AS total_alias_entries""")
def dictionary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _brands(spark, sf_dir).withColumn("ord", F.lit(0))
    return dictionary.dictionary_stats(fields, dictionary.alias_index(fields))


@query("field_meta", f"""
SELECT standard_name, array_to_string(alias_names, ',') AS alias_names FROM ({_brands_sql})
WHERE standard_name = (SELECT min(p_brand) FROM part)""")
def field_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of one field: the first brand."""
    fields = _brands(spark, sf_dir)
    first = fields.agg(F.min("standard_name")).first()[0]
    return dictionary.field_meta(fields, first).select(
        "standard_name", F.array_join("alias_names", ",").alias("alias_names"))
