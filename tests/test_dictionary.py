import difflib
import random

import pytest
from pyspark.sql import functions as F

from labspark import catalog
from labspark.functions.names import (
    clean_field_name, compact_name, matching_block_ratio, similarity)
from labspark.operators import dictionary, similar


@pytest.fixture(scope="module")
def fields(spark):
    return catalog.field_table(spark)


@pytest.fixture(scope="module")
def index(fields):
    return dictionary.rich_alias_index(fields).cache()


def names_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "raw_name string")


def test_cleaning(spark):
    raw = [" W.B.C  计数 ", "空腹 葡萄糖(GLU)", "【血常规】白.细.胞", "a，b;c：d", "A [x]{y}《z》B",
           "　x　　y", None]
    df = names_of(spark, *raw).withColumn("i", F.monotonically_increasing_id())
    got = [r[0] for r in df.orderBy("i").select(clean_field_name(F.col("raw_name"))).collect()]
    assert got == ["wbc 计数", "空腹 葡萄糖", "白细胞", "a b c d", "a b", "x y", ""]
    assert names_of(spark, "a-b 白").select(compact_name(F.col("raw_name"))).first()[0] == "ab白"


def test_mapping(spark, index):
    names = names_of(spark, "W.B.C 计数", "糖化血红蛋白 A1c", "血清肌肝", "glucos", "platelt count",
                     "creatinne", "()", "葡萄 (x) glu")
    for scorer in (similarity, lambda a, b: similarity(b, a)):
        got = {r["raw_name"]: r for r in dictionary.map_fields(names, index, scorer=scorer).collect()}
        exact = {"W.B.C 计数": "WBC", "糖化血红蛋白 A1c": "HbA1c", "葡萄 (x) glu": "GLU"}
        for raw, name in exact.items():
            assert (got[raw]["standard_name"], got[raw]["status"], got[raw]["confidence"]) == (
                name, "exact_match", 1.0)
        assert got["血清肌肝"]["status"] == "unmapped"
        assert got["血清肌肝"]["standard_name"] is None
        assert (got["glucos"]["standard_name"], got["glucos"]["status"]) == (
            "GLU", "high_confidence")
        assert got["glucos"]["confidence"] == pytest.approx(0.8571)
        assert (got["platelt count"]["standard_name"], got["platelt count"]["status"]) in (
            ("PLT", "needs_manual_review"), (None, "unmapped"))
        assert got["creatinne"]["standard_name"] == "Creatinine"
        assert (got["()"]["status"], got["()"]["confidence"]) == ("unmapped", 0.0)
    stats = dictionary.mapping_stats(dictionary.map_fields(names, index)).first()
    assert stats["total"] == 8 and stats["exact"] == 3


def test_both_scorers_and_best_scores_of_unmapped_names(spark):
    small = catalog.field_table(spark, [{"standard_name": "N", "alias_names": ["abcde"]},
                                        {"standard_name": "M", "alias_names": ["abcde", "zzzz"]}])
    index = dictionary.rich_alias_index(small)
    names = names_of(spark, "abcdexyz", "abxxx", "qqqqqqqqqqqqqqqqqqqqqq", "bcdex")
    plain = {r["raw_name"]: r for r in dictionary.map_fields(names, index).collect()}
    blocks = {r["raw_name"]: r for r in dictionary.map_fields(names, index, scorer=matching_block_ratio).collect()}
    assert (plain["abcdexyz"]["standard_name"], plain["abcdexyz"]["confidence"]) == ("N", 0.625)
    assert plain["qqqqqqqqqqqqqqqqqqqqqq"]["confidence"] == 0.0
    assert blocks["bcdex"]["confidence"] == pytest.approx(0.8) and blocks["bcdex"]["standard_name"] == "N"
    assert plain["bcdex"]["confidence"] == pytest.approx(0.6)


def test_alias_order_of_a_large_dictionary(spark):
    fields = spark.range(30_000).select(
        F.concat(F.lit("f"), "id").alias("standard_name"), F.lit(None).cast("string").alias("chinese_name"),
        F.lit(None).cast("string").alias("english_name"), F.lit(None).cast("string").alias("abbreviation"),
        F.array(F.lit("shared")).alias("alias_names"), F.col("id").cast("int").alias("ord"))
    index = dictionary.rich_alias_index(fields)
    assert index.count() == 30_001
    assert index.filter("alias = 'shared'").first()["standard_name"] == "f0"


def test_blanks_of_every_kind_are_trimmed(spark, fields):
    got = dictionary.match_fields(names_of(spark, "WBC\t", "　血糖"), fields).collect()
    assert all(r["matched"] for r in got)


def test_registration_into_the_shipped_dictionary(spark, fields):
    ddl = ("standard_name string, chinese_name string, english_name string, abbreviation string,"
           " alias_names array<string>, data_type string, unit string,"
           " reference_range struct<low: double, high: double>, category string,"
           " disease_relevance_matrix map<string, double>")
    row = ("NEW", "新", "fresh", "N", ["nn"], "float", "u", (1.0, 2.0), "cat", {"d": 0.7})
    rows = spark.createDataFrame([row, row, ("WBC", *row[1:])], ddl)
    merged, rejected = dictionary.register_fields(rows, fields)
    new = merged.filter("standard_name = 'NEW'").collect()
    assert len(new) == 1 and new[0]["ord"] == fields.agg(F.max("ord")).first()[0] + 1
    assert new[0]["relevance"]["d"]["weight"] == 0.7
    assert [r["reason"] for r in rejected.collect()] == ["already registered"] * 2
    found = dictionary.map_fields(names_of(spark, "nn"), dictionary.rich_alias_index(merged)).first()
    assert found["standard_name"] == "NEW"
    assert dictionary.alias_index(merged).filter("alias = 'nn'").first()["standard_name"] == "NEW"


def test_scorers(spark):
    df = spark.createDataFrame([("glucose", "glucos"), ("abcd", "bcde")], "a string, b string")
    got = df.select(similarity(F.col("a"), F.col("b")), matching_block_ratio("a", "b")).collect()
    assert got[0][0] == pytest.approx(6 / 7) and got[0][1] == pytest.approx(12 / 13)
    assert got[1][1] == pytest.approx(0.75)


def test_match_and_meta(spark, fields):
    got = {r["raw_name"]: (r["standard_name"], r["matched"])
           for r in dictionary.match_fields(names_of(spark, " WBC ", "血糖", "zz"), fields).collect()}
    assert got == {" WBC ": ("WBC", True), "血糖": ("GLU", True), "zz": (None, False)}
    assert dictionary.field_meta(fields, "WBC").count() == 1
    assert dictionary.field_meta(fields, "wbc").count() == 0


def test_validation_and_registration(spark, fields):
    ddl = ("standard_name string, chinese_name string, english_name string, abbreviation string,"
           " alias_names array<string>, data_type string, unit string,"
           " reference_range struct<low: double, high: double>, category string,"
           " disease_relevance_matrix map<string, double>")
    good = ("NEW", "c", "e", "N", ["n"], "float", "u", (1.0, 2.0), "cat", {})
    rows = spark.createDataFrame([
        good, ("BAD", None, "e", "N", ["n"], "text", "u", (1.0, 2.0), "cat", {}),
        ("WBC", "c", "e", "N", ["n"], "int", "u", (1.0, 2.0), "cat", {})], ddl)
    judged = {r["standard_name"]: r["violations"] for r in dictionary.validate_fields(rows).collect()}
    assert judged["NEW"] == [] and judged["WBC"] == []
    assert judged["BAD"] == ["missing chinese_name", "data_type not accepted"]
    merged, rejected = dictionary.register_fields(
        rows.drop("reference_range").withColumn("reference_range", F.struct(
            F.lit(1.0).alias("low"), F.lit(2.0).alias("high"))), fields.drop("reference_range"))
    assert merged.filter("standard_name = 'NEW'").count() == 1 and merged.count() == 13
    assert {r["standard_name"]: r["reason"] for r in rejected.collect()} == {
        "BAD": "missing chinese_name; data_type not accepted", "WBC": "already registered"}
    without = dictionary.validate_fields(rows.drop("unit")).filter("standard_name = 'NEW'").first()
    assert without["violations"] == ["missing unit"]


def test_alias_registration(spark, fields):
    mappings = spark.createDataFrame([
        (0, " 白细胞计数 ", "WBC"), (1, "白细胞计数", "WBC"), (2, "GLUCOSE", "GLU"), (3, "x", "ZZ"),
        (4, "", "GLU"), (5, "sugar", "GLU")], "o int, raw_name string, standard_name string")
    merged, skipped = dictionary.register_aliases(mappings, fields, "o")
    aliases = {r["standard_name"]: r["alias_names"] for r in merged.collect()}
    assert aliases["WBC"][-1] == "白细胞计数" and aliases["WBC"].count("白细胞计数") == 1
    assert aliases["GLU"][-1] == "sugar" and len(aliases) == 12
    assert {r["o"]: r["reason"] for r in skipped.collect()} == {
        1: "already an alias", 2: "already an alias", 3: "unknown field", 4: "blank name"}


def test_core_markers_stats_and_seed(spark):
    entry = {"weight": 0.9, "is_core": True, "threshold_alert": "t", "note": "n"}
    table = catalog.field_table(spark, [
        {"standard_name": "A", "relevance": {"d": entry, "e": {**entry, "is_core": False}}},
        {"standard_name": "B", "relevance": {"d": {**entry, "weight": 0.95}}},
        {"standard_name": "C", "relevance": {"d": {**entry, "weight": 0.4}}}])
    got = [r["standard_name"] for r in dictionary.core_markers(table, "d").collect()]
    assert got == ["B", "A"]
    assert dictionary.core_markers(table, "e").count() == 0
    stats = dictionary.dictionary_stats(
        catalog.field_table(spark), dictionary.rich_alias_index(catalog.field_table(spark))).first()
    assert stats["total_fields"] == 12 and stats["total_alias_entries"] > 40
    seeds = catalog.config_table(spark)
    assert dictionary.seed_if_empty(seeds.limit(0), seeds).count() == 5
    assert dictionary.seed_if_empty(seeds.limit(1), seeds).count() == 1


@pytest.mark.parametrize("name", ["edit", "blocks", "unbounded"])
def test_best_matches_equal_all_pairs(spark, name):
    rng = random.Random(11)
    parts = ["ka", "lo", "mi", "ner", "tas", "vu", "血", "糖", "qua"]
    aliases = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(300)})
    rng.shuffle(aliases)

    def typed(word):
        word = list(word)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randrange(2)] = rng.choice(["", "a", "xy"])
        return "".join(word) or "z"

    names = {typed(rng.choice(aliases)) for _ in range(250)} | {"z", "qqqqqqqqqqqqqqqqqqq", aliases[0]}
    index = spark.createDataFrame([(a, f"s{i}", (i // 2, i % 2, 0)) for i, a in enumerate(aliases)],
                                  "alias string, standard_name string, alias_ord struct<ord:long,i:int,k:int>")
    asked = spark.createDataFrame([(f"raw {n}", n) for n in names], "raw_name string, cleaned string")
    scorer = {"edit": similarity, "blocks": matching_block_ratio, "unbounded": lambda a, b: similarity(b, a)}[name]
    found = similar.best_matches(asked, index, scorer)
    got = {r["raw_name"]: (r["best"]["score"], r["best"]["alias"], r["best"]["standard"]) for r in found.collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def score(a, b):
        if name == "blocks":
            return difflib.SequenceMatcher(None, a, b).ratio()
        return 1 - distance(a, b) / max(len(a), len(b))

    for n in names:
        scores = [score(n, a) for a in aliases]
        best = scores.index(max(scores))
        assert got[f"raw {n}"] == (pytest.approx(scores[best]), aliases[best], f"s{best}")
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert similar.best_matches(asked, index.limit(0), scorer).count() == 0
    assert similar.best_matches(asked.limit(0), index, scorer).count() == 0


def test_an_empty_dictionary_starts_with_the_default_rows(spark, fields):
    seeded = dictionary.seed_if_empty(fields.limit(0))
    assert seeded.count() == 12 and seeded.columns == [*fields.columns, "description"]
    got = {r["raw_name"]: r["standard_name"] for r in dictionary.match_fields(
        names_of(spark, " 丙氨酸氨基转移酶", "GOT", "bun", "白细胞", "C反应蛋白", "unknown"), seeded).collect()}
    assert got == {" 丙氨酸氨基转移酶": "ALT", "GOT": "AST", "bun": "Urea", "白细胞": "WBC", "C反应蛋白": "CRP", "unknown": None}
    assert dictionary.seed_if_empty(fields).count() == fields.count()
    assert dictionary.seed_if_empty(fields.limit(0), fields.limit(2)).count() == 2
