"""Every registered query with SQL gives the SQL's rows; queries hold across partition counts."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()
FOLDER = os.environ.get("LABSPARK_TEST_TABLES", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (decimal.Decimal, int)) and not isinstance(value, bool):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 6)
    return value


def table_of(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [dict(zip(names, row)) for row in cursor.fetchall()]
    assert table_of(df.collect(), columns) == table_of(want, columns)


@pytest.mark.parametrize("name", [
    "labs_abnormal_trajectory", "lab_half_split_trend", "stats_describe", "stats_mann_whitney",
    "stratified_split_sizes", "text_triples", "case_align"])
def test_partition_count_changes_nothing(spark, name):
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            df = entry.queries()[name](spark, FOLDER)
            results.append(table_of(df.collect(), sorted(df.columns)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
