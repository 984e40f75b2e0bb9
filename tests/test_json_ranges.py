"""One JSON document read in byte ranges gives what a whole read gives, wherever the ranges are cut."""

import json
import random

import pytest

from labspark.sources import json_ranges

SCHEMA = "id int, t string, n struct<x:array<string>,y:string>"


def records(n, seed=3):
    rng = random.Random(seed)

    def text():
        return "".join(rng.choice('ab,[]{}"\\:é日\n😀 ') for _ in range(rng.randrange(12)))

    return [{"id": i, "t": text(), "n": {"x": [text(), str(rng.random())], "y": None}} for i in range(n)]


@pytest.mark.parametrize("range_bytes", [701, 5003, 1 << 25])
@pytest.mark.parametrize("indent", [None, 2])
def test_records_of_an_array(spark, tmp_path, range_bytes, indent):
    path = tmp_path / "list.json"
    path.write_text(json.dumps(records(400), ensure_ascii=False, indent=indent), encoding="utf-8")
    got = json_ranges.read_records(spark, str(path), SCHEMA, range_bytes)
    want = spark.read.schema(SCHEMA).json(str(path), multiLine=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.rdd.getNumPartitions() == -(-path.stat().st_size // range_bytes) or range_bytes < 1000


def test_keyed_records(spark, tmp_path):
    path = tmp_path / "keyed.json"
    rows = records(300, 5)
    path.write_text("﻿" + json.dumps({f'k"{r["id"]},{{': r for r in rows}, indent=1), encoding="utf-8")
    got = json_ranges.read_keyed(spark, f"file://{path}", SCHEMA, "case_id", 3001).collect()
    assert sorted((r["case_id"], r["id"], r["t"], r["n"]["x"][1]) for r in got) == sorted(
        (f'k"{r["id"]},{{', r["id"], r["t"], r["n"]["x"][1]) for r in rows)


def test_odd_documents(spark, tmp_path):
    def values(text, keyed=False, range_bytes=7):
        path = tmp_path / "odd.json"
        path.write_text(text, encoding="utf-8")
        return [tuple(r) for r in json_ranges.json_entries(spark, str(path), keyed, range_bytes).collect()]

    assert values("") == values("[]") == values(" { } ", True) == []
    assert values('[1, null, "a,]", [2, {"b": "]"}], {}]') == [
        (None, "1"), (None, "null"), (None, '"a,]"'), (None, '[2, {"b": "]"}]'), (None, "{}")]
    assert values('{"a": 1, "": {"x": "\\\\"}, "c\\"": "\\\\\\""}', True) == [
        ("a", "1"), ("", '{"x": "\\\\"}'), ('c"', '"\\\\\\""')]
    long = json.dumps(["x" * 50_000, "\\" * 999 + '"', "y"])
    assert [json.loads(v) for _, v in values(long, range_bytes=1000)] == json.loads(long)
    with pytest.raises(ValueError):
        values('[{"a": 1}')
