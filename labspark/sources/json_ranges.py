"""One large JSON document read by many tasks.

The document is an array of records or an object of keyed records. A task that starts in the middle of it cannot know
whether it is inside a string, nor how deep. So the file is looked at twice: first each byte range reports, for both cases,
how its quotes and brackets change the state; put together in order (one small row per range) this gives every range the
state it starts in. Then each range yields the entries that begin in it, found by depth outside strings, and
reads on behind its end to finish the last one. Spark parses the entries.

Files are opened through pyarrow's file systems, so driver and executors need the same path. Sizes do not matter but for one
entry, which one task holds. Text is UTF-8; a byte-order mark is skipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from labspark import schemas

RANGE_BYTES = 32 << 20
#: Bytes read at once behind the end of a range.
STEP = 1 << 20
ENTRY = "key string, value string"
_OPEN, _CLOSE, _QUOTE, _SLASH, _COMMA = (frozenset(b"[{"), frozenset(b"]}"), 34, 92, 44)


@dataclass
class Start:
    """Where a range begins and in which state."""

    at: int
    end: int
    in_string: bool
    depth: int


class _File:
    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            system, inner = fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path)
        else:
            system, inner = fs.LocalFileSystem(), path
        self.size = system.get_file_info(inner).size
        self.file = system.open_input_file(inner)

    def read(self, at: int, size: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(max(0, min(size, self.size - at)), at), np.uint8)

    def boundary(self, at: int) -> int:
        """The first place from ``at`` on that no backslash precedes, so no escape is cut in two."""
        while 0 < at < self.size and self.read(at - 1, 1)[0] == _SLASH:
            at += 1
        return min(at, self.size)


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an odd number of real quotes has come up to and with each byte, and +1 / -1 at brackets."""
    quotes = data == _QUOTE
    slashes = data == _SLASH
    if slashes.any():
        places = np.arange(len(data))
        last_other = np.maximum.accumulate(np.where(slashes, -1, places))
        before = np.append(-1, last_other[:-1])  # the last byte before this one that is no backslash
        quotes &= (places - 1 - before) % 2 == 0
    odd = np.cumsum(quotes, dtype=np.int64) % 2 == 1
    brackets = np.zeros(len(data), np.int8)
    for b in _OPEN:
        brackets[data == b] = 1
    for b in _CLOSE:
        brackets[data == b] = -1
    return odd, brackets


def _range_effects(path: str, ranges: list[tuple[int, int]]) -> Iterator[tuple]:
    file = _File(path)
    for at, end in ranges:
        at, end = file.boundary(at), file.boundary(end)
        odd, brackets = _marks(file.read(at, end - at))
        yield at, end, bool(len(odd) and odd[-1]), int(brackets[~odd].sum()), int(brackets[odd].sum())


def range_starts(spark: SparkSession, path: str, size: int, range_bytes: int) -> list[Start]:
    """The state in which every range of the file begins: one small row per range."""
    ranges = spark.range(0, -(-size // range_bytes), 1, max(1, -(-size // range_bytes)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [(i * range_bytes, min(size, (i + 1) * range_bytes)) for i in batch.column(0).to_pylist()]
            rows = list(zip(*_range_effects(path, asked), strict=True))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["at", "end", "flips", "outside", "inside"])

    found = sorted(ranges.mapInArrow(work, "at long, end long, flips boolean, outside long, inside long").collect())
    starts, in_string, depth = [], False, 0
    for at, end, flips, outside, inside in found:
        if at < end:
            starts.append(Start(at, end, in_string, depth))
        depth += inside if in_string else outside
        in_string ^= flips
    if in_string or depth:
        raise ValueError(f"{path} is no complete JSON document")
    return starts


def entries(path: str, start: Start) -> Iterator[bytes]:
    """The entries of the outermost array or object that begin in a range: each is what stands after a separator.

    Separators are the bracket that opens the document and the commas at depth 1.
    """
    file = _File(path)
    at, in_string, depth = start.at, start.in_string, start.depth
    held: list[bytes] | None = None  # the parts of an entry that is not yet complete
    while at < file.size and (at < start.end or held is not None):
        end = file.boundary(min(at + STEP, start.end) if at < start.end else at + STEP)
        data = file.read(at, end - at)
        odd, brackets = _marks(data)
        outside = odd == in_string  # a quote byte itself counts to the side it leads to
        moves = np.where(outside, brackets, 0)
        depths = depth + np.cumsum(moves, dtype=np.int64)
        comma = outside & (data == _COMMA) & (depths == 1)
        opening = (moves == 1) & (depths == 1)
        closing = (moves == -1) & (depths == 0)
        raw = data.tobytes()
        last = 0
        for i in np.flatnonzero(comma | opening | closing).tolist():
            if held is not None:
                yield b"".join([*held, raw[last:i]])
                held = None
            if closing[i] or at + i >= start.end:
                if at + i >= start.end:
                    return
                continue
            held, last = [], i + 1
        if held is not None:
            held.append(raw[last:])
        at, depth = end, int(depths[-1]) if len(depths) else depth
        in_string ^= bool(len(odd) and odd[-1])


def _key_and_value(entry: bytes, keyed: bool) -> tuple[str | None, str] | None:
    text = entry.decode("utf-8", "replace").strip("﻿ \t\r\n")
    if not text:
        return None
    if not keyed:
        return None, text
    key, end = json.JSONDecoder().raw_decode(text)
    return key, text[end:].lstrip(" \t\r\n").removeprefix(":").strip(" \t\r\n")


@dataclass
class _Range(InputPartition):
    start: Start

    def __init__(self, start: Start):
        super().__init__(start.at)
        self.start = start


class JsonRangeReader(DataSourceReader):
    def __init__(self, path: str, keyed: bool, starts: list[Start]):
        self.path, self.keyed, self.starts = path, keyed, starts

    def partitions(self) -> list[_Range]:
        return [_Range(s) for s in self.starts]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for entry in entries(self.path, partition.start):
            found = _key_and_value(entry, self.keyed)
            if found is None:
                continue
            keys.append(found[0])
            values.append(found[1])
            held += len(entry)
            if held > 4 << 20:
                yield self._batch(keys, values)
                keys, values, held = [], [], 0
        yield self._batch(keys, values)

    @staticmethod
    def _batch(keys: list, values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["key", "value"])


class JsonRanges(DataSource):
    """Format ``json_ranges``: rows (key, value) of one document; the options hold the ranges' starts."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema: T.StructType) -> JsonRangeReader:
        starts = [Start(*s) for s in json.loads(self.options["starts"])]
        return JsonRangeReader(self.options["path"], self.options["keyed"] == "true", starts)


def json_entries(spark: SparkSession, path: str, keyed: bool, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, value) of every entry of one document, as JSON texts; keys are null for an array."""
    spark.dataSource.register(JsonRanges)
    size = _File(path).size
    starts = [(s.at, s.end, s.in_string, s.depth) for s in range_starts(spark, path, size, range_bytes)] if size else []
    return (spark.read.format("json_ranges").option("keyed", str(keyed).lower()).option("starts", json.dumps(starts))
            .load(path) if starts else spark.createDataFrame([], ENTRY))


def read_records(spark: SparkSession, path: str, schema: str | T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of one array; an element that is no object gives a row of nulls."""
    rows = json_entries(spark, path, False, range_bytes)
    return rows.select(F.from_json("value", schemas.struct(schema)).alias("v")).select("v.*")


def read_keyed(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "case_id",
               range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per key of one object of records, the key in the column ``key``."""
    schema = schemas.struct(schema)
    rows = json_entries(spark, path, True, range_bytes).select(
        F.col("key").alias(key), F.from_json("value", schema).alias("__v"))
    return rows.select(key, *[F.col(f"__v.{f}").alias(f) for f in schema.names if f != key])
