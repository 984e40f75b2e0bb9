"""Counts of character n-grams as vectors, for pipelines over texts.

Character n-grams as arrays of strings are many times the text, and every later fit makes them again. Here a gram is one
64-bit number in a numpy array: one job counts the grams of a slice of texts at a time and adds them up by a shuffle, and
another turns each text into its vector, once, in a table that the later stages read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from labspark.tables import fresh, written

#: Longest grams. A character takes 21 bits of a number, so three fit.
LONGEST = 3
_BITS = 21
#: Characters and texts that a Python worker handles at once (a longer text is handled alone); their numbers stay in a core's cache.
SLICE_CHARS = 1 << 17
SLICE_TEXTS = 256


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive parts of a column; null is empty."""
    start, held, chars = 0, [], 0
    for i, text in enumerate(texts):
        body = text.as_py() or ""
        if held and (chars + len(body) > SLICE_CHARS or len(held) == SLICE_TEXTS):
            yield start, held
            start, held, chars = i, [], 0
        held.append(body)
        chars += len(body)
    if held:
        yield start, held


def _codes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per gram size: the numbers of all grams of the texts, and the place of the text of each."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1  # 0: no character
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = chars
    for size in range(1, LONGEST + 1):
        if size > 1:
            codes = (codes[:-1] << _BITS) | chars[size - 1:]
        if not len(codes):
            return
        inside = owner[:len(codes)] == owner[size - 1:]
        yield codes[inside], owner[:len(codes)][inside]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _slices(batch.column(0)):
            for codes, _ in _codes(texts):
                grams, counts = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts.astype(np.int64))], ["gram", "n"])


def gram_counts(texts: DataFrame, text: str) -> DataFrame:
    """(gram, n): every distinct gram of 1 to 3 characters, as a number, and how often it occurs."""
    return texts.select(text).mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _finder(grams: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Maps numbers of grams to their places in the list, others to its length.

    Hash tables of one entry a slot: a gram whose slot an earlier one holds is in the next table, with another hash.
    """
    size = len(grams)
    known = np.array([*grams, -1], np.int64)
    shift = np.uint64(64 - (16 * size).bit_length())
    left, tables = np.arange(size), []
    while len(left):
        factor = np.uint64(0x9E3779B97F4A7C15 * (2 * len(tables) + 1) % (1 << 64))
        slots = (known[left].view(np.uint64) * factor) >> shift
        first = np.unique(slots, return_index=True)[1]
        table = np.full(1 << int(64 - shift), size, np.int32)
        table[slots[first]] = left[first]
        tables.append((factor, table))
        left = np.delete(left, first)

    def find(codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), size, np.int64)
        rest = slice(None)
        for factor, table in tables:
            some = codes[rest]
            at = table[(some.view(np.uint64) * factor) >> shift]
            hit = known[at] == some
            out[rest] = np.where(hit, at, size)
            missed = np.flatnonzero(~hit)
            rest = missed if isinstance(rest, slice) else rest[missed]
        return out
    return find


class _GramParams(Params, DefaultParamsReadable, DefaultParamsWritable):
    text = Param(Params._dummy(), "text", "column of the texts", TypeConverters.toString)
    out = Param(Params._dummy(), "out", "column for the vectors", TypeConverters.toString)
    vocabulary = Param(Params._dummy(), "vocabulary", "most grams to learn", TypeConverters.toInt)
    grams = Param(Params._dummy(), "grams", "numbers of the grams, by entry of the vectors", TypeConverters.toList)

    def __init__(self, **values):
        super().__init__()
        self._set(**values)


class CharGrams(_GramParams, Estimator):
    """Learns the ``vocabulary`` most frequent character 1-3-grams of the lower-cased texts of column ``text``."""

    def _fit(self, dataset: DataFrame) -> CharGramsModel:
        text, out, vocabulary = map(self.getOrDefault, (self.text, self.out, self.vocabulary))
        counts = gram_counts(dataset.select(F.lower(text).alias("text")), "text")
        # no more rows than the vocabulary has
        found = [r["gram"] for r in counts.orderBy(F.desc("n"), "gram").limit(vocabulary).collect()]
        if not found:
            raise ValueError("no text to learn from")
        return CharGramsModel(text=text, out=out, grams=found)


class CharGramsModel(_GramParams, Model):
    """Adds the vector of counts of each text; entry i counts the gram ``grams[i]``.

    The rows are written, so that stages which read them several times do not count again.
    """

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text, out, grams = map(self.getOrDefault, (self.text, self.out, self.grams))
        (lowered,) = fresh(dataset, "_lowered")
        kept = dataset.columns
        vector = T.StructField(out, VectorUDT())
        plain = T.StructField(out, VectorUDT.sqlType())
        as_struct = T.StructType([*dataset.schema.fields, plain])
        find, size, struct = _finder(grams), len(grams), to_arrow_type(plain.dataType)

        def vectors(texts: list[str]) -> pa.Array:
            counts = np.zeros(len(texts) * size, np.int64)
            for codes, owner in _codes(texts):
                at = find(codes)
                hit = at < size
                counts += np.bincount(owner[hit] * size + at[hit], minlength=len(counts))
            found = np.flatnonzero(counts)
            ends = pa.array(np.searchsorted(found, np.arange(len(texts) + 1) * size).astype(np.int32))
            parts = {"type": np.zeros(len(texts), np.int8), "size": np.full(len(texts), size, np.int32),
                     "indices": (found % size).astype(np.int32), "values": counts[found].astype(np.float64)}
            return pa.StructArray.from_arrays([
                pa.ListArray.from_arrays(ends, pa.array(parts[f.name]), type=f.type) if f.name in ("indices", "values")
                else pa.array(parts[f.name], f.type) for f in struct], fields=list(struct))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, texts in _slices(batch.column(len(kept))):
                    rows = batch.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-1], vectors(texts)], [*kept, out])

        counted = dataset.select("*", F.lower(text).alias(lowered)).mapInArrow(work, as_struct)
        return written(counted, "grams", T.StructType([*dataset.schema.fields, vector]))
