"""Fill-in-the-middle: cut each text in three at two hashed places and put the pieces in another order.

A text becomes units (a run of ASCII letters, or one other code point). Prefix, middle and suffix are runs of
units. The whole cut is a pipeline of pyarrow.compute kernels over a batch of texts, without a loop
over texts or units: split units into list arrays, flatten them with parent indices, take ordinals,
filter by role, rebuild lists and join them. Every unit gets one mark of a byte that UTF-8 never holds, so
splitting at that byte gives back exactly the units.

Defined results: null texts count as empty, empty texts stay plain, null doc_ids hash as an empty number,
repeated rows give equal rows, no rows give none. Texts are cut whole; batches are processed in
slices of SLICE_BYTES, a longer text being a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from labspark.llm.shared import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of texts that stay as they are, and of the others that start with the suffix.
PLAIN_PERCENT = 10
SPM_PERCENT = 20
#: Text bytes handled at once in a Python worker; the kernels hold up to a hundred times as much.
SLICE_BYTES = 256 << 10

#: A unit, byte by byte: a run of ASCII letters, a whole UTF-8 sequence, or another byte.
_UNIT = r"[A-Za-z]+|[\xc0-\xff][\x80-\xbf]*|[^A-Za-z]"
_END = b"\xff"


def hashes(doc_id: Column, seed: int = 1) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``, as longs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def units(texts: pa.Array) -> pa.ListArray:
    """The units of each text as bytes; the last entry of every list is empty and marks its end."""
    marked = pc.replace_substring_regex(texts.cast(pa.large_binary()), pattern=_UNIT, replacement=rb"\0" + _END)
    return pc.split_pattern(marked, pattern=_END)


def remainder(values: pa.Array, by: pa.Array | int) -> pa.Array:
    return pc.subtract(values, pc.multiply(pc.divide(values, by), by))


def joined(values: pa.Array, counts: pa.Array) -> pa.Array:
    """Lists of the given lengths over the values, each joined to one string."""
    ends = pc.cumulative_sum(counts)
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends.cast(pa.int64())]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), pa.scalar(b"", pa.large_binary())).cast(pa.large_string())


def transformed(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array,
                plain_percent: int, spm_percent: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch of texts (large_string, no nulls)."""
    split = units(texts)
    n = pc.subtract(pc.list_value_length(split).cast(pa.int64()), 1)
    one, other = (remainder(h, pc.add(n, 1)) for h in (h1, h2))
    low, high = pc.min_element_wise(one, other), pc.max_element_wise(one, other)

    flat, parent = pc.list_flatten(split), pc.list_parent_indices(split)
    places = pa.array(np.arange(len(flat), dtype=np.int64))
    ordinal = pc.subtract(places, pc.take(split.offsets[:-1].cast(pa.int64()), parent))
    before_middle = pc.less(ordinal, pc.take(low, parent))
    before_suffix = pc.less(ordinal, pc.take(high, parent))
    inside = pc.less(ordinal, pc.take(n, parent))
    prefix = joined(flat.filter(before_middle), low)
    middle = joined(flat.filter(pc.and_not(before_suffix, before_middle)), pc.subtract(high, low))
    suffix = joined(flat.filter(pc.and_not(inside, before_suffix)), pc.subtract(n, high))

    plain = pc.or_(pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, "|".join((PREFIX, SUFFIX, MIDDLE)))),
                   pc.greater_equal(remainder(h3, 100), 100 - plain_percent))
    spm = pc.less(remainder(h4, 100), spm_percent)
    mark = {m: pa.scalar(m, pa.large_string()) for m in (PREFIX, SUFFIX, MIDDLE, "")}
    middle_last = [mark[MIDDLE], middle, mark[""]]
    psm_form = pc.binary_join_element_wise(mark[PREFIX], prefix, mark[SUFFIX], suffix, *middle_last)
    spm_form = pc.binary_join_element_wise(mark[SUFFIX], suffix, mark[PREFIX], prefix, *middle_last)
    nothing = pa.scalar(None, pa.int64())
    return [
        n, pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        pc.if_else(plain, nothing, pc.utf8_length(prefix)), pc.if_else(plain, nothing, pc.utf8_length(middle)),
        pc.if_else(plain, texts, pc.if_else(spm, spm_form, psm_form)).cast(pa.string())]


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The exact texts from outputs (large_string) and forms alone: every mark occurs once in a form that has marks."""
    plain, spm = pc.equal(form, "plain"), pc.equal(form, "spm")
    marked = pc.if_else(plain, PREFIX + SUFFIX + MIDDLE, output)
    halves = pc.split_pattern(marked, pattern=MIDDLE)
    front, middle = pc.list_element(halves, 0), pc.list_element(halves, 1)
    outer = pc.split_pattern(pc.replace_substring(front, pattern=SUFFIX, replacement=PREFIX), pattern=PREFIX)
    first, second = pc.list_element(outer, 1), pc.list_element(outer, 2)
    empty = pa.scalar("", pa.large_string())
    whole = pc.binary_join_element_wise(pc.if_else(spm, second, first), middle, pc.if_else(spm, first, second), empty)
    return pc.if_else(plain, output, whole).cast(pa.string())


def infill(docs: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``docs`` has doc_id and text (others are left out). A text that is empty or holds a mark stays plain. The places and
    forms depend on the seed and the doc_id alone, so a repeated run gives the same result. No shuffle.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                texts = part.column(1).cast(pa.large_string())
                made = transformed(texts, *[part.column(i) for i in range(2, 6)], plain_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                        *[h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("doc_id"), seed), 1)])
    return asked.mapInArrow(work, f"doc_id {key}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame) -> DataFrame:
    """Add ``restored``, the exact text rebuilt from the columns output and form; other columns stay.

    A column of that name is replaced.
    """
    rows = rows.drop("restored")
    schema = StructType([*rows.schema.fields, StructField("restored", StringType())])
    at, form_at = rows.columns.index("output"), rows.columns.index("form")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at, SLICE_BYTES):
                text = rebuilt(part.column(at).cast(pa.large_string()), part.column(form_at).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "restored"])

    return rows.mapInArrow(work, schema)
