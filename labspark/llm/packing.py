"""Pack token sequences by non-negative least squares over length patterns.

Documents become token ids and an end id; longer ones are cut into pieces of the sequence length, the
first piece holding the remainder. Full pieces are sequences of their own. For the others: enumerate
the patterns of two or three lengths that fill a sequence exactly, fit how often to repeat each so
that the patterns reproduce the histogram of lengths (non-negative least squares), round, and pack the
residual counts by best fit, longest first. The plan is made from the histogram alone (at most one
number per length), and pieces look up their places by (length, rank among equal lengths).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from labspark.llm.shared import numbered, written

LENGTH = 2048
END_ID = 0
#: Gradient steps of the fit.
STEPS = 150
#: Salts that spread the pieces of one length over tasks.
SALTS = 64

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken (same ids, some four times faster)."""
    if path not in _ENCODERS:
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the file writes bytes as printable characters: printable Latin-1 as it is, the rest from U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODERS[path] = (tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special),
                           list(special))
    return _ENCODERS[path]


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text and the end id; strings of special tokens count as such, as the file's library has it."""
    coder, special = encoder(path)
    if any(s in text for s in special):
        ids = coder.encode(text, allowed_special="all")
    else:
        ids = coder.encode_ordinary(text)
    return np.append(np.array(ids, np.uint32), np.uint32(END_ID))


def pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids; then the columns of ``keep``.

    ``docs`` has doc_id and text (null: empty; others are left out). A document gives at least one piece.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for i, text in enumerate(batch.column(1)):
                ids = token_ids(text.as_py() or "", path)
                first = len(ids) % length or length
                cuts = [0, *range(first, len(ids) + 1, length)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[a:b]
                    rows.append((piece, a, b - a, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
                    at.append(i)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()),
                      *[pa.array(c, pa.int64()) for c in columns[1:4]]]
            if with_ids:
                arrays.append(pa.array(columns[4], pa.list_(pa.int32())))
            arrays += [batch.column(2 + i).take(pa.array(at, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + list(keep)
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(work, schema)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c, that sum to the capacity; c is 0 for pairs. Only lengths that occur."""
    occurs = np.zeros(capacity + 1, bool)
    occurs[lengths] = True
    found = []
    for a in lengths[::-1]:
        rest = capacity - a
        low, high = -(-rest // 2), min(a, rest)
        b = np.arange(low, high + 1)
        c = rest - b
        good = occurs[b] & (occurs[c] | (c == 0)) & (b > 0)
        if good.any():
            found.append(np.stack([np.full(good.sum(), a), b[good], c[good]], 1))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def fit(counts: np.ndarray, shapes: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2, A having a column per pattern.

    Accelerated projected gradient; the step comes from a power iteration. Index 0 is padding.
    """
    real = shapes > 0

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(shapes[:, i], x * real[:, i], len(counts)) for i in range(3))

    def backward(r: np.ndarray) -> np.ndarray:
        return (r[shapes] * real).sum(1)

    v = np.ones(len(shapes))
    bound = 1.0
    for _ in range(12):
        v = backward(forward(v))
        bound = np.linalg.norm(v)
        v /= bound
    step = 1 / (1.05 * bound)
    target = counts.astype(float)
    target[0] = 0
    x = np.zeros(len(shapes))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * backward(forward(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def within(whole: np.ndarray, shapes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeat counts cut to the pieces there are, and the pieces left over.

    Patterns with the largest repeat counts come first, so that what rounding adds gives way.
    """
    whole, left = whole.copy(), counts.copy()
    for i in np.argsort(-whole, kind="stable"):
        n = whole[i]
        if n <= 0:
            break
        parts = [p for p in shapes[i] if p > 0]
        for p in set(parts):
            n = min(n, left[p] // parts.count(p))
        for p in parts:
            left[p] -= n
        whole[i] = n
    return whole, left


def plan(counts: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, int, dict]:
    """Places for pieces: rows (length, first rank, first sequence, offset, repeats), and the number of sequences.

    The rank-th piece of a length (from 0) belongs to the row with the largest first rank up to it. The
    number of rows is bounded by the patterns and the residual bins, not by the pieces. Of the two ways
    to round, the one that needs fewer sequences is taken: each count by itself suits few pieces, the
    running sum suits many.
    """
    lengths = np.flatnonzero(counts[:capacity])
    shapes = patterns(lengths[lengths > 0], capacity)
    wanted = fit(counts, shapes) if len(shapes) else np.empty(0)
    choices = [np.diff(np.floor(np.cumsum(wanted) + 0.5), prepend=0).astype(np.int64), np.floor(wanted + 0.5).astype(np.int64)]
    plans = [_placed(counts, shapes, whole, capacity) for whole in choices]
    return min(plans, key=lambda p: p[1])


def _placed(counts: np.ndarray, shapes: np.ndarray, whole: np.ndarray, capacity: int) -> tuple[np.ndarray, int, dict]:
    """The plan of rounded repeat counts and the residuals."""
    rows: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(capacity + 1, np.int64)
    sequences = 0

    def place(length: int, first: int, offset: int, n: int) -> None:
        rows.append((length, used[length], first, offset, n))
        used[length] += n

    repeats, left = within(whole, shapes, counts.astype(np.int64))
    for i in np.flatnonzero(repeats):
        offset = 0
        for p in shapes[i]:
            if p:
                place(int(p), sequences, offset, int(repeats[i]))
                offset += int(p)
        sequences += int(repeats[i])
    by_pattern = sequences
    # residuals: best fit, longest first; open sequences are kept as runs (first, number) by free room
    rooms: dict[int, list[tuple[int, int]]] = {}
    free = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            fitting = np.flatnonzero(free[length:])
            if len(fitting):
                room = int(fitting[0]) + length
                first, n = rooms[room].pop()
                take = min(n, todo)
                if take < n:
                    rooms[room].append((first + take, n - take))
                free[room] -= take
            else:
                room, first, take = capacity, sequences, max(1, min(todo, -(-todo // max(1, capacity // length))))
                sequences += take
            place(length, first, capacity - room, take)
            todo -= take
            if room > length:
                rooms.setdefault(room - length, []).append((first, take))
                free[room - length] += take
    table = np.array(rows, np.int64).reshape(-1, 5)
    order = np.lexsort((table[:, 1], table[:, 0]))
    return table[order], sequences, {"by_pattern": by_pattern, "patterns": len(shapes)}


def pack(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to pieces (at most ``length`` long); places are gapless from 0.

    ``parts`` is read once and written in the shared folder; a column ``length`` is needed, and others
    stay. Sequences of patterns have numbers from 0, full pieces negative ones. Repeated rows are
    packed each; no pieces, no rows.
    """
    fixed = written(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    salted = fixed.where(F.col("length") < length).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
    sizes = written(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    counts = np.zeros(length + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # a row per length at most
        counts[row["length"]] = row["n"]
    table, _, _ = plan(counts, length)
    before = sizes.select("length", "_salt", (F.sum("_n").over(
        Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1).join(
        F.broadcast(before), ["length", "_salt"])  # at most ``length`` x SALTS rows
    ranked = ranked.withColumn("_rank", F.col("_k") + F.col("_before")).drop("_k", "_before", "_salt", "_row")
    shared = parts.sparkSession.sparkContext.broadcast(table)  # bounded by the patterns
    columns = [c for c in ranked.columns if c != "_rank"]

    def places(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        rows = shared.value
        # one sorted key for (length, first rank): ranks stay far below 2^48
        keys = rows[:, 0] * (1 << 48) + rows[:, 1]
        at = np.searchsorted(keys, lengths.to_numpy(np.int64) * (1 << 48) + ranks.to_numpy(np.int64), "right") - 1
        found = rows[at]
        return pd.DataFrame({"sequence_id": found[:, 2] + ranks.to_numpy() - found[:, 1], "offset": found[:, 3]})

    placed = ranked.withColumn("_at", F.pandas_udf(places, "sequence_id long, offset long")("length", "_rank")).select(
        *columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
    full = fixed.where(F.col("length") == length).select(
        *columns, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def pack_in_order(parts: DataFrame, order: list[str], window: str, length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to pieces of a stream, so that ranges of sequences hold ranges of the stream.

    Pieces of one ``window`` (a column; windows are ranges of ``order``) are planned together and share no
    sequence with others. Sequences are numbered from 0 by the first piece of the stream that they hold.
    A window's pieces that are not full come to one task, so windows must be bounded; full pieces are
    sequences of their own and are only numbered. No pieces, no rows.
    """
    fixed = written(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    schema = StructType([*fixed.schema.fields, StructField("_local", LongType()), StructField("offset", LongType())])

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in [*order, "_row"]])
        lengths = rows.column("length").to_numpy().astype(np.int64)
        table, _, _ = plan(np.bincount(lengths, minlength=length + 1), length)
        ranks = pd.Series(lengths).groupby(lengths).cumcount().to_numpy(np.int64)
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        found = table[np.searchsorted(keys, lengths * (1 << 48) + ranks, "right") - 1]
        return rows.append_column("_local", pa.array(found[:, 2] + ranks - found[:, 1], pa.int64())).append_column(
            "offset", pa.array(found[:, 3], pa.int64()))

    short = fixed.where(F.col("length") < length).groupBy(window).applyInArrow(place, schema)
    full = fixed.where(F.col("length") == length).select(
        *fixed.columns, (-F.col("_row") - 1).alias("_local"), F.lit(0).cast("long").alias("offset"))
    placed = written(short.unionByName(full), "placed")
    firsts = placed.groupBy(window, "_local").agg(F.min(F.struct(*order, "_row")).alias("_first"))
    ids = numbered(firsts, ["_first"], "sequence_id").select(window, "_local", "sequence_id")
    return placed.join(ids, [window, "_local"]).select(
        *[c for c in parts.columns if c != window], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence (at most the sequence length, so a group is bounded): sequence_id, ids, doc_ids."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
