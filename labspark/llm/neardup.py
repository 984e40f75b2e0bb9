"""Near-duplicates by weighted MinHash (DartMinHash) over five-word shingles, banded and verified.

A text is the multiset of its five-word shingles. Every unit of weight of a shingle (its first, second,
... occurrence) is a region into which hashed darts fall as a Poisson process in rank: arrival after
arrival, each with a coordinate. Only arrivals up to a rank at which all coordinates are filled are
thrown, so the work is the number of shingles plus some k ln k darts, whatever k. The earliest dart of
each coordinate is its signature value; two texts agree in a coordinate with the probability of their
weighted Jaccard similarity.

Equal texts are one node. Bands of the signature give buckets; candidate pairs within buckets are
verified by the exact weighted Jaccard similarity; connected components of the links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.shared import components, join_checked, written
from labspark.tables import fresh

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
#: Texts of a part of a bucket that are compared with each other, and those that all its parts share.
PART_TEXTS = 256
LEADERS = 8

_A = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, and the number of words of each text.

    ``data`` holds the UTF-8 bytes of all texts, ``starts`` their first bytes and the end. Words are
    runs of bytes other than blank, tab, \\n, \\v, \\f and \\r.
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    in_word = ~blank
    first = in_word.copy()
    first[1:] &= blank[:-1]
    begins = starts[:-1][starts[:-1] < len(data)]
    first[begins] = in_word[begins]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(at, np.diff(np.append(at, len(data)))) if at[0] == 0 else np.concatenate(
        [np.zeros(at[0], np.int64), np.repeat(at, np.diff(np.append(at, len(data))))])
    powers = np.full(int(place.max()) + 1, _WORD_BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    terms = np.where(in_word, data.astype(np.uint64) + np.uint64(1), np.uint64(0)) * powers[place]
    hashes = _mix(np.add.reduceat(terms, at))
    return hashes, np.searchsorted(at, starts[1:]) - np.searchsorted(at, starts[:-1])


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and starts of a string column without copying (null: empty)."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[starts[0]:starts[-1]], starts - starts[0]


def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, element) of all texts: an element is a shingle with its occurrence number, hashed.

    A text with one to four words has one shingle, all of it; one without words has none.
    """
    data, starts = batch_bytes(column)
    words, counts = word_hashes(data, starts)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    reach = np.where(counts >= WORDS, WORDS, counts)[owner] if len(owner) else np.empty(0, np.int64)
    left = ends[owner] - np.arange(len(words)) if len(words) else np.empty(0, np.int64)
    full = left >= reach
    full &= (counts[owner] >= WORDS) | (left == reach) if len(words) else full
    at = np.flatnonzero(full)
    value = np.zeros(len(at), np.uint64)
    for i in range(WORDS):
        inside = i < reach[at]
        value[inside] = (value[inside] + words[at[inside] + i]) * _A + np.uint64(i + 1)
    value, owner = _mix(value), owner[at]
    return owner, value ^ _occurrence(owner, value)


def _occurrence(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of a value in its text, a hash of the occurrence number for later ones."""
    extra = np.zeros(len(value), np.uint64)
    order = np.argsort(value)
    equal = value[order[1:]] == value[order[:-1]]
    repeated = np.zeros(len(value), bool)
    repeated[1:] |= equal
    repeated[:-1] |= equal
    some = order[repeated]  # only values that occur twice or more, in any text
    some = some[np.lexsort((owner[some], value[some]))]
    again = np.zeros(len(some), bool)
    again[1:] = (value[some[1:]] == value[some[:-1]]) & (owner[some[1:]] == owner[some[:-1]])
    run = np.arange(len(some))
    layer = run - np.maximum.accumulate(np.where(again, 0, run)) if len(some) else run
    later = layer > 0
    extra[some[later]] = _mix(layer[later].astype(np.uint64) * _A)
    return extra


def signatures(owner: np.ndarray, element: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signature values; rows of texts without elements stay 0."""
    size = np.bincount(owner, minlength=n).astype(np.float64)
    out = np.zeros((n, k), np.uint64)
    todo = np.flatnonzero(size)
    darts = k * (np.log(k) + 3)
    while len(todo):
        # arrivals up to this rank: some ``darts`` per text, so that hardly any coordinate stays empty
        limit = np.zeros(n)
        limit[todo] = darts / size[todo]
        live = np.flatnonzero(limit[owner] > 0)
        rank = np.zeros(len(live))
        best_rank, best_row, best_id = [], [], []
        arrival = 0
        while len(live):
            arrival += 1
            draw = _mix(element[live] + np.uint64(arrival * int(_A) % 2 ** 64))
            rank = rank - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53)
            within = rank <= limit[owner[live]]
            live, rank, draw = live[within], rank[within], draw[within]
            dart = _mix(draw ^ np.uint64(0xA5A5A5A55A5A5A5A))
            best_rank.append(rank)
            best_row.append(owner[live] * k + (dart % np.uint64(k)).astype(np.int64))
            best_id.append(dart)
        rank, row, dart = np.concatenate(best_rank), np.concatenate(best_row), np.concatenate(best_id)
        earliest = np.full(n * k, np.inf)
        np.minimum.at(earliest, row, rank)
        first = rank == earliest[row]
        filled = np.bincount(row[first] // k, minlength=n)
        out.reshape(-1)[row[first]] = dart[first]
        todo = todo[filled[todo] < k]
        darts *= 2
    return out


def band_keys(column: pa.Array) -> list[np.ndarray | None]:
    """Keys of the bands of each text; None for a text without words."""
    owner, element = elements(column)
    table = signatures(owner, element, len(column), BANDS * ROWS).reshape(len(column), BANDS, ROWS)
    keys = np.zeros((len(column), BANDS), np.uint64)
    for i in range(ROWS):
        keys = (keys + table[:, :, i]) * _A
    keys = _mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    some = np.bincount(owner, minlength=len(column)) > 0
    return [keys[i] if some[i] else None for i in range(len(column))]


def _batches(batch: pa.RecordBatch, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some ``most`` text bytes (column 1), at least a row each."""
    start, held = 0, 0
    for i, length in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        held += length or 0
        if held > most and i > start:
            yield batch.slice(start, i - start)
            start, held = i, length or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def with_bands(texts: DataFrame) -> DataFrame:
    """(uid, bands) of rows (uid, text); bands is null for texts without words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(band_keys(part.column(1)), pa.list_(pa.int64()))], ["uid", "bands"])

    return texts.select("uid", "text").mapInArrow(work, "uid string, bands array<long>")


def with_elements(texts: DataFrame) -> DataFrame:
    """(uid, elements) of rows (uid, text): the multiset of shingles as a set of hashes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                owner, element = elements(part.column(1))
                ends = np.cumsum(np.bincount(owner, minlength=part.num_rows))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(element.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["uid", "elements"])

    return texts.select("uid", "text").mapInArrow(work, "uid string, elements array<long>")


def bucket_entries(bands: DataFrame) -> DataFrame:
    """(key, uid, n, lead) of every text in every bucket of several texts: its size and its leader.

    Leaders are chosen by one order of all texts, so similar buckets tend to have the same leader.
    """
    entry = bands.select("uid", F.explode("bands").alias("key"))
    sizes = entry.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("uid"), "uid")).alias("lead"))
    return entry.join(sizes.where("n > 1"), "key").select("key", "uid", "n", F.col("lead.uid").alias("lead"))


def leader_pairs(entries: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of every text and the leaders of its buckets: at most a pair per text and band."""
    return _ordered(entries.select(F.col("lead").alias("x"), F.col("uid").alias("y")))


def mixed_buckets(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, uid, n, root, home) of buckets of three or more texts that still hold several classes.

    home is the largest class of the bucket. Of buckets with the same members only one is kept. A
    bucket of two is its leader and one other, so it has been verified.
    """
    classed = entries.where("n > 2").join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn(
        "root", F.coalesce("root", "uid"))
    per_class = classed.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.first("n").alias("n"))
    homes = per_class.groupBy("key").agg(
        F.max(F.struct("c", "root")).alias("home"), F.count(F.lit(1)).alias("classes"), F.bit_xor("x").alias("x"),
        F.first("n").alias("n")).where("classes > 1")
    once = homes.groupBy("n", "x").agg(F.min("key").alias("key"), F.min_by("home", "key").alias("home"))
    return classed.join(once.select("key", F.col("home.root").alias("home")), "key")


def links_within(mixed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between different classes within ``mixed_buckets``, by exact similarity.

    A bucket is cut into parts of some PART_TEXTS texts; a text comes once to each part with its
    elements. In a part every text outside the largest class is compared with all others, and one link
    per class that it meets is returned. Parts of one bucket share its first LEADERS texts. Texts of
    different parts are left to ``links_across``.
    """
    parts = F.ceil(F.col("n") / PART_TEXTS).cast("long")
    mixed = written(mixed.withColumn("turn", F.xxhash64("uid", "key")).withColumn("parts", parts).withColumn(
        "part", F.pmod("turn", "parts")), "mixed")
    leaders = mixed.where("parts > 1 and part = 0").groupBy("key", "parts").agg(F.slice(F.sort_array(
        F.collect_list(F.struct("turn", "uid", "root", "home"))), 1, LEADERS).alias("m"))  # of one part
    shared = leaders.select("key", F.explode("m").alias("m"), "parts").select(
        "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)).alias("part"), "m.uid", "m.root", "m.home")
    rows = mixed.select("key", "part", "uid", "root", "home").unionByName(shared)
    return _compared(rows.withColumn("asks", F.col("root") != F.col("home")), ["key", "part"], texts, similarity)


def links_across(mixed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All links (a, b) that split buckets still lack, by exact similarity, one per text and class it meets
    in a group.

    ``mixed`` are the ``mixed_buckets`` of more than PART_TEXTS texts after ``links_within``. The texts outside
    the largest class are cut into blocks, and each block meets each part of its bucket in a group of its own,
    so every pair of different classes is compared, whatever the size of the bucket.
    """
    turn = F.xxhash64("uid", "key")
    outside = F.col("root") != F.col("home")
    blocks = mixed.groupBy("key").agg(
        F.ceil(F.count(F.lit(1)) / PART_TEXTS).cast("long").alias("parts"),
        F.ceil(F.count(F.when(outside, 1)) / PART_TEXTS).cast("long").alias("blocks"))
    sized = written(mixed.select("key", "uid", "root", "home").join(blocks, "key"), "split")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    held = sized.withColumn("part", F.pmod(turn, "parts")).withColumn("block", F.explode(every)).withColumn(
        "asks", F.lit(False))
    asking = sized.where(outside).withColumn("block", F.pmod(turn, "blocks")).withColumn("part", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("asks", F.lit(True))
    # an asking text of the part itself comes once
    rows = held.unionByName(asking).groupBy("key", "block", "part", "uid", "root", "home").agg(
        F.max("asks").alias("asks"))
    return _compared(rows, ["key", "block", "part"], texts, similarity)


def _compared(rows: DataFrame, group: list[str], texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the rows (..., uid, root, asks) that ask with all others of their group."""
    uids = written(rows.select("uid").distinct(), "uids")
    sets = _sets(texts, uids, uids.count())

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        uid, root = table.column("uid").to_pylist(), table.column("root").to_pylist()
        asks = table.column("asks").to_pylist()
        lists = table.column("elements").combine_chunks()
        values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
        size = np.diff(cuts)
        owner = np.repeat(np.arange(len(uid)), size)
        held = values[cuts[0]:cuts[-1]]
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        out: list[tuple[str, str]] = []
        for i in range(len(uid)):
            if not asks[i]:
                continue
            own = values[cuts[i]:cuts[i + 1]]
            start, end = np.searchsorted(held, own), np.searchsorted(held, own, "right")
            n = end - start
            at = np.repeat(start - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(uid))
            near = np.flatnonzero(common >= similarity * (size[i] + size - common))
            met = {root[j]: j for j in near if root[j] != root[i]}
            out += [(uid[i], uid[j]) for j in met.values()]
        return pa.table({"a": pa.array([x for x, _ in out], pa.string()), "b": pa.array([y for _, y in out], pa.string())})

    return rows.select(*group, "uid", "root", "asks").join(sets, "uid").groupBy(*group).applyInArrow(work, "a string, b string").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sets(texts: DataFrame, uids: DataFrame, n: int) -> DataFrame:
    """(uid, elements), once per wanted uid."""
    chosen = with_elements(join_checked(texts, uids, "uid", "left_semi", n))
    return written(chosen.groupBy("uid").agg(F.first("elements").alias("elements")), "elements")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b, similarity) whose exact weighted Jaccard similarity is high enough.

    Only texts of pairs are shingled again. A text in many pairs is copied to as many salts as its
    pairs need, so no task holds all pairs of a leader.
    """
    both = pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid")))
    degrees = written(both.groupBy("uid").agg(F.count(F.lit(1)).alias("n")), "degrees")
    n = degrees.count()
    sets = _sets(texts, degrees.select("uid"), n)
    salts = F.ceil(F.col("n") / 64).cast("long")

    def side(name: str, other: str) -> DataFrame:
        copies = sets.join(degrees, "uid").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        return copies.select(F.col("uid").alias(name), F.col("salt").alias(f"s{name}"), F.col("elements").alias(f"e{name}"))

    def salt_of(name: str, other: str) -> Column:
        return F.pmod(F.xxhash64(other), F.ceil(F.col(f"n{name}") / 64).cast("long")).alias(f"s{name}")

    da = degrees.select(F.col("uid").alias("a"), F.col("n").alias("na"))
    db = degrees.select(F.col("uid").alias("b"), F.col("n").alias("nb"))
    keyed = pairs.join(da, "a").join(db, "b").select("a", "b", salt_of("a", "b"), salt_of("b", "a"))
    joined = keyed.join(side("a", "b"), ["a", "sa"]).join(side("b", "a"), ["b", "sb"])
    common = F.size(F.array_intersect("ea", "eb"))
    return joined.select("a", "b", (common / (F.size("ea") + F.size("eb") - common)).alias("similarity")
                         ).where(F.col("similarity") >= similarity)


def text_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, uid) of all rows, and per uid of a class of several texts (uid, root).

    ``docs`` has doc_id and text. uid is the MD5 of the text; rows without a text or words have none.
    """
    texts = docs.select("doc_id", F.when(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.md5("text")).alias("uid"), "text")
    distinct = texts.where("uid is not null")
    signed = with_bands(distinct.select("uid", "text"))
    # equal texts have equal bands: one of them stays
    bands = written(signed.groupBy("uid").agg(F.first("bands").alias("bands")), "bands")
    entries = written(bucket_entries(bands), "entries")
    # most groups are whole after comparing with leaders; only buckets that still hold several classes go on
    first = written(leader_pairs(entries), "pairs")
    near = components(verified(first, distinct, similarity).select(F.col("a").alias("u"), F.col("b").alias("v")))
    more = links_within(mixed_buckets(entries, near), distinct, similarity).select(
        F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(more.union(near.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    # parts of a split bucket have not met; those of buckets that are still of several classes do now
    split = written(mixed_buckets(entries.where(F.col("n") > PART_TEXTS), roots), "split")
    if not split.isEmpty():
        rest = links_across(split, distinct, similarity).select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = components(rest.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    return texts.select("doc_id", "uid"), roots.select(F.col("node").alias("uid"), "root")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, copies, keep.

    class_id is the smallest doc_id of the class (null ids come last), class_size its rows, copies the
    rows with the same text. keep marks the rows with the class
    id; repeated rows of one id are all marked, ``one_of_each`` leaves one. A row without words or text
    is a class of its own with its own id. Other columns are left out; no rows, no result.
    """
    keyed, roots = text_classes(docs, similarity)
    keyed = written(keyed, "keyed")
    roots = written(roots, "roots")
    per_text = written(keyed.where("uid is not null").groupBy("uid").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "texts")
    rooted = per_text.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    known = rooted.join(whole, "root").select("uid", "class_id", "class_size", "copies")
    known = written(known, "known")
    # hot texts are split by adaptive execution: both sides are read from written tables
    with_class = keyed.where("uid is not null").join(known, "uid").select(
        "doc_id", "class_id", "class_size", "copies")
    alone = keyed.where("uid is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias(
        "class_size"), F.lit(1).cast("long").alias("copies"))
    return with_class.unionByName(alone).withColumn("keep", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each class, all their columns: the one with the smallest doc_id.

    Only texts of classes with several rows are looked up; other rows pass through in place.
    """
    own, stays, least = fresh(docs, "_uid", "_stays", "_least")
    keyed, roots = text_classes(docs, similarity)
    keyed = written(keyed, "keyed")
    per_text = keyed.where("uid is not null").groupBy("uid").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    rooted = written(per_text.join(roots, "uid", "left").withColumn(
        "root", F.coalesce("root", "uid")), "rooted")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "uid")).alias("best"),
                                      F.sum("copies").alias("size"))
    marks = written(rooted.join(best.where("size > 1"), "root").select(
        F.col("uid").alias(own), (F.col("uid") == F.col("best.uid")).alias(stays), F.col("best.least").alias(least)), "marks")
    uid = F.when(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.md5("text"))
    marked = join_checked(docs.withColumn(own, uid), marks, own, "left", marks.count())
    others = marked.where(F.col(stays).isNull()).select(*docs.columns)
    # rows with the text and the id that stay are all alike up to extra columns: any one
    chosen = marked.where(F.col(stays) & F.col("doc_id").eqNullSafe(F.col(least))).dropDuplicates([own])
    return others.union(chosen.select(*docs.columns))
