"""Mix sources to target weights by Pfair scheduling of whole blocks.

Each source (stratum) has an integer weight q. With D the sum of the weights of the sources that still
have blocks, a cycle of D places gives each of them q places: block i (from 1) of a source is released
at floor((i - 1) D / q) and due at ceil(i D / q) places from the start of the cycle, and every place
goes to the released block that is due first. So at every place of the stream a source is less than
one block ahead of or behind its target. A source without blocks leaves, and the rest keep their
weights among themselves; the stream ends when all rows are placed. Every row is placed exactly once:
mixing orders, it neither repeats nor drops.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm.shared import join_checked, numbered, written
from labspark.tables import fresh

#: Target weights of production sources. Every other source that occurs is a stratum too, with the weight OTHER_WEIGHT.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2, "src5": 2, "src6": 1, "src7": 1}
OTHER_WEIGHT = 1
#: The stratum of rows without a source.
NO_SOURCE = "(none)"
BLOCK_ROWS = 64


def cycle_places(weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """Earliest deadline first over one cycle: (stratum, block of the cycle from 0, place, release, deadline).

    Equal deadlines: the heavier stratum first, then the name. One processor and weights that sum to
    one: every block meets its deadline, and no place stays empty.
    """
    total = sum(weights.values())

    def block(name: str, i: int) -> tuple:
        q = weights[name]
        return (i - 1) * total // q, -(-i * total // q), -q, name, i  # release, deadline, tie-breaks

    waiting = [block(name, 1) for name in weights]
    heapq.heapify(waiting)
    due: list[tuple] = []
    placed = []
    for place in range(total):
        while waiting and waiting[0][0] <= place:
            release, *rest = heapq.heappop(waiting)
            heapq.heappush(due, (*rest, release))
        deadline, _, name, i, release = heapq.heappop(due)
        placed.append((name, i - 1, place, release, deadline))
        if i < weights[name]:
            heapq.heappush(waiting, block(name, i + 1))
    return placed


def mix(df: DataFrame, order: list[str], source: str = "source", weights: dict[str, int] = WEIGHTS,
        other_weight: int = OTHER_WEIGHT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add stratum, block (from 0 in its stratum), slot (place of the block in the stream), offset in the
    block, release and deadline (in slots of the stream); columns of these names are replaced.

    Each source that occurs is a stratum of its own; unlisted ones have ``other_weight``, null sources
    form the stratum NO_SOURCE. ``order`` fixes the order inside a source; rows equal in all of it are interchangeable. Only
    the last block of a stratum can be short; slots of blocks that a source no longer has stay empty. Weights
    are whole numbers from 1. The driver holds one row per source and the schedule, at most (sources x sum of weights) rows:
    sources are named data sets, so some thousand at most. Empty tables stay empty.
    """
    helpers = fresh(df, "_row", "_first", "_q", "_cycle", "_of", "_begin", "_end", "_base", "_total", "_place", "_r", "_d")
    row, first, q, cycle, of, begin, end, base, total, place, released, due = helpers
    rows = numbered(df.withColumn("stratum", F.coalesce(F.col(source), F.lit(NO_SOURCE))), ["stratum", *order], row)
    sizes = {r["stratum"]: (r["first"], r["n"]) for r in rows.groupBy("stratum").agg(
        F.min(row).alias("first"), F.count(F.lit(1)).alias("n")).collect()}  # a row per source
    full = {name: weights.get(name, other_weight) for name in sizes}
    lasts = {name: -(-n // (block_rows * full[name])) for name, (_, n) in sizes.items()}  # cycles it stays
    plan, start, slots = [], 0, 0
    for stop in sorted(set(lasts.values())):
        active = {name: full[name] for name in sorted(lasts) if lasts[name] >= stop}
        whole = sum(active.values())
        plan += [(name, index, start, stop, slots, whole, at, release, deadline)
                 for name, index, at, release, deadline in cycle_places(active)]
        slots, start = slots + (stop - start) * whole, stop
    spark = df.sparkSession
    schedule = spark.createDataFrame(plan, f"stratum string, {of} long, {begin} long, {end} long, {base} long, {total} long,"
                                           f" {place} long, {released} long, {due} long")
    sources = spark.createDataFrame([(name, at, full[name]) for name, (at, _) in sizes.items()],
                                    f"stratum string, {first} long, {q} long")
    rank = F.col(row) - F.col(first)
    blocks = join_checked(rows, sources, "stratum", "inner", len(sizes)).withColumn(
        "block", F.floor(rank / block_rows)).withColumn("offset", (rank % block_rows).cast("int")).withColumn(
        cycle, F.floor(F.col("block") / F.col(q))).withColumn(of, F.col("block") % F.col(q))
    joined = join_checked(blocks, schedule, ["stratum", of], "inner", len(plan)).where(
        (F.col(cycle) >= F.col(begin)) & (F.col(cycle) < F.col(end)))
    at = F.col(base) + (F.col(cycle) - F.col(begin)) * F.col(total)
    added = {"slot": at + F.col(place), "release": at + F.col(released), "deadline": at + F.col(due)}
    out = ["stratum", "block", "offset", *added]
    return joined.withColumns(added).select(*[c for c in df.columns if c not in out], *out)


def mixed_documents(docs: DataFrame, with_places: bool = False, **options) -> DataFrame:
    """The documents as files in stream order: ranges of slots, sorted within each file.

    Only (source, order columns) go through the numbering; the texts are shuffled once. ``with_places`` adds
    mix_slot and mix_offset, the place in the stream, for those that read the files again (columns of these
    names are replaced).
    """
    places = ["mix_slot", "mix_offset"]
    digest, slot, offset = fresh(docs, "_digest", "_slot", "_offset")
    keyed = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit(""))))
    keys = mix(keyed.select("doc_id", "source", digest).distinct(), [digest, "doc_id"], **options)
    found = written(keys.select("doc_id", "source", digest, "slot", "offset"), "places")
    joined = keyed.alias("d").join(found.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
                                   & F.col("d.source").eqNullSafe(F.col("p.source"))
                                   & (F.col(f"d.{digest}") == F.col(f"p.{digest}")))
    columns = [F.col(f"d.{c}") for c in docs.columns if not (with_places and c in places)]
    if with_places:
        columns += [F.col("p.slot").alias("mix_slot"), F.col("p.offset").alias("mix_offset")]
    return joined.select(*columns, F.col("p.slot").alias(slot), F.col("p.offset").alias(offset)).repartitionByRange(
        slot, offset).sortWithinPartitions(slot, offset).drop(slot, offset)
