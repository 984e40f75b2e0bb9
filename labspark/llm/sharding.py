"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Row number x of n rows goes to place p(x), shard p mod S, slot p div S. p is a Feistel network over
the smallest square a*a >= n with cycle walking: whoever knows n and the seed can compute shard and
slot of any row number, in any system, from ``round_keys`` and ``permute_one``.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.shared import numbered
from labspark.tables import fresh

PRIME = 2_147_483_647
ROUNDS = 6


def side_of(n: int) -> int:
    """Smallest a with a * a >= n, at least 1."""
    root = isqrt(max(n, 1))
    return root if root * root >= n else root + 1


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three constants per round, each from 1 to PRIME - 1, from a Lehmer sequence."""
    state, keys = seed % (PRIME - 1) + 1, []
    for _ in range(ROUNDS):
        key = []
        for _ in range(3):
            for _ in range(4):
                state = state * 48_271 % PRIME
            key.append(state)
        keys.append(tuple(key))
    return keys


def permute_one(x: int, n: int, seed: int) -> int:
    """The place of row number x (0 <= x < n): the same arithmetic as the column form."""
    a, keys = side_of(n), round_keys(seed)
    while True:
        left, right = divmod(x, a)
        for mult, add, last in keys:
            mixed = (right * mult + add) % PRIME
            left, right = right, (left + mixed * ((mixed + last) % PRIME) % PRIME) % a
        x = left * a + right
        if x < n:
            return x


def permuted(x: Column, n: int, seed: int) -> Column:
    """Column form of ``permute_one``.

    All but about 2 / sqrt(n) of the values end in range at once. The others walk eight steps more; only who is still
    out of range then, one row in sqrt(n) ** 9, gets the longest possible walk, so no row is left over.
    """
    a = side_of(n)
    keys = F.array(*[F.struct(*[F.lit(k).cast("long").alias(f) for f, k in zip("mab", key, strict=True)])
                     for key in round_keys(seed)])

    def step(state: Column, key: Column) -> Column:
        right = state["r"]
        mixed = (right * key["m"] + key["a"]) % F.lit(PRIME)
        scrambled = mixed * ((mixed + key["b"]) % F.lit(PRIME)) % F.lit(PRIME)
        return F.struct(right.alias("l"), ((state["l"] + scrambled) % F.lit(a)).alias("r"))

    def once(value: Column) -> Column:
        start = F.struct(F.floor(value / F.lit(a)).cast("long").alias("l"), (value % F.lit(a)).alias("r"))
        return F.aggregate(keys, start, step, lambda s: s["l"] * F.lit(a) + s["r"])

    def walk(value: Column, _: Column) -> Column:
        return F.when(value < F.lit(n), value).otherwise(once(value))

    def further(value: Column, steps: int) -> Column:
        """The value walked on; the array of steps is made only for a row that needs it."""
        return F.aggregate(F.array(value), F.lit(0).cast("long"), lambda _, at: F.when(at < F.lit(n), at).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(steps)), at, walk)))

    return further(further(once(x), 8), max(1, a * a - n))


def into_shards(df: DataFrame, order: list[str], shards: int, seed: int = 17) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot``: a shuffle that the content of the rows fixes.

    Shards differ by one row at most and slots are gapless from 0. ``order`` must identify a row up
    to repeated rows, which are interchangeable; nulls sort first. An empty table stays empty; other
    columns stay; existing columns of the three names are replaced.
    """
    rows = numbered(df.drop("row_number", "shard", "slot"), order, "row_number")
    n = rows.count()
    (to,) = fresh(rows, "_to")
    place = permuted(F.col("row_number"), n, seed)
    return rows.withColumn(to, place).select(
        *rows.columns, (F.col(to) % shards).cast("int").alias("shard"),
        F.floor(F.col(to) / shards).cast("long").alias("slot"))
