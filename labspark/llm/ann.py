"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Vectors are scaled to length one, where the nearest by distance is the nearest by cosine. A table hashes
a vector to cells floor((a.v + b) / w) of M Gaussian (2-stable) projections. A query visits, in each
table, the PROBES perturbed cells (each coordinate one down, same or one up) that are most likely to
hold a near vector: least sum of squared distances to the cells' borders. What the tables find is merged and
ranked by the exact cosine of the original vectors. The width w is fitted on a bounded sample of
queries against all rows, so that the tables find the share RECALL of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labspark.llm.shared import written

TABLES = 8
PROJECTIONS = 10
PROBES = 500
RECALL = 0.97
#: Queries on which the width is fitted.
SAMPLE = 100
#: Index rows that a part of a table should hold; larger parts are cut.
PART_ROWS = 8192
#: Queries whose cells one task works out.
PROBING_QUERIES = 128
#: Rows of a block when queries are compared with all rows.
BLOCK_ROWS = 1024
WIDTHS = [0.5 * 1.12 ** i for i in range(40)]


class Tables:
    """The projections of all tables for vectors of one length, from a seed."""

    def __init__(self, dim: int, width: float, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.planes = rng.normal(size=(dim, TABLES * PROJECTIONS))
        self.shift = rng.uniform(size=TABLES * PROJECTIONS)
        self.width = width
        steps = np.arange(3 ** PROJECTIONS)
        # perturbations: digits -1, 0, 1 of each coordinate, and what they add to a cell's code
        self.digits = [(steps // 3 ** j) % 3 for j in range(PROJECTIONS)]

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell coordinates and the place within the cell, both n x tables x projections."""
        at = (unit @ self.planes) / self.width + self.shift
        cell = np.floor(at)
        shape = (len(unit), TABLES, PROJECTIONS)
        return cell.astype(np.int64).reshape(shape), (at - cell).reshape(shape)

    @staticmethod
    def codes(cell: np.ndarray) -> np.ndarray:
        """One number per cell of the last axis; different cells differ within +-16 of zero, others may meet."""
        code = np.zeros(cell.shape[:-1], np.int64)
        for j in range(PROJECTIONS):
            code = code * 32 + (cell[..., j] & 31)
        return code

    def borders(self, place: np.ndarray) -> np.ndarray:
        """Squared distance to the lower border, 0, and to the upper border, per coordinate."""
        return np.stack([place ** 2, np.zeros_like(place), (1 - place) ** 2], -1)

    def probes(self, cell: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Codes of the cells to visit for one query and table, the most promising first."""
        cost = np.zeros(1)
        for sides in self.borders(place)[::-1]:
            cost = (cost[:, None] + sides).ravel()
        best = np.argpartition(cost, PROBES)[:PROBES]
        best = best[np.argsort(cost[best], kind="stable")]
        moved = np.stack([cell[j] + self.digits[j][best] - 1 for j in range(PROJECTIONS)], -1)
        return np.unique(self.codes(moved))

    def finds(self, queries: np.ndarray, near: np.ndarray) -> float:
        """Share of (query, neighbour) pairs, row by row, that some table brings together."""
        (qc, qp), (nc, _) = self.cells(queries), self.cells(near)
        step = nc - qc
        hit = np.zeros(len(queries), bool)
        for t in range(TABLES):
            close = np.flatnonzero((np.abs(step[:, t]) <= 1).all(1) & ~hit)
            for i in close:
                sides = self.borders(qp[i, t])
                cost = np.zeros(1)
                for s in sides[::-1]:
                    cost = (cost[:, None] + s).ravel()
                own = sides[np.arange(PROJECTIONS), step[i, t] + 1].sum()
                hit[i] = (cost < own).sum() < PROBES
        return float(hit.mean())


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vectors: DataFrame, dim: int | None) -> DataFrame:
    """Rows with an id and a vector of finite components, not all zero, of the given length."""
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").where(good)
    return rows if dim is None else rows.where(F.size("embedding") == dim)


def _best(vec_ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((vec_ids[some], -scores[some]))][:k]


def _cosines(query: np.ndarray, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    # a row's score must not depend on which other rows are scored with it
    return np.einsum("ij,j->i", rows, query) / (norms * np.sqrt(np.einsum("i,i->", query, query)))


def exact_sample(queries: DataFrame, index: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of (query, true neighbour) pairs for at most SAMPLE queries, chosen by hash."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return np.empty((0, 1)), np.empty((0, 1))
    ids = np.array([r["vec_id"] for r in sample])
    wanted = unit(np.array([r["embedding"] for r in sample], np.float64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = batch.column(0).to_numpy(), matrix(batch.column(1))
            scores = wanted @ unit(rows).T
            scores[ids[:, None] == own[None, :]] = -9
            best = np.argsort(-scores, axis=1)[:, :k]
            q = np.repeat(np.arange(len(ids)), best.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(scores[q, best.ravel()]), batch.column(1).take(pa.array(best.ravel()))],
                ["q", "score", "embedding"])

    kind = index.schema["embedding"].dataType.simpleString()
    found = index.mapInArrow(work, f"q long, score double, embedding {kind}").where("score > -2").withColumn(
        "n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("n") <= k).collect()
    if not found:
        return np.empty((0, 1)), np.empty((0, 1))
    return wanted[[r["q"] for r in found]], unit(np.array([r["embedding"] for r in found], np.float64))


def fitted(queries: np.ndarray, near: np.ndarray, dim: int) -> Tables:
    """The smallest width that finds enough of the sampled neighbours."""
    for width in WIDTHS:
        tables = Tables(dim, width)
        if not len(queries) or tables.finds(queries, near) >= RECALL:
            return tables
    return tables


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k nearest found: query_id, rank (from 1), vec_id, score (cosine in double precision).

    Both tables have vec_id and embedding (others are left out). A query's own vec_id is no candidate;
    rows with the same id and vector count once; ties go to the smaller vec_id. Vectors that are null,
    zero, hold null or non-finite components, or are not as long as the most common length, take no part.
    A query whose cells hold fewer than k candidates is compared with all rows, so it has fewer than k rows
    only if fewer candidates exist. That costs one comparison with every row for each such query: the README states their
    share. No usable rows: no result.

    Of equal vectors only the k + 1 smallest ids enter the index (no other can be among the first k),
    so a vector that many rows share makes no hot bucket.
    """
    lengths = usable(vectors, None).groupBy(F.size("embedding").alias("dim")).count().orderBy(
        F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 1
    rows = lengths[0]["count"] if lengths else 0
    kind = vectors.schema["embedding"].dataType.simpleString()
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    index = written(usable(vectors, dim).distinct().withColumn("n", F.row_number().over(copies)).where(
        F.col("n") <= k + 1).drop("n"), "vectors")
    asked = usable(queries, dim).distinct()
    tables = fitted(*exact_sample(asked, index, k), dim)
    parts = max(1, rows // PART_ROWS)
    shared = vectors.sparkSession.sparkContext.broadcast(tables)  # fixed size

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes = shared.value.codes(shared.value.cells(unit(matrix(batch.column(1))))[0])
            take = pa.array(np.repeat(np.arange(n), TABLES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(TABLES), n)), pa.array(_part(codes.ravel(), parts)), pa.array(codes.ravel()),
                 batch.column(0).take(take), batch.column(1).take(take)], ["tab", "part", "code", "vec_id", "embedding"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, place = shared.value.cells(unit(matrix(batch.column(1))))
            who, tab, part, codes = [], [], [], []
            for i in range(batch.num_rows):
                for t in range(TABLES):
                    own = shared.value.probes(cell[i, t], place[i, t])
                    of = _part(own, parts)
                    for p in np.unique(of):
                        who.append(i), tab.append(t), part.append(p), codes.append(own[of == p])
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tab, pa.int64()), pa.array(part, pa.int64()), pa.array(codes, pa.list_(pa.int64())),
                 batch.column(0).take(take), batch.column(1).take(take)], ["tab", "part", "codes", "query_id", "embedding"])

    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    entries = written(index.mapInArrow(
        hashed, f"tab long, part long, code long, vec_id {id_kind}, embedding {kind}"), "entries")
    sizes = entries.groupBy("tab", "part").agg(F.ceil(F.count(F.lit(1)) / (2 * PART_ROWS)).cast("long").alias("cuts"))
    # the count is given, so that adaptive execution does not put all probing into one task
    probes = asked.repartition(-(-max(1, asked.count()) // PROBING_QUERIES), F.col("vec_id")).mapInArrow(
        probed, f"tab long, part long, codes array<long>, query_id {id_kind}, embedding {kind}")
    left = entries.join(sizes, ["tab", "part"]).withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")))
    right = probes.join(sizes, ["tab", "part"]).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))

    def rerank(held: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if held.num_rows and asking.num_rows:
            held = held.combine_chunks()
            codes = held.column("code").to_numpy()
            order = np.argsort(codes, kind="stable")
            codes, ids = codes[order], held.column("vec_id").to_numpy()[order]
            rows = matrix(held.column("embedding").combine_chunks())[order]
            norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
            asking = asking.combine_chunks()
            who, wanted = asking.column("query_id").to_numpy(), matrix(asking.column("embedding").combine_chunks())
            for q, query, own in zip(who, wanted, asking.column("codes"), strict=True):
                visit = own.values.to_numpy()
                start, end = np.searchsorted(codes, visit), np.searchsorted(codes, visit, "right")
                n = end - start
                at = np.repeat(start - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                at = at[ids[at] != q]
                scores = _cosines(query, rows[at], norms[at])
                best = _best(ids[at], scores, k)
                out[0] += [q] * len(best)
                out[1] += ids[at][best].tolist()
                out[2] += scores[best].tolist()
        return pa.table({"query_id": pa.array(out[0], asking.column("query_id").type),
                         "vec_id": pa.array(out[1], asking.column("query_id").type), "score": pa.array(out[2], pa.float64())})

    keys = ["tab", "part", "cut"]
    found = left.select(*keys, "code", "vec_id", "embedding").groupBy(*keys).cogroup(
        right.select(*keys, "codes", "query_id", "embedding").groupBy(*keys)).applyInArrow(
        rerank, f"query_id {id_kind}, vec_id {id_kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # tables give the same score to the same pair; ids are compared within a query
    ranked = written(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
    full = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = written(asked.join(full, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        exact = _compared_with_all(short, index, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(exact)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _compared_with_all(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each query the k best rows of every block of the index, by exact cosine."""
    def blocks(rows: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-rows.count() // BLOCK_ROWS))
        return written(rows.groupBy(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).alias("b")).agg(
            F.collect_list("vec_id").alias(f"{name}_ids"), F.collect_list("embedding").alias(f"{name}_rows")).drop("b"), name)

    id_type = queries.schema["vec_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                who, ids = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in (0, 2))
                wanted, rows = (matrix(batch.column(c)[at].values) for c in (1, 3))
                norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
                out: list[list] = [[], [], []]
                for q, query in zip(who, wanted, strict=True):
                    scores = _cosines(query, rows, norms)
                    order = np.lexsort((ids, -scores))
                    order = order[ids[order] != q]
                    # an id with several vectors counts once, with its best
                    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
                    out[0] += [q] * len(order)
                    out[1] += ids[order].tolist()
                    out[2] += scores[order].tolist()
                kind = batch.column(0).type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], kind), pa.array(out[1], kind), pa.array(out[2], pa.float64())],
                    ["query_id", "vec_id", "score"])

    pairs = blocks(queries, "asking").crossJoin(blocks(index, "held"))
    return pairs.mapInArrow(work, f"query_id {id_type}, vec_id {id_type}, score double").groupBy("query_id", "vec_id").agg(
        F.max("score").alias("score"))


def _part(codes: np.ndarray, parts: int) -> np.ndarray:
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def recall(found: pd.DataFrame, true: pd.DataFrame) -> float:
    """Share of the true (query_id, vec_id) pairs among those found."""
    return len(found.merge(true, on=["query_id", "vec_id"])) / max(1, len(true))
