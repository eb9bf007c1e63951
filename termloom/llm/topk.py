"""Exact top-k by inner product, with norm-sorted vectors and rotated partial sums.

Vectors are stored once in descending order of length. Queries come in blocks of
bounded size, each broadcast to one pass over that order. A block's right
singular vectors rotate both sides, so that most of every product lies in the
first ``lead`` coordinates. A task walks its vectors by descending length and
keeps a threshold per query, which starts at the k-th score among the longest
vectors of all. A query whose length times the block's greatest length is below
its threshold takes no part (Cauchy-Schwarz on whole vectors); of the others,
only pairs whose leading partial sum plus the product of the two residual lengths
reaches the threshold are multiplied out. Bounds are widened by a rounding
margin and scores are exact integers, so nothing that belongs to a result can be
pruned, ties included.

Defined results: a component ``x`` counts as ``floor(scale * x)``. Vectors that
are null, empty, or hold null or non-finite components take no part, nor do rows
without an id. Rows that repeat an id all count: each is a candidate of the other
ids, and queries of one id share one result. Vectors meet only vectors of their own dimension. Scores outside the range of a
long are cut to it. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import ship_code, stored

SCALE = 256
K = 5
LEAD = 16
# Bytes of one block of queries, and of the longest vectors that set the first thresholds.
BLOCK_BYTES = 8 << 20
SEED_ROWS = 1024
STEP = 512
# Sums below this are exact in doubles.
EXACT = float(2**52)
LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)
HITS = "query_id long, vec_id long, score long"


def whole(x: Column, scale: int) -> Column:
    """``floor(scale * x)`` as a double, also beyond the range of a long."""
    scaled = x * F.lit(float(scale))
    return F.when(F.abs(scaled) < F.lit(EXACT), F.floor(scaled).cast("double")).otherwise(scaled)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def vectors(table: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v, norm`` of the rows that take part, stored by descending length."""
    raw = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    good = raw.filter(F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", finite))
    scaled = good.select("vec_id", F.transform("e", lambda x: whole(x, scale)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    order = [F.desc("norm"), F.asc("vec_id")]
    rows = scaled.select("vec_id", "v", norm.alias("norm"))
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order), "vectors")


class Queries:
    """The queries of one block that have the same dimension, rotated, with thresholds."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int, lead: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.norm = np.sqrt((matrix * matrix).sum(axis=1))
        gram = matrix.T @ matrix
        basis = np.linalg.eigh(gram)[1][:, ::-1] if np.isfinite(gram).all() else np.eye(matrix.shape[1])
        self.basis = np.ascontiguousarray(basis[:, :lead])
        self.lead = matrix @ self.basis
        self.rest = self.residual(self.lead, self.norm)
        self.floor = np.full(len(ids), -np.inf)
        if len(seeds) > k:
            for i in range(0, len(ids), STEP):
                scores = matrix[i:i + STEP] @ seeds.T
                scores[ids[i:i + STEP, None] == seed_ids[None, :]] = -np.inf
                best = np.clip(np.partition(scores, -k, axis=1)[:, -k], LONG_MIN, LONG_MAX)
                # Two units lower: far above 2**52 a product here is rounded.
                self.floor[i:i + STEP] = best - np.abs(best) * 1e-9 - 1

    @staticmethod
    def residual(lead: np.ndarray, norm: np.ndarray) -> np.ndarray:
        square = norm * norm
        return np.sqrt(np.maximum(square - (lead * lead).sum(axis=1), 0) + 1e-9 * square)


def exact(left: np.ndarray, right: np.ndarray, bound: float) -> np.ndarray:
    """Row-wise inner products of whole numbers, cut to the range of a long."""
    if bound < EXACT:
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(left, right, strict=True)]
    return np.array([min(max(s, LONG_MIN), LONG_MAX) for s in sums], dtype=np.int64)


class Walk:
    """One task's best pairs for one set of queries."""

    def __init__(self, queries: Queries):
        self.q = queries
        self.floor = queries.floor.copy()
        self.hits = np.empty((0, 3), dtype=np.int64)

    def step(self, ids: np.ndarray, matrix: np.ndarray, norm: np.ndarray) -> None:
        q, longest = self.q, norm.max()
        margin = q.norm * longest * 1e-9 + 1
        alive = np.flatnonzero(~(q.norm * longest < self.floor - margin))
        if not len(alive):
            return
        lead = matrix @ q.basis
        bound = q.lead[alive] @ lead.T + np.outer(q.rest[alive], q.residual(lead, norm))
        bound = np.maximum(bound, LONG_MIN)
        keep = ~(bound < (self.floor - margin)[alive, None]) & (q.ids[alive, None] != ids[None, :])
        rows, columns = np.nonzero(keep)
        found = []
        for i in range(0, len(rows), 1 << 14):
            a, b = alive[rows[i:i + (1 << 14)]], columns[i:i + (1 << 14)]
            scores = exact(q.matrix[a], matrix[b], q.norm[alive].max() * longest)
            good = ~(scores < self.floor[a])
            found.append(np.column_stack([a[good], ids[b[good]], scores[good]]))
        if found:
            self.keep_best(np.concatenate([self.hits, *found]))

    def keep_best(self, hits: np.ndarray) -> None:
        # Scores in descending order without negating the smallest long.
        hits = hits[np.lexsort((hits[:, 1], ~hits[:, 2], hits[:, 0]))]
        first = np.flatnonzero(np.r_[True, hits[1:, 0] != hits[:-1, 0]]) if len(hits) else np.empty(0, int)
        place = np.arange(len(hits)) - np.repeat(first, np.diff(np.r_[first, len(hits)]))
        self.hits = hits[place < self.q.k]
        full = hits[place == self.q.k - 1]
        last = full[:, 2].astype(float)
        self.floor[full[:, 0]] = np.maximum(self.floor[full[:, 0]], last - np.abs(last) * 1e-15)


def by_dimension(ids: np.ndarray, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, matrix)`` for each length of the lists."""
    sizes = np.diff(lists.offsets.to_numpy())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def walk(block, steps: int = STEP):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = {size: Walk(queries) for size, queries in block.value.items()}
        for batch in batches:
            ids, norms = batch.column("vec_id").to_numpy(), batch.column("norm").to_numpy()
            for at, matrix in by_dimension(ids, batch.column("v")):
                if matrix.shape[1] in walks:
                    for i in range(0, len(at), steps):
                        part = at[i:i + steps]
                        walks[matrix.shape[1]].step(ids[part], matrix[i:i + steps], norms[part])
        for one in walks.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.q.ids[one.hits[:, 0]]), pa.array(one.hits[:, 1]), pa.array(one.hits[:, 2])],
                ["query_id", "vec_id", "score"],
            )

    return run


def _matrix(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a bounded selection, by dimension."""
    taken = rows.select("vec_id", "v").toArrow().combine_chunks()
    if not taken.num_rows:
        return {}
    ids, lists = taken.column("vec_id").to_numpy(), taken.column("v").combine_chunks()
    return {m.shape[1]: (ids[at], m) for at, m in by_dimension(ids, lists)}


def search(
    table: DataFrame, every: int = 50, k: int = K, scale: int = SCALE, lead: int = LEAD, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of all other vectors for each query.

    Queries are the vectors whose id is divisible by ``every``.
    """
    spark = table.sparkSession
    ship_code(spark)
    index = vectors(table, scale)
    wanted = index.filter(F.col("vec_id") % every == 0)
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = -(-size["n"] * (size["d"] or 0) * 8 // block_bytes)
    seeds = _matrix(index.orderBy(F.desc("norm"), "vec_id").limit(SEED_ROWS)) if blocks else {}
    passes = [spark.createDataFrame([], HITS)]
    for number in range(blocks):
        mine = _matrix(wanted.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number))
        none = np.empty(0, np.int64)
        block = spark.sparkContext.broadcast({
            d: Queries(ids, m, *seeds.get(d, (none, np.empty((0, d)))), k, min(lead, d)) for d, (ids, m) in mine.items()
        })
        passes.append(index.mapInArrow(walk(block), HITS))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = reduce(DataFrame.unionByName, passes)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
