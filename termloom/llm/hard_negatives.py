"""Hard negatives by coordinate pruning in length buckets (after LEMP).

Vectors are dealt to blocks of bounded size. A block's vectors of one dimension
are cut into buckets of similar length; a bucket keeps its unit vectors and, for
every coordinate, the order of their values. An anchor that needs an inner
product of at least ``theta`` needs a cosine of at least ``theta / (its length *
the bucket's greatest length)``; a bucket where that is above one is skipped.
Otherwise every unit vector that reaches the cosine has its value of coordinate
``f`` inside ``cos(a + b) .. cos(a - b)``, ``a`` and ``b`` being the angles of the
anchor's own value and of the wanted cosine. These ranges are cut out of the
sorted lists of the anchor's ``focus`` largest coordinates, and what lies in all
of them is verified with exact whole-number products. Ranges are widened by a
rounding margin, so nothing that belongs to a result can be lost.

Two passes over the blocks: the best rows of the anchor's own label are its
positives (the bound is the k-th best so far), and for each positive the best
rows of other labels inside the score band follow (the bound is the band's lower
end, then the k-th best so far). Anchors are a table that every block's task
reads row by row after its own vectors; neither passes through the driver.

Defined results: rows with a null id, label or vector, an empty vector, or null
or non-finite components take no part. Rows that repeat an id are rows of their
own; rows with the anchor's id are never its positives or negatives. Vectors
meet only vectors of their own dimension. Scores outside the range of a long are
cut to it. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import ship_code, stored
from termloom.llm.topk import by_dimension, exact, finite, whole

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# Negative scores in percent of the positive's.
LOW, HIGH = 30, 90
FOCUS = 5
BUCKET_ROWS = 2048
# Vectors of one block; a task holds one block at a time.
BLOCK_BYTES = 32 << 20
MARGIN = 1e-9
# Whole numbers below this stay exact in a long when multiplied by a percentage.
SMALL = 2**55
FOUND = "anchor long, other_id long, score long, wanted long"


class Bucket:
    """Vectors of similar length, with the order of their unit vectors in each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, norm: np.ndarray):
        self.ids, self.labels, self.matrix, self.longest = ids, labels, matrix, norm.max()
        self.unit = matrix / np.where(norm > 0, norm, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)
        # A vector of length zero has no direction: its product is zero.
        self.zero = np.flatnonzero(norm == 0)

    def candidates(self, unit: np.ndarray, focus: np.ndarray, length: float, theta: float) -> np.ndarray:
        """Rows whose product with an anchor of that direction and length may reach ``theta``."""
        if theta <= 0 or not np.isfinite(self.longest * length):
            return np.arange(len(self.ids))
        wanted = theta / (length * self.longest) * (1 - MARGIN) - MARGIN if length * self.longest else np.inf
        if wanted > 1:
            return np.empty(0, dtype=np.int64)
        own, apart = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(np.clip(wanted, -1, 1))
        low = np.cos(np.minimum(own + apart, np.pi)) - MARGIN
        high = np.cos(np.maximum(own - apart, 0)) + MARGIN
        cuts = [np.searchsorted(self.sorted[:, f], (a, b)) for f, a, b in zip(focus, low, high, strict=True)]
        first = int(np.argmin([b - a for a, b in cuts]))
        rows = self.order[cuts[first][0]:cuts[first][1], focus[first]]
        for i, f in enumerate(focus):
            if i != first and len(rows):
                value = self.unit[rows, f]
                rows = rows[(value >= low[i]) & (value <= high[i])]
        return rows


def buckets(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, rows: int = BUCKET_ROWS) -> list[Bucket]:
    """Buckets by descending length."""
    norm = np.sqrt((matrix * matrix).sum(axis=1))
    order = np.lexsort((ids, -norm))
    cuts = [order[i:i + rows] for i in range(0, len(order), rows)]
    return [Bucket(ids[c], labels[c], matrix[c], norm[c]) for c in cuts]


class Anchor:
    def __init__(self, vec_id: int, vector: np.ndarray, focus: int):
        self.vec_id, self.vector = vec_id, vector
        self.length = float(np.sqrt((vector * vector).sum()))
        self.unit = vector / self.length if self.length else vector
        self.focus = np.argsort(-np.abs(self.unit), kind="stable")[:focus]

    def scores(self, bucket: Bucket, rows: np.ndarray) -> np.ndarray:
        repeated = np.broadcast_to(self.vector, (len(rows), len(self.vector)))
        return exact(repeated, bucket.matrix[rows], self.length * bucket.longest)


class Best:
    """The ``k`` first of what was offered: higher scores, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(scores) > 4 * self.k:
            # Scores in descending order without negating the smallest long; ties of the last place stay.
            least = ~np.partition(~scores, self.k - 1)[self.k - 1]
            scores, ids = scores[scores >= least], ids[scores >= least]
        order = np.lexsort((ids, ~scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]

    def bound(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf


def in_band(scores: np.ndarray, positive: int, low: int, high: int) -> np.ndarray:
    """``low * positive <= 100 * score <= high * positive``, exactly."""
    if abs(positive) >= SMALL or (len(scores) and max(abs(int(scores.max())), abs(int(scores.min()))) >= SMALL):
        scores = scores.astype(object)
    return ((low * positive <= 100 * scores) & (100 * scores <= high * positive)).astype(bool)


class Block:
    """The vectors of one block."""

    def __init__(self, focus: int, rows: int):
        self.focus, self.rows = focus, rows
        self.parts: list[pa.RecordBatch] = []
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None
        self.all: dict[int, list[Bucket]] = {}
        self.own: dict[tuple[int, int], list[Bucket]] = {}

    def close(self) -> None:
        """No more vectors follow."""
        self.by_size = {}
        if self.parts:
            table = pa.Table.from_batches(self.parts).combine_chunks()
            ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
            for at, matrix in by_dimension(ids, table.column("v").combine_chunks()):
                self.by_size[matrix.shape[1]] = (ids[at], labels[at], matrix)
        self.parts = []

    def of_label(self, size: int, label: int) -> list[Bucket]:
        if (size, label) not in self.own:
            ids, labels, matrix = self.by_size[size]
            here = labels == label
            self.own[size, label] = buckets(ids[here], labels[here], matrix[here], self.rows)
        return self.own[size, label]

    def of_size(self, size: int) -> list[Bucket]:
        if size not in self.all:
            self.all[size] = buckets(*self.by_size[size], self.rows)
        return self.all[size]

    def positives(self, row: dict, k: int) -> list[tuple[int, int, int]]:
        size, best = len(row["v"]), Best(k)
        if size not in self.by_size:
            return []
        anchor = Anchor(row["vec_id"], row["v"], self.focus)
        for bucket in self.of_label(size, row["label"]):
            rows = bucket.candidates(anchor.unit, anchor.focus, anchor.length, best.bound())
            rows = rows[bucket.ids[rows] != anchor.vec_id]
            best.offer(anchor.scores(bucket, rows), bucket.ids[rows])
        return [(i, s, 0) for i, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)]

    def negatives(self, row: dict, k: int, low: int, high: int) -> list[tuple[int, int, int]]:
        size = len(row["v"])
        if size not in self.by_size:
            return []
        anchor = Anchor(row["vec_id"], row["v"], self.focus)
        best = [Best(k) for _ in row["positives"]]
        for bucket in self.of_size(size):
            # A negative positive score has an empty band.
            bounds = [max(b.bound(), low * p / 100) for b, p in zip(best, row["positives"], strict=True) if p >= 0]
            if not bounds:
                break
            rows = bucket.candidates(anchor.unit, anchor.focus, anchor.length, min(bounds))
            rows = rows[(bucket.labels[rows] != row["label"]) & (bucket.ids[rows] != anchor.vec_id)]
            scores, ids = anchor.scores(bucket, rows), bucket.ids[rows]
            for one, positive in zip(best, row["positives"], strict=True):
                inside = in_band(scores, positive, low, high)
                one.offer(scores[inside], ids[inside])
        return [(i, s, n) for n, b in enumerate(best) for i, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]


def _searcher(find: str, focus: int, rows: int, *options: int):
    """Reads blocks in order: the vectors of a block, then the anchors that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            numbers = batch.column("block").to_numpy()
            for start in np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else []:
                if numbers[start] != number:
                    number, block = numbers[start], Block(focus, rows)
                mine = batch.slice(start, int((numbers[start:] == number).sum()))
                role = mine.column("anchor").is_null().to_numpy(zero_copy_only=False)
                if role.any():
                    block.parts.append(mine.filter(pa.array(role)))
                if role.all():
                    continue
                if block.by_size is None:
                    block.close()
                anchors = mine.filter(pa.array(~role))
                vectors = anchors.column("v")
                ends = vectors.offsets.to_numpy()
                flat = vectors.values.to_numpy(zero_copy_only=False)
                for i, row in enumerate(anchors.select(["anchor", "vec_id", "label", "positives"]).to_pylist()):
                    row["v"] = flat[ends[i]:ends[i + 1]]
                    found += [(row["anchor"], *hit) for hit in getattr(block, find)(row, *options)]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["anchor", "other_id", "score", "wanted"]
            )

    return run


def usable(table: DataFrame, scale: int, label: Column) -> DataFrame:
    """``row, vec_id, label, v`` of the rows that take part, stored."""
    raw = table.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("e"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & F.forall("e", finite))
    rows = raw.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("e", lambda x: whole(x, scale)).alias("v")
    )
    return stored(rows, "vectors")


def meet(vectors: DataFrame, anchors: DataFrame, blocks: int, run) -> DataFrame:
    """Every block's vectors, then all anchors, through ``run``."""
    none = [F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("array<long>").alias("positives")]
    held = vectors.select(
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "label", "v", *none
    )
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "label", "v",
        F.col("row").alias("anchor"), "positives",
    )
    # Null anchors, which are the vectors, come first.
    dealt = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "anchor")
    return dealt.mapInArrow(run, FOUND)


def changed_label(every: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one where the id is divisible by ``every``."""
    moved = (F.col("label") + 1) % labels
    return F.when(F.col("vec_id") % every == 0, moved).otherwise(F.col("label"))


def mine(
    table: DataFrame, label: Column | None = None, every: int = 100, positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, focus: int = FOCUS,
    bucket_rows: int = BUCKET_ROWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``; positives the first
    rows of the same label; negatives the first rows of other labels whose score
    is between ``low`` and ``high`` percent of the positive's.
    """
    spark = table.sparkSession
    ship_code(spark)
    vectors = usable(table, scale, F.col("label") if label is None else label)
    size = vectors.agg(F.sum(F.size("v")).alias("numbers")).first()["numbers"] or 0
    # No fewer blocks than cores, unless the blocks would be tiny.
    blocks = max(-(-size * 8 // block_bytes), min(spark.sparkContext.defaultParallelism, -(-size * 8 // (1 << 20))), 1)
    anchors = vectors.filter(F.col("vec_id") % every == 0)
    no_positives = F.lit(None).cast("array<long>").alias("positives")
    found = meet(
        vectors, anchors.select("*", no_positives), blocks, _searcher("positives", focus, bucket_rows, positives)
    )
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "other_id")
    ranked = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives)
    chosen = stored(
        ranked.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "other_id", "score"))).alias("chosen"))
        .join(anchors.withColumnRenamed("row", "anchor"), "anchor"), "positives",
    )
    asked = chosen.select(F.col("anchor").alias("row"), "vec_id", "label", "v", F.col("chosen.score").alias("positives"))
    hits = meet(vectors, asked, blocks, _searcher("negatives", focus, bucket_rows, negatives, low, high))
    order = Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "other_id")
    kept = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = chosen.select("anchor", F.col("vec_id").alias("anchor_id"), "chosen")
    pair = F.col("chosen")[F.col("wanted").cast("int")]
    return kept.join(named, "anchor").select(
        "anchor_id", pair["other_id"].alias("positive_id"), "rank", F.col("other_id").alias("negative_id"),
        pair["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
