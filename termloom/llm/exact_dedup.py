"""Exact deduplication with a heavy-hitter split.

Each row's text becomes a SHA-256 digest. Misra-Gries summaries, one per task
and then summed, name every digest that more than ``2 / (counters + 1)`` of the
rows carry; their exact counts are taken and the verified winners, at most
``counters`` rows, are broadcast, so that frequent copies are decided on the map
side and never meet in one task. All other digests go through one shuffle, in
groups that are bounded by that share.

Defined results: a null text is the empty text. A null ``doc_id`` is smaller
than every number. Of rows that repeat both id and text one is kept. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.common import ship_code, sized, stored, text_of, unused

COUNTERS = 1024
SUMMARY = "digest binary, seen long"


def digest() -> F.Column:
    return F.unhex(F.sha2(text_of().cast("binary"), 256))


def merged(counts: Counter, counters: int) -> Counter:
    """The mergeable form of Misra-Gries: subtract the first count that has no place."""
    if len(counts) <= counters:
        return counts
    surplus = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: n - surplus for k, n in counts.items() if n > surplus})


def summarise(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for entry in batch.column("digest").value_counts():
                counts[entry["values"].as_py()] += entry["counts"].as_py()
            counts = merged(counts, counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": list(counts), "seen": list(counts.values())},
            schema=pa.schema([("digest", pa.binary()), ("seen", pa.int64())]),
        )

    return run


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact size and keeper of the frequent digests; at most ``counters + 1`` rows."""
    ship_code(rows.sparkSession)
    top = (
        rows.select("digest").mapInArrow(summarise(counters), SUMMARY)
        .groupBy("digest").agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "digest").limit(counters + 1).collect()
    )
    schema = T.StructType([T.StructField("digest", T.BinaryType())])
    names = rows.sparkSession.createDataFrame([(bytes(r["digest"]),) for r in top], schema)
    verified = rows.join(F.broadcast(names), "digest").groupBy("digest").agg(*_group())
    return stored(verified.filter("group_size > 1"), "frequent")


def _group() -> list:
    return [
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("doc_id", "row_key")).alias("winner"),
    ]


def decide(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, digest``."""
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))
        .withColumn("row_key", F.monotonically_increasing_id()), "digests",
    )
    winners = frequent(rows, counters)
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    same = Window.partitionBy("digest")
    light = rest.select("digest", "doc_id", "row_key", *(c.over(same).alias(n) for c, n in zip(
        (F.count(F.lit(1)), F.max(F.struct("doc_id", "row_key"))), ("group_size", "winner"), strict=True)))
    return heavy.unionByName(light).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size",
        (F.col("row_key") == F.col("winner.row_key")).alias("kept"), "digest",
    )


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``decide`` keeps."""
    lost = stored(decide(docs, counters).filter("not kept"), "copies")
    again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    name, key, mark = unused(docs, 3)
    ids = [F.col("doc_id").alias(name), F.col("digest").alias(key)]
    marked = docs.withColumn(mark, digest())
    gone = F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.col(mark) == F.col(key))
    other = lost.filter(~again).select(*ids)
    kept = marked.join(sized(other, 48), gone, "left_anti")
    twice = lost.filter(again).select(*ids).distinct()
    if twice.isEmpty():
        return kept.drop(mark)
    twice = sized(stored(twice, "twice"), 48)
    once = kept.join(twice, gone, "left_semi").dropDuplicates(["doc_id", mark])
    return kept.join(twice, gone, "left_anti").unionByName(once).drop(mark)
