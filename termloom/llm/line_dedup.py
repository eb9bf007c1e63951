"""Line deduplication in DataFrame functions only.

Every line is exploded with its position and reduced to a 128-bit hash of its
key. A first count on 64 bits leaves the few hashes that are repeated at all;
only their occurrences are counted exactly, by distinct documents, and only the
positions of lines to drop travel back to the texts, which are then reassembled
by position. All counts are pre-aggregated in the map stage, so a line found in
a third of the documents costs one row per task.

Defined results: a null or empty text is one empty line. Documents without an
id are told apart by their text, count like others and are never the largest,
so they lose a repeated line unless no document that holds it has an id. Rows
that share an id are one document for the count; each is cut on its own. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import sized, stored, text_of

MIN_CHARS = 20
MIN_DOCUMENTS = 3
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    stripped = F.btrim(line, F.lit(SPACE))
    # ``lower`` changes the same letters where all are ASCII, and is much faster.
    ascii_only = F.octet_length(stripped) == F.length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(
        F.translate(stripped, string.ascii_uppercase, string.ascii_lowercase)
    )


def _rows(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.xxhash64("text", F.lit(2))).alias("row_1"),
        F.xxhash64("text").alias("row_2"),
    )


def occurrences(rows: DataFrame, min_chars: int) -> DataFrame:
    """One row per line of at least ``min_chars``: where it stands, and its hash."""
    lines = rows.select("doc_id", "row_1", "row_2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "row_1", "row_2", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= min_chars).select(
        "doc_id", "row_1", "row_2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2")
    )


def lines_to_drop(rows: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """Positions to drop, one row per document that loses any."""
    lines = occurrences(rows, min_chars)
    repeated = stored(
        lines.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents).select("h1"),
        "repeated-lines",
    )
    found = stored(lines.join(sized(repeated, 8), "h1", "left_semi"), "line-places")
    frequent = stored(
        found.groupBy("h1", "h2").agg(
            F.count_distinct("row_1", F.col("doc_id").isNull()).alias("n"), F.max("doc_id").alias("last_id")
        ).filter(F.col("n") >= min_documents).select("h1", "h2", "last_id"),
        "frequent-lines",
    )
    lost = found.join(sized(frequent, 24), ["h1", "h2"]).filter(
        F.col("last_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last_id")))
    )
    return stored(lost.groupBy("row_1", "row_2").agg(F.collect_set("pos").alias("gone")), "lines-to-drop")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id``, ``n_lines`` before, ``n_dropped``, and the ``kept`` text of every row."""
    rows = _rows(docs)
    gone = lines_to_drop(rows, min_chars, min_documents)
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("p")).first()
    if size["n"]:
        gone = sized(gone, 32 + 4 * size["p"] // size["n"])
    # Split below the join, so that the array is made once per row.
    split = rows.select("doc_id", "row_1", "row_2", F.split("text", "\n", -1).alias("lines"))
    joined = split.join(gone, ["row_1", "row_2"], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(places, lambda i: F.element_at("lines", i + 1))
    )
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"),
    )
