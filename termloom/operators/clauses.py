"""Queries as tables of clauses, and the keyword text that becomes them."""

from __future__ import annotations

from dataclasses import astuple, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.analysis import tokens
from termloom.schemas import CLAUSES

OCCURS = ("must", "should", "must_not")
KINDS = ("term", "phrase", "phrase_prefix", "term_set", "term_range", "match_all", "path")


@dataclass(frozen=True)
class Clause:
    """One condition of a query.

    ``terms`` holds the words (``term``, ``phrase``, ``phrase_prefix``,
    ``term_set``), the lower and upper end (``term_range``; None is open) or
    the path (``path``). ``bounds`` tells which range ends are included.
    """

    qid: int
    clause_id: int
    occur: str = "should"
    kind: str = "term"
    terms: list[str | None] = field(default_factory=list)
    slop: int = 0
    boost: float = 1.0
    bounds: str = "[]"

    def __post_init__(self):
        if self.occur not in OCCURS:
            raise ValueError(f"occur must be one of {OCCURS}: {self.occur}")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}: {self.kind}")


def clause_table(spark: SparkSession, clauses: list[Clause]) -> DataFrame:
    """A clause list as a DataFrame."""
    rows = [dict(zip(CLAUSES.names, astuple(c))) for c in clauses]
    arrow = pa.schema([
        ("qid", pa.int64()), ("clause_id", pa.int32()), ("occur", pa.string()),
        ("kind", pa.string()), ("terms", pa.list_(pa.string())), ("slop", pa.int32()),
        ("boost", pa.float64()), ("bounds", pa.string()),
    ])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=arrow))


def keyword_clauses(queries: DataFrame) -> DataFrame:
    """Clauses for ``(qid, keyword)``: blank-separated words, any may match.

    A word the analysis splits into several tokens becomes a phrase.
    """
    chunks = F.filter(F.split("keyword", r"\s+"), lambda c: c != "")
    exploded = queries.select("qid", F.posexplode(chunks).alias("clause_id", "chunk"))
    return exploded.select(
        "qid", "clause_id", F.lit("should").alias("occur"), F.lit("phrase").alias("kind"),
        F.array("chunk").alias("terms"), F.lit(0).alias("slop"), F.lit(1.0).alias("boost"),
        F.lit("[]").alias("bounds"),
    )


def analysed(clauses: DataFrame) -> DataFrame:
    """Clauses with analysed words and the final ``kind``.

    Adds ``words`` (``array<struct<term, pos>>``). A phrase of one token is a
    term and a term of several tokens is a phrase; a prefix alone is
    ``prefix``. Clauses whose text holds no token are left out.
    """
    text_kinds = ["term", "phrase", "phrase_prefix", "term_set"]
    is_text = F.col("kind").isin(text_kinds)
    words = F.when(is_text, tokens(F.array_join("terms", " ")))
    n = F.size("words")
    kind = (
        F.when(F.col("kind").isin("term", "phrase"), F.when(n == 1, "term").otherwise("phrase"))
        .when((F.col("kind") == "phrase_prefix") & (n == 1), "prefix")
        .otherwise(F.col("kind"))
    )
    return (
        clauses.withColumn("words", words)
        .filter(~is_text | (n > 0))
        .withColumn("kind", kind)
        .withColumn("boost", F.coalesce("boost", F.lit(1.0)))
        .withColumn("slop", F.coalesce("slop", F.lit(0)))
    )
