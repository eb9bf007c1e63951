"""Search: from query rows to ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.scoring import SCORE_DIGITS
from termloom.operators.clauses import Clause, clause_table, keyword_clauses
from termloom.operators.matching import match
from termloom.operators.nested import Group, nested_matches
from termloom.operators.ranking import RESULT_LIMIT, top_k


def matches(index, clauses: DataFrame | list[Clause]) -> DataFrame:
    """All matches ``(qid, path, score)`` of a clause table or list."""
    if isinstance(clauses, list):
        clauses = clause_table(index.spark, clauses)
    return match(index, clauses)


def search(index, clauses: DataFrame | list[Clause], k: int = RESULT_LIMIT) -> DataFrame:
    """The ``k`` best hits ``(qid, rank, path, score)`` of each query.

    Queries that match everything give every document one score, so the first
    ``k`` paths are found once for all of them.
    """
    if isinstance(clauses, list):
        clauses = clause_table(index.spark, clauses)
    everything = F.col("kind") == "match_all"
    if clauses.filter(everything).isEmpty():
        return top_k(match(index, clauses, k), k)
    whole = clauses.groupBy("qid").agg(
        F.every(everything & (F.col("occur") != "must_not")).alias("_whole"),
        F.round(F.sum(F.coalesce("boost", F.lit(1.0))), SCORE_DIGITS).alias("score"),
    ).filter("_whole")
    first = index.docs.select("path").orderBy("path").limit(k).agg(F.array_sort(F.collect_list("path")))
    listed = whole.select("qid", F.posexplode(first.scalar()).alias("_n", "path"), "score").select(
        "qid", (F.col("_n") + 1).alias("rank"), "path", "score"
    )
    rest = clauses.join(whole.select("qid"), "qid", "left_anti").select(*clauses.columns)
    return top_k(match(index, rest, k), k).unionByName(listed)


def search_nested(
    index, groups: DataFrame | list[Group], clauses: DataFrame | list[tuple[int, Clause]], k: int = RESULT_LIMIT
) -> DataFrame:
    """The ``k`` best hits of each nested query, given as a group tree and its clauses."""
    return top_k(nested_matches(index, groups, clauses), k)


def search_keywords(index, queries: DataFrame, k: int = RESULT_LIMIT) -> DataFrame:
    """The ``k`` best hits of each ``(qid, keyword)``; any word may match."""
    return search(index, keyword_clauses(queries), k)
