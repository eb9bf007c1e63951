"""From matches to answers: top k, JSON results, status, combined matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.functions.scoring import SCORE_DIGITS

# How many hits a search returns, and the empty answer.
RESULT_LIMIT = 10
NO_RESULTS = "No results found."

_SPREAD = 64
_PRUNED_LIMIT = 1000


def top_k(matches: DataFrame, k: int = RESULT_LIMIT) -> DataFrame:
    """``(qid, rank, path, score)``: the ``k`` best matches of each query.

    Scores are rounded before they are compared and ties go by path, so the
    order does not depend on how partial sums were combined. Every task keeps
    at most ``k`` rows per query before rows are brought together.
    """
    scored = matches.select("qid", "path", F.round("score", SCORE_DIGITS).alias("score"))
    best = [F.col("score").desc(), F.col("path")]
    if k > _PRUNED_LIMIT:
        # Too many for the planner's own per-task pruning: prune by salt.
        salted = scored.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(_SPREAD)))
        near = F.row_number().over(W.partitionBy("qid", "_salt").orderBy(*best))
        scored = salted.withColumn("_n", near).filter(F.col("_n") <= k).drop("_n", "_salt")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(*best))
    ranked = scored.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("qid", "rank", "path", "score")


def hits_as_json(hits: DataFrame) -> DataFrame:
    """``(qid, result)``: ranked hits as one JSON list of stored fields."""
    document = F.to_json(F.struct(F.array("path").alias("file_path")))
    listed = hits.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", document.alias("doc")))).alias("docs")
    )
    joined = F.array_join(F.col("docs.doc"), ", ")
    return listed.select("qid", F.concat(F.lit("["), joined, F.lit("]")).alias("result"))


def with_status(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``(qid, keyword, result, status)`` for every query, found or not."""
    answers = hits_as_json(hits)
    return queries.join(answers, "qid", "left").select(
        "qid", "keyword", "result",
        F.when(F.col("result").isNull(), NO_RESULTS).otherwise("ok").alias("status"),
    )


def combine(
    must: list[DataFrame] = (), should: list[DataFrame] = (), must_not: list[DataFrame] = ()
) -> DataFrame:
    """Boolean combination of whole match tables, for nested groups.

    Scores of matching groups add up. Without ``must`` groups at least one
    ``should`` group has to match.
    """
    if not must and not should:
        raise ValueError("a query needs at least one group that is not must_not")
    tagged = [
        m.select("qid", "path", "score", F.lit(occur).alias("_occur"))
        for occur, group in (("must", must), ("should", should), ("must_not", must_not))
        for m in group
    ]
    excluded = F.col("_occur") == "must_not"
    return (
        reduce(DataFrame.unionByName, tagged).groupBy("qid", "path").agg(
            F.sum(F.when(~excluded, F.col("score"))).alias("score"),
            F.count(F.when(F.col("_occur") == "must", 1)).alias("_must"),
            F.count(F.when(excluded, 1)).alias("_excluded"),
        )
        .filter((F.col("_excluded") == 0) & (F.col("_must") == len(must)))
        .select("qid", "path", "score")
    )
