"""Nested queries as data: a tree of groups above a clause table."""

from __future__ import annotations

from dataclasses import astuple, dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.clauses import OCCURS, Clause, analysed
from termloom.operators.joins import fits_broadcast
from termloom.operators.matching import match
from termloom.session import shared_dir

CLAUSE_COLUMNS = ["kind", "terms", "slop", "boost", "bounds"]


@dataclass(frozen=True)
class Group:
    """A group of clauses and groups; the one without a parent is the query itself."""

    qid: int
    group_id: int
    parent_id: int | None = None
    occur: str = "should"

    def __post_init__(self):
        if self.occur not in OCCURS:
            raise ValueError(f"occur must be one of {OCCURS}: {self.occur}")


def group_table(spark: SparkSession, groups: list[Group]) -> DataFrame:
    """Groups as ``(qid, group_id, parent_id, occur)`` rows."""
    schema = pa.schema([("qid", pa.int64()), ("group_id", pa.int64()), ("parent_id", pa.int64()), ("occur", pa.string())])
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, astuple(g))) for g in groups], schema=schema))


def member_table(spark: SparkSession, members: list[tuple[int, Clause]]) -> DataFrame:
    """``(group_id, clause)`` pairs as clause rows with a ``group_id``."""
    schema = pa.schema([
        ("qid", pa.int64()), ("group_id", pa.int64()), ("clause_id", pa.int32()), ("occur", pa.string()), ("kind", pa.string()),
        ("terms", pa.list_(pa.string())), ("slop", pa.int32()), ("boost", pa.float64()), ("bounds", pa.string()),
    ])
    rows = [
        {"group_id": g, **{name: getattr(c, name) for name in schema.names if name != "group_id"}} for g, c in members
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def levels(groups: DataFrame) -> list[DataFrame]:
    """``groups`` with the same distance from the query itself, from the top down.

    Raises when a group has no way up to a group without a parent.
    """
    shared_dir(groups.sparkSession)
    rows = groups.select("qid", "group_id", "parent_id", "occur").checkpoint()
    found, above, left = [], rows.filter("parent_id is null"), rows.count()
    while True:
        above = above.checkpoint()
        size = above.count()
        if not size:
            break
        found.append(above)
        left -= size
        up = above.select("qid", F.col("group_id").alias("parent_id"))
        above = rows.join(up, ["qid", "parent_id"]).select(*rows.columns)
    if left:
        raise ValueError("a group is listed twice or has no way up to its query")
    return found


def _evaluated(hits: DataFrame, needed: DataFrame, small: bool) -> DataFrame:
    """``(qid, group_id, path, score)`` of the groups that match, from the hits of their members."""
    excluded = F.col("occur") == "must_not"
    counted = hits.groupBy("qid", "group_id", "path").agg(
        F.sum(F.when(~excluded, F.col("score"))).alias("score"),
        F.count(F.when(F.col("occur") == "must", 1)).alias("_must"),
        F.count(F.when(F.col("occur") == "should", 1)).alias("_should"),
        F.count(F.when(excluded, 1)).alias("_excluded"),
    ).filter("_excluded = 0 and _must + _should > 0")
    rule = F.broadcast(needed) if small else needed
    enough = F.col("_must") == F.coalesce("n_must", F.lit(0))
    return counted.join(rule, ["qid", "group_id"], "left").filter(enough).select("qid", "group_id", "path", "score")


def nested_matches(index, groups: DataFrame | list[Group], clauses: DataFrame | list[tuple[int, Clause]]) -> DataFrame:
    """All matches ``(qid, path, score)`` of nested queries, one or a million.

    All clauses of all queries go through one matching pass, each as a query of
    its own. The tree is then evaluated from the leaves up with one aggregation a
    level: a group matches a document when all its ``must`` members do, no
    ``must_not`` member does, and at least one that is not excluded does; its score
    is the sum of its matching members. A group of exclusions matches nothing, so
    does a clause whose group is not listed.
    """
    spark = index.spark
    shared_dir(spark)
    if isinstance(groups, list):
        groups = group_table(spark, groups)
    if isinstance(clauses, list):
        clauses = member_table(spark, clauses)
    tree = levels(groups)
    # A clause is known by one number, which the matching pass takes for a query.
    leaves = clauses.withColumn("node", F.monotonically_increasing_id()).checkpoint()
    asked = leaves.select(
        F.col("node").alias("qid"), F.lit(0).alias("clause_id"), F.lit("should").alias("occur"), *CLAUSE_COLUMNS
    )
    # Clauses without a token are left out, as in plain queries.
    kept = analysed(asked).select(F.col("qid").alias("node"))
    members = leaves.select("node", "qid", "group_id", "occur").join(kept, "node", "left_semi").checkpoint()
    small = fits_broadcast(members.withColumn("path", F.lit("")), "path")
    found = match(index, asked).withColumnRenamed("qid", "node")
    hits = found.join(F.broadcast(members) if small else members, "node").select("qid", "group_id", "occur", "path", "score")
    kinds = [members.select("qid", "group_id", "occur"), *(
        level.filter("parent_id is not null").select("qid", F.col("parent_id").alias("group_id"), "occur") for level in tree[1:]
    )]
    needed = reduce(DataFrame.unionByName, kinds).filter("occur = 'must'").groupBy("qid", "group_id").agg(
        F.count(F.lit(1)).alias("n_must")
    ).checkpoint()
    below: DataFrame | None = None
    for level in reversed(tree):
        here = level.select("qid", "group_id")
        own = hits.join(F.broadcast(here) if small else here, ["qid", "group_id"], "left_semi")
        result = _evaluated(own if below is None else own.unionByName(below), needed, small)
        up = level.select("qid", "group_id", "parent_id", "occur")
        below = result.join(F.broadcast(up) if small else up, ["qid", "group_id"]).select(
            "qid", F.col("parent_id").alias("group_id"), "occur", "path", "score"
        )
    if below is None:
        return found.select(F.col("node").alias("qid"), "path", "score").limit(0)
    # The level of the queries themselves.
    return below.groupBy("qid", "path").agg(F.sum("score").alias("score"))
