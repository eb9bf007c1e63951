"""Running numbers over a global order, without a single-task window.

Rows are range-partitioned into blocks of about equal size, numbered inside
their block, and shifted by what earlier blocks contribute. Only one row per
block (or per block edge) ever goes through a window of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.session import shared_dir


def ordered_blocks(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` with a ``block`` number; blocks follow the order of ``order``.

    The block numbers are written to the checkpoint folder because they must
    be the same in every later use of the rows.
    """
    spark = df.sparkSession
    shared_dir(spark)
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()).checkpoint()


def rank_in_group(
    df: DataFrame, group: list[str], order: list[str], name: str = "n", blocks: int | None = None
) -> DataFrame:
    """1-based rank by ``order`` inside each ``group``, however large it is."""
    rows = ordered_blocks(df, [*group, *order], blocks).withColumn("_g", F.struct(*group))
    local = rows.withColumn(
        "_local", F.row_number().over(W.partitionBy("block", *group).orderBy(*order))
    )
    # Only the first and last group of a block can reach into another block.
    edges = rows.groupBy("block").agg(F.min("_g").alias("_first"), F.max("_g").alias("_last"))
    counts = (
        rows.join(F.broadcast(edges), "block")
        .filter((F.col("_g") == F.col("_first")) | (F.col("_g") == F.col("_last")))
        .groupBy("block", "_g").agg(F.count(F.lit(1)).alias("_rows"))
    )
    before = W.partitionBy("_g").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = counts.select("block", "_g", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_carry"))
    # At most two rows per block, so the broadcast side is bounded.
    return (
        local.join(F.broadcast(carry), ["block", "_g"], "left")
        .withColumn(name, (F.col("_local") + F.coalesce("_carry", F.lit(0))).cast("long"))
        .drop("block", "_g", "_local", "_carry")
    )


def gap_groups(
    df: DataFrame, ts: str, seq: str, is_gap: Callable[[Column, Column], Column], blocks: int | None = None
) -> DataFrame:
    """Number the gap-separated groups of the whole log and the rows in them.

    ``is_gap(previous, current)`` says whether a new group starts. Adds
    ``group_no`` (1-based) and ``row_no`` (1-based inside its group).
    """
    rows = ordered_blocks(df, [ts, seq], blocks)
    in_block = W.partitionBy("block").orderBy(ts, seq)
    local = rows.withColumn("_prev", F.lag(ts).over(in_block)).withColumn(
        "_gap", F.when(F.col("_prev").isNotNull() & is_gap(F.col("_prev"), F.col(ts)), 1).otherwise(0)
    )
    local = local.withColumn("_lg", F.sum("_gap").over(in_block))
    local = local.withColumn(
        "_lr", F.row_number().over(W.partitionBy("block", "_lg").orderBy(ts, seq))
    )
    summary = local.groupBy("block").agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.max("_lg").alias("_gaps"),
        F.max_by("_lr", F.struct(F.col("_lg"), F.col("_lr"))).alias("_tail"),
    )
    by_block = W.orderBy("block")  # one row per block
    summary = summary.withColumn("_prev_last", F.lag("_last").over(by_block)).withColumn(
        "_opens",
        F.when(F.col("_prev_last").isNull() | is_gap(F.col("_prev_last"), F.col("_first")), 1).otherwise(0),
    )
    # A block restarts the open group when it begins one or contains a gap.
    summary = summary.withColumn(
        "_run", F.sum(F.when((F.col("_opens") == 1) | (F.col("_gaps") > 0), 1).otherwise(0)).over(by_block)
    ).withColumn(
        "_open_rows",
        F.sum("_tail").over(W.partitionBy("_run").orderBy("block")),
    )
    summary = summary.select(
        "block",
        F.when(F.col("_opens") == 1, 0).otherwise(F.lag("_open_rows").over(by_block)).alias("_carry"),
        (
            F.sum("_opens").over(by_block)
            + F.coalesce(
                F.sum("_gaps").over(by_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            )
        ).alias("_base"),
    )
    return (
        local.join(F.broadcast(summary), "block")
        .withColumn("group_no", (F.col("_base") + F.col("_lg")).cast("long"))
        .withColumn(
            "row_no",
            (F.col("_lr") + F.when(F.col("_lg") == 0, F.col("_carry")).otherwise(0)).cast("long"),
        )
        .drop("block", "_prev", "_gap", "_lg", "_lr", "_carry", "_base")
    )
