"""From raw file events to changes: classify, diff, debounce, batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import paths as P
from termloom.operators.ordinals import gap_groups, rank_in_group

# Quiet time before a change counts, idle time that closes a
# batch, and the most operations in a batch.
DEBOUNCE_SECONDS = 1.0
IDLE_SECONDS = 0.5
BATCH_LIMIT = 10


def _change(op: str, path: Column, old_path: Column | None = None) -> Column:
    old = F.lit(None).cast("string") if old_path is None else P.normalize(old_path)
    return F.struct(
        F.lit(op).alias("op"), P.normalize(path).alias("path"), old.alias("old_path")
    )


def classify(raw: DataFrame) -> DataFrame:
    """Raw events ``(seq, ts, kind, paths, is_dir)`` to change rows.

    Kinds ``create``, ``modify_data``, ``remove_file`` and ``remove_folder``
    give one change per path; ``rename_both`` takes paths 0 and 1. All other
    kinds are ignored. A rename without both paths stays in the output with a
    null path, for ``changes.split_loadable`` to set aside.
    """
    kind, is_dir = F.col("kind"), F.coalesce("is_dir", F.lit(False))

    def each(op: str) -> Column:
        return F.transform("paths", lambda p: _change(op, p))

    old, new = F.get("paths", F.lit(0)), F.get("paths", F.lit(1))
    changes = (
        F.when((kind == "create") & ~is_dir, each("create"))
        .when(kind == "create", each("create_dir"))
        .when(kind == "modify_data", each("modify"))
        .when(kind == "remove_file", each("delete"))
        .when(kind == "remove_folder", each("delete_dir"))
        .when((kind == "rename_both") & ~is_dir, F.array(_change("rename", new, old)))
        .when(kind == "rename_both", F.array(_change("rename_dir", new, old)))
    )
    return raw.select("seq", "ts", F.inline(changes)).select("seq", "ts", "op", "path", "old_path")


def snapshot_diff(before: DataFrame, after: DataFrame, blocks: int | None = None) -> DataFrame:
    """Changes ``(op, path, old_path)`` that lead from one listing to the next.

    Listings are ``(path, hash)``. Paths whose hash differs are modified. A
    vanished and a new path with the same hash are a rename; with several of
    them, the n-th vanished path in path order pairs with the n-th new one.
    """
    both = before.select("path", F.col("hash").alias("old_hash")).join(
        after.select("path", F.col("hash").alias("new_hash")), "path", "full_outer"
    ).filter(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    none = F.lit(None).cast("string")
    modified = both.filter("old_hash IS NOT NULL AND new_hash IS NOT NULL").select(
        F.lit("modify").alias("op"), "path", none.alias("old_path")
    )
    one_sided = both.filter("old_hash IS NULL OR new_hash IS NULL").select(
        F.coalesce("old_hash", "new_hash").alias("hash"),
        F.col("old_hash").isNotNull().alias("gone"),
        "path",
    )
    ranked = rank_in_group(one_sided, ["hash", "gone"], ["path"], "n", blocks)
    # (hash, n) holds one vanished and one new path at most.
    pairs = ranked.groupBy("hash", "n").agg(
        F.max(F.when(F.col("gone"), F.col("path"))).alias("old_path"),
        F.max(F.when(~F.col("gone"), F.col("path"))).alias("new_path"),
    )
    moved = pairs.select(
        F.when(F.col("old_path").isNull(), "create")
        .when(F.col("new_path").isNull(), "delete")
        .otherwise("rename").alias("op"),
        F.coalesce("new_path", "old_path").alias("path"),
        F.when(F.col("new_path").isNotNull(), F.col("old_path")).alias("old_path"),
    )
    return modified.unionByName(moved)


def debounce(changes: DataFrame, key: str = "path", seconds: float = DEBOUNCE_SECONDS) -> DataFrame:
    """One row per burst of changes to ``key``: ``first_ts, last_ts, n, seq, op``.

    A burst ends when nothing happens for more than ``seconds``; ``seq`` and
    ``op`` are those of its last change. Changes are first combined per time
    slot of that length (two in one slot are always in one burst), so a key
    with very many changes shrinks before it is shuffled.
    """
    micros = F.unix_micros("ts")
    width = int(seconds * 1_000_000)
    slots = changes.groupBy(key, F.floor(micros / width).alias("_slot")).agg(
        F.min("ts").alias("_min"), F.max("ts").alias("_max"),
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("seq", "op")).alias("_last"),
    )
    # Slots are numbered over range-partitioned blocks, so a busy key is many tasks.
    placed = slots.withColumn("_at", F.struct(F.col(key).alias("key"), "_min", "_max"))

    def opens(previous: Column, current: Column) -> Column:
        quiet = F.unix_micros(current["_min"]) - F.unix_micros(previous["_max"])
        return ~previous["key"].eqNullSafe(current["key"]) | (quiet > width)

    return gap_groups(placed, "_at", "_slot", opens).groupBy(key, "group_no").agg(
        F.min("_min").alias("first_ts"), F.max("_max").alias("last_ts"),
        F.sum("_n").alias("n"), F.max("_last").alias("_last"),
    ).select(key, "first_ts", "last_ts", "n", "_last.seq", "_last.op")


def form_batches(
    changes: DataFrame, idle_seconds: float = IDLE_SECONDS, limit: int = BATCH_LIMIT,
    blocks: int | None = None,
) -> DataFrame:
    """Adds ``group_no`` and ``batch_no``: the batch each change is applied in.

    A batch closes after ``limit`` changes or ``idle_seconds`` without one.
    ``group_no`` counts the idle gaps, ``batch_no`` the batches inside.
    """
    width = int(idle_seconds * 1_000_000)
    grouped = gap_groups(
        changes, "ts", "seq",
        lambda previous, current: F.unix_micros(current) - F.unix_micros(previous) > width, blocks,
    )
    return grouped.withColumn(
        "batch_no", F.floor((F.col("row_no") - 1) / limit).cast("long")
    ).drop("row_no")
