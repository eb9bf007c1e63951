"""Change logs: filter them, reduce them, and fold them into a corpus.

Changes are rows ``(seq, ts, op, path, old_path)``. ``op`` is one of
``create modify delete rename delete_dir rename_dir create_dir``; renames go
from ``old_path`` to ``path``. A higher ``seq`` is a later change. Content is
read from the corpus when the changes are applied, never from the log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import paths as P
from termloom.operators.joins import (
    BROADCAST_BYTES, PUSHDOWN_LIMIT, ROW_BYTES, among, below, covered_by, few, fits_broadcast, holding, keyed_join,
    without,
)
from termloom.session import shared_dir

FILE_PUTS = ["create", "modify", "rename"]
RENAMES = ["rename", "rename_dir"]
OPERATIONS = [*FILE_PUTS, "delete", "delete_dir", "rename_dir", "create_dir"]
FEW_PREFIXES = 50


def _action(name: str, path: str) -> Column:
    return F.struct(F.lit(name).alias("action"), F.col(path).alias("path"))


def expand(changes: DataFrame, extensions: list[str], keep: list[str] = ()) -> DataFrame:
    """Primitive actions ``(seq, action, path)``, with the ``keep`` columns.

    Actions are ``put``, ``delete``, ``delete_prefix`` and ``put_dir``. The
    extension filter decides what is put and which halves of a rename count;
    plain deletes are not filtered.
    """
    new_ok = P.is_target(F.col("path"), extensions)
    old_ok = P.is_target(F.col("old_path"), extensions)
    op = F.col("op")
    put, delete = _action("put", "path"), _action("delete", "path")
    actions = F.array(
        F.when(op.isin("create", "modify") & new_ok, put),
        F.when(op == "delete", delete),
        F.when((op == "rename") & old_ok, _action("delete", "old_path")),
        F.when((op == "rename") & new_ok, put),
        F.when(op == "delete_dir", _action("delete_prefix", "path")),
        F.when(op == "rename_dir", _action("delete_prefix", "old_path")),
        F.when(op.isin("rename_dir", "create_dir"), _action("put_dir", "path")),
    )
    return changes.select("seq", *keep, F.inline(F.array_compact(actions)))


def malformed() -> Column:
    """Reason a change cannot be read, or null."""
    no_old = F.col("op").isin(RENAMES) & F.col("old_path").isNull()
    unknown = F.col("op").isNull() | ~F.col("op").isin(OPERATIONS)
    return F.when(unknown, "unknown operation").when(F.col("path").isNull() | no_old, "missing path")


def _local(rows: DataFrame) -> DataFrame:
    """The few ``rows`` as a local relation: what follows from it alone needs no job."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)


def pin(changes: DataFrame) -> tuple[DataFrame, bool]:
    """``changes`` as a local relation when they are few, and whether they are."""
    head = changes.limit(PUSHDOWN_LIMIT + 1).toArrow()
    if head.num_rows > PUSHDOWN_LIMIT:
        return changes, False
    return changes.sparkSession.createDataFrame(head, changes.schema), True


def _settled(rows: DataFrame, pinned: bool) -> DataFrame:
    """``rows`` computed once: on the driver when they come from ``pinned`` changes, else a checkpoint."""
    if pinned:
        return _local(rows)
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def checked(
    changes: DataFrame, corpus: DataFrame, extensions: list[str], pinned: bool = False
) -> DataFrame:
    """Changes with a ``reason``, null when the change can be applied.

    A change that needs content which the corpus does not hold is set aside
    as a whole, so neither half of such a rename is applied.
    """
    needed = F.when(
        F.col("op").isin(FILE_PUTS) & P.is_target(F.col("path"), extensions), F.col("path")
    )
    marked = changes.withColumn("_needed", needed)
    wants = F.col("_needed").isNotNull()
    if pinned:
        names = sorted({row["_needed"] for row in marked.filter(wants).select("_needed").collect()})
        # No more rows than names.
        found = corpus.select("path").filter(among("path", names)).distinct().collect() if names else []
        missing = wants & ~among("_needed", [row["path"] for row in found])
        reason = F.coalesce(malformed(), F.when(missing, "not in corpus"))
        return marked.select(*changes.columns, reason.alias("reason"))
    asked = marked.filter(wants).select(F.col("_needed").alias("path")).distinct()
    listed = few(asked)
    small = listed is not None or fits_broadcast(asked, "path")
    paths = corpus.select("path")
    if listed is not None:
        paths = paths.filter(among("path", [row["path"] for row in listed]))
    held = keyed_join(paths, asked, ["path"], small=small).select(
        F.col("path").alias("_needed"), F.lit(True).alias("_held")
    )
    reason = F.coalesce(
        malformed(), F.when(F.col("_needed").isNotNull() & F.col("_held").isNull(), "not in corpus")
    )
    # Changes that need no content stay out of the join.
    looked_up = keyed_join(marked.filter(wants), held, ["_needed"], "left", small, F.col("seq"))
    rest = marked.filter(~wants).withColumn("_held", F.lit(None).cast("boolean"))
    return looked_up.unionByName(rest).select(*changes.columns, reason.alias("reason"))


def split_loadable(
    changes: DataFrame, corpus: DataFrame, extensions: list[str], pinned: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Changes that can be applied, and the rest with a ``reason``.

    The checked changes are computed once; ``pinned`` ones (see ``pin``) stay local.
    """
    rows = _settled(checked(changes, corpus, extensions, pinned), pinned)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def reduced(actions: DataFrame) -> DataFrame:
    """``(action, path, seq)``: the latest of each action per path.

    Combined before the shuffle, so a path changed very often is no hot spot.
    """
    return actions.groupBy("action", "path").agg(F.max("seq").alias("seq"))


@dataclass(frozen=True)
class Resolved:
    """What is left of a change log once it is reduced per path.

    The lists are the same as the tables, for scans, when they are few.
    """

    puts: DataFrame  # (path, seq): paths whose last word is a put
    deletes: DataFrame  # (path, seq): latest plain delete
    prefixes: DataFrame  # (prefix, seq): latest prefix delete
    small: bool  # the paths that are put or deleted may be broadcast
    put_list: list[str] | None
    delete_list: list[str] | None
    prefix_list: list[str] | None
    prefix_lengths: set[int]


@dataclass(frozen=True)
class _Facts:
    """What one look at the reduced log tells."""

    small: bool
    lengths: dict[str, set[int]]  # lengths of the paths of the folder actions
    listed: dict[str, list[str]] | None  # paths per action, when few


def _look(net: DataFrame) -> _Facts:
    rows = few(net.select("action", "path"))
    if rows is not None:
        listed: dict[str, list[str]] = {a: [] for a in ("put", "delete", "delete_prefix", "put_dir")}
        for action, path in rows:
            listed[action].append(path)
        size = len(rows) * (ROW_BYTES + max((len(path.encode()) for _, path in rows), default=0))
        return _Facts(size <= BROADCAST_BYTES, {a: {len(p) for p in ps} for a, ps in listed.items()}, listed)
    length = F.length("path")
    facts = net.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("path")).alias("longest"),
        # At most one entry per possible path length, whatever the data size.
        *[F.collect_set(F.when(F.col("action") == a, length)).alias(a) for a in ("delete_prefix", "put_dir")],
    ).first()
    small = facts["n"] * (ROW_BYTES + facts["longest"]) <= BROADCAST_BYTES
    return _Facts(small, {a: set(facts[a]) for a in ("delete_prefix", "put_dir")}, None)


def resolve(
    actions: DataFrame, corpus: DataFrame, extensions: list[str], pinned: bool = False
) -> Resolved:
    """Reduce primitive actions to their net effect.

    A put survives unless a delete or a covering prefix delete has a strictly
    higher ``seq``; so a rename's put outlives its own delete. The reduced
    log and the surviving puts are used several times, so each is computed once:
    on the driver if they follow from ``pinned`` changes alone (folders that are
    put depend on the corpus), else in the checkpoint folder.
    """
    net = _settled(reduced(actions.coalesce(1) if pinned else actions), pinned)
    facts = _look(net)
    alone = pinned and not facts.lengths["put_dir"]

    def latest(name: str, key: str = "path") -> DataFrame:
        return net.filter(F.col("action") == name).select(F.col("path").alias(key), "seq")

    prefixes, deletes = latest("delete_prefix", "prefix"), latest("delete")
    last_put = latest("put")
    if facts.lengths["put_dir"]:
        candidates = corpus.select("path").filter(P.is_target(F.col("path"), extensions))
        from_folders = covered_by(
            candidates, latest("put_dir", "prefix"), True, facts.small, facts.lengths["put_dir"]
        )
        last_put = last_put.unionByName(from_folders.select("path", "seq")).groupBy("path").agg(
            F.max("seq").alias("seq")
        )
    killed = (
        covered_by(
            last_put, prefixes.withColumnRenamed("seq", "_ended"), small=facts.small,
            lengths=facts.lengths["delete_prefix"],
        )
        .select("path", "_ended").unionByName(deletes.withColumnRenamed("seq", "_ended"))
    )
    killed = (killed.coalesce(1) if alone else killed).groupBy("path").agg(F.max("_ended").alias("_ended"))
    puts = _settled(
        last_put.join(killed, "path", "left")
        .filter(F.col("_ended").isNull() | (F.col("seq") >= F.col("_ended")))
        .select("path", "seq"),
        alone,
    )
    listed = few(puts.select("path"))
    return Resolved(
        puts, deletes, prefixes, facts.small and (listed is not None or fits_broadcast(puts, "path")),
        None if listed is None else [row["path"] for row in listed],
        facts.listed and facts.listed["delete"], facts.listed and facts.listed["delete_prefix"],
        facts.lengths["delete_prefix"],
    )


def touched(docs: DataFrame, resolved: Resolved) -> DataFrame:
    """Rows of ``docs`` that the changes replace or delete."""
    by_prefix = docs
    if resolved.put_list is not None and resolved.delete_list is not None:
        by_name = docs.filter(among("path", [*resolved.put_list, *resolved.delete_list]))
    else:
        named = resolved.puts.select("path").unionByName(resolved.deletes.select("path")).distinct()
        by_name = keyed_join(docs, named, ["path"], "left_semi", resolved.small)
    if resolved.prefix_list is not None and len(resolved.prefix_list) <= FEW_PREFIXES:
        by_prefix = docs.filter(below("path", resolved.prefix_list))
    by_prefix = covered_by(
        by_prefix, resolved.prefixes, small=resolved.small, lengths=resolved.prefix_lengths
    ).select(*docs.columns)
    return by_name.unionByName(by_prefix).dropDuplicates(["path"])


def content_of(corpus: DataFrame, resolved: Resolved) -> DataFrame:
    """Current content of the paths to put; few of them are a condition of the scan."""
    rows = corpus.select("path", "content")
    if resolved.put_list is not None:
        return rows.filter(among("path", resolved.put_list))
    return holding(rows, resolved.puts, "path", resolved.small)


def fold(
    base: DataFrame, changes: DataFrame, corpus: DataFrame, extensions: list[str]
) -> DataFrame:
    """The documents left after applying ``changes`` to ``base``, in order."""
    resolved = resolve(expand(changes, extensions), corpus, extensions)
    gone = touched(base.select("path"), resolved).select("path").checkpoint()
    kept = without(base.select("path", "content"), gone, "path", fits_broadcast(gone, "path"))
    return kept.unionByName(content_of(corpus, resolved))


def covered_counts(docs: DataFrame, prefixes: DataFrame, component: bool = False) -> DataFrame:
    """``(prefix, n_docs)``: how many documents each prefix delete removes."""
    hits = covered_by(docs.select("path"), prefixes.select("prefix"), component)
    counts = hits.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_docs"))
    return prefixes.select("prefix").join(counts, "prefix", "left").select(
        "prefix", F.coalesce("n_docs", F.lit(0)).alias("n_docs")
    )


def pending(changes: DataFrame, last_applied: int) -> DataFrame:
    """``(op, n)`` for the changes later than ``last_applied``."""
    return (
        changes.filter(F.col("seq") > last_applied)
        .groupBy("op").agg(F.count(F.lit(1)).alias("n"))
    )
