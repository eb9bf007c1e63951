"""Prefix trie of rebuilt conversations by whole-sequence collapse.

A conversation is rebuilt from the first ``h`` turns of the conversation that
opens its run of ``run`` ids, and its own turns after the first ``h``; ``h`` is
``crc32(id) % (MOST_SHARED + 1)``. Identical rebuilt conversations collapse into
one sequence with a weight and a list of the conversations that end in it. A
sequence that equals a proper prefix of another one is no leaf: those go by an
anti-join. What is left to aggregate are the prefixes of distinct sequences, so a
conversation that a third of the corpus repeats costs as much as one.

A prefix is named by its depth and two 64-bit numbers, each the exclusive or over
its turns of a hash of (depth of the turn, role, text): such a name of a whole
sequence is an ordinary pre-aggregated sum, and that of all its prefixes a running
one. Running values of long sequences are made in spans of bounded length, whose
totals are summed in turn; positions inside a conversation are ranked over
range-partitioned blocks; nodes with very many children send their own row, not
their children, to the join. No turn text is shuffled.

Each node belongs to the sequence with the smallest first member through it. As
the nodes of a sequence are then a tail of it, the tokens saved below a node are
the tail sum of its own sequence and the whole sums of the others through it.

Defined results: turns go by ``turn`` (null first), role, and a hash of the text.
A null role or text is empty. Rows without a ``conv_id`` take no part. A repeated
row is one more turn. A conversation without any rebuilt turn ends in the root.
An empty table has no node, not even the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import ship_code, sized, stored, text_of
from termloom.operators.ordinals import rank_in_group

RUN = 20
MOST_SHARED = 3
# Turns of a sequence, or ids of an end list, that meet in one task.
SPAN = 1 << 16
LISTED = 4096
# Children of a node that may meet in one join partition.
CHILDREN = 10_000
WORD = r"[^\x20\x09-\x0D]+"
NAME = ["depth", "p1", "p2"]


class Trie(NamedTuple):
    """``nodes``: one row per node, ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, n_ends`` and its name ``p1, p2``; ``ends``: the conversations that end in a node,
    ``depth, p1, p2, part, conv_ids``, ascending, in parts of bounded length."""

    nodes: DataFrame
    ends: DataFrame


def shared_turns() -> Column:
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, t1, t2, words``: turns by their place, named by two hashes."""
    role, text = text_of("role"), text_of("text")
    light = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("second"), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = rank_in_group(light, ["conv_id"], ["turn", "role", "t1", "t2"], "pos")
    return stored(placed.select("conv_id", "pos", "t1", "t2", "words"), "turns")


def rebuilt_turns(turns: DataFrame, run: int) -> DataFrame:
    """``conv_id, depth, x1, x2, words`` of the rebuilt conversations, and a row of depth 0 for each."""
    h = shared_turns()
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = stored(own.withColumn("opener", F.col("conv_id") - F.col("conv_id") % run), "conversations")
    opener = own.select(F.col("conv_id").alias("opener"), F.col("n").alias("opening"))
    given = own.join(opener, "opener", "left").select(
        "conv_id", "opener", F.least(h, F.coalesce("opening", F.lit(0))).alias("given")
    )
    given = stored(given, "given-turns")
    # Most conversations take as many turns as they leave out; only the others are looked up.
    short = given.filter(F.col("given") < h).select("conv_id", "given")
    rest = turns.filter(F.col("pos") > h).join(sized(short, 16), "conv_id", "left").select(
        "conv_id", (F.col("pos") - h + F.coalesce("given", h)).alias("depth"), "t1", "t2", "words"
    )
    heads = turns.filter(F.col("pos") <= MOST_SHARED).withColumnRenamed("conv_id", "opener")
    taken = given.filter("given > 0").join(heads, "opener").filter("pos <= given").select(
        "conv_id", F.col("pos").alias("depth"), "t1", "t2", "words"
    )
    rows = rest.unionByName(taken).select(
        "conv_id", "depth", F.xxhash64("depth", "t1", "t2").alias("x1"), F.xxhash64("t2", "depth", "t1").alias("x2"), "words"
    )
    zero = F.lit(0).cast("long")
    roots = own.select("conv_id", *[zero.alias(c) for c in ("depth", "x1", "x2", "words")])
    return stored(rows.unionByName(roots), "rebuilt")


def running(rows: DataFrame, group: str, place: str, longest: int, span: int, totals: dict[str, tuple]) -> DataFrame:
    """``rows`` with running totals ``{name: (column, aggregate)}`` by ``place`` (from 1) inside each ``group``.

    No more than ``span`` rows of a group meet in one window; the totals of the
    spans are made running in the same way.
    """
    cut = F.floor((F.col(place) - 1) / span).cast("long")
    rows = rows.withColumn("span", cut)
    inside = Window.partitionBy(group, "span").orderBy(place)
    local = rows.withColumns({name: how(column).over(inside) for name, (column, how) in totals.items()})
    if longest <= span:
        return local.drop("span")
    whole = rows.filter(F.col("length") > span).groupBy(group, "span").agg(
        F.first("length").alias("length"), *[how(column).alias(column) for column, how in totals.values()]
    ).withColumn("turn_span", F.col("span") + 1).drop("span")
    columns = {f"before_{name}": (column, how) for name, (column, how) in totals.items()}
    before = running(
        whole.withColumn("length", F.ceil(F.col("length") / span)), group, "turn_span", -(-longest // span), span, columns
    ).select(group, F.col("turn_span").alias("span"), *columns)
    joined = local.join(sized(stored(before, "spans"), 8 * (2 + len(columns))), [group, "span"], "left")
    merge = {
        name: F.col(name).bitwiseXOR(F.coalesce(f"before_{name}", F.lit(0))) if how is F.bit_xor
        else F.col(name) + F.coalesce(f"before_{name}", F.lit(0))
        for name, (_, how) in totals.items()
    }
    return joined.withColumns(merge).drop("span", *columns)


def end_lists(members: DataFrame, sequences: DataFrame, listed: int) -> DataFrame:
    """The members of each sequence, ascending, in parts of at most ``listed``."""
    one = sequences.filter("weight = 1").select(
        F.col("length").alias("depth"), "p1", "p2", F.lit(0).cast("long").alias("part"), F.array("first").alias("conv_ids")
    )
    several = sequences.filter("weight > 1").select("length", "p1", "p2", "first")
    copies = members.join(sized(several, 32), ["length", "p1", "p2"])
    placed = rank_in_group(copies, ["first"], ["conv_id"], "n").withColumn(
        "part", F.floor((F.col("n") - 1) / listed).cast("long")
    )
    more = placed.groupBy(F.col("length").alias("depth"), "p1", "p2", "part").agg(
        F.sort_array(F.collect_list("conv_id")).alias("conv_ids")
    )
    return stored(one.unionByName(more), "ends")


def with_parents(nodes: DataFrame, children: int) -> DataFrame:
    """``nodes`` with ``n_children`` and ``parent_conv_id``."""
    counted = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    counted = stored(nodes.join(counted, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = counted.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"), "n_children",
    )
    key = ["depth", "q1", "q2"]
    many = parents.filter(F.col("n_children") > children).drop("n_children")
    few = parents.filter(F.col("n_children") <= children).drop("n_children")
    looked = counted.join(sized(many, 32), key, "left")
    done = looked.filter(F.col("parent_conv_id").isNotNull() | (F.col("depth") == 0))
    rest = looked.filter(F.col("parent_conv_id").isNull() & (F.col("depth") > 0)).drop("parent_conv_id")
    return done.unionByName(rest.join(few, key))


def prefix_trie(
    conversations: DataFrame, run: int = RUN, span: int = SPAN, listed: int = LISTED, children: int = CHILDREN
) -> Trie:
    """The trie of all rebuilt conversations."""
    turns = rebuilt_turns(ordered_turns(conversations), run)
    members = stored(turns.groupBy("conv_id").agg(
        F.max("depth").alias("length"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2")
    ), "members")
    whole = stored(members.groupBy("length", "p1", "p2").agg(
        F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("weight")
    ), "sequences")
    longest = whole.agg(F.max("length")).first()[0] or 0
    steps = turns.filter("depth > 0").withColumnRenamed("conv_id", "first").join(
        sized(whole.select("first", "length", "weight"), 24), "first"
    )
    steps = running(steps, "first", "depth", longest, span, {"p1": ("x1", F.bit_xor), "p2": ("x2", F.bit_xor)})
    paths = steps.select(
        "first", "length", "weight", *NAME, F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "words",
    )
    zero = F.lit(0).cast("long")
    paths = stored(paths.unionByName(whole.select(
        "first", "length", "weight", *[zero.alias(c) for c in (*NAME, "q1", "q2", "words")]
    )), "paths")
    inner = paths.filter("depth < length").select(F.col("depth").alias("length"), "p1", "p2").distinct()
    leaves = stored(whole.join(inner, ["length", "p1", "p2"], "left_anti").select("first"), "leaves")
    marked = paths.join(sized(leaves.withColumn("leaf", F.lit(1)), 16), "first", "left")
    nodes = stored(marked.groupBy(*NAME).agg(
        F.min("first").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.coalesce(F.sum("leaf"), F.lit(0)).cast("long").alias("n_leaves"),
        F.min_by("length", "first").alias("length"), F.max("words").alias("words"), F.max("q1").alias("q1"),
        F.max("q2").alias("q2"), F.max(F.when(F.col("depth") == F.col("length"), F.col("weight"))).alias("n_ends"),
    ), "plain-nodes")
    # A node belongs to its smallest sequence; its tail sums are running sums from the end.
    saving = nodes.select(
        F.col("conv_id").alias("first"), "depth", (F.col("length") + 1).alias("length"),
        (F.col("length") + 1 - F.col("depth")).alias("place"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"),
    )
    tails = stored(running(saving, "first", "place", longest + 1, span, {"tail": ("own", F.sum)}), "tails")
    sums = tails.groupBy("first").agg(F.min("depth").alias("since"), F.max("tail").alias("total")).filter("total > 0")
    others = paths.select("first", *NAME).join(sized(stored(sums, "totals"), 24), "first").filter("depth < since").groupBy(
        *NAME
    ).agg(F.sum("total").alias("others"))
    saved = tails.select(F.col("first").alias("conv_id"), "depth", "tail")
    full = nodes.join(saved, ["conv_id", "depth"]).join(others, NAME, "left").withColumn(
        "saved_tokens", F.col("tail") + F.coalesce("others", F.lit(0))
    )
    named = with_parents(full, children).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("n_ends", F.lit(0)).alias("n_ends"), "p1", "p2",
    )
    return Trie(named, end_lists(members, whole, listed))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lists in many parts, which come in order; one part is held at a time."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(NAME, key, strict=True), ends_sha256=state.hexdigest())])

    for batch in batches:
        for row in batch.to_pylist():
            name = tuple(row[c] for c in NAME)
            if name != key:
                if key is not None:
                    yield done()
                key, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(row["ids"].encode())
    if key is not None:
        yield done()


def end_digests(trie: Trie, listed: int = LISTED) -> DataFrame:
    """``depth, p1, p2, ends_sha256``: SHA-256 of the decimal ids that end in a node, joined by commas.

    The digest of one list is sequential by nature; a list in several parts is
    read part by part, never held whole.
    """
    ship_code(trie.ends.sparkSession)
    joined = trie.ends.select(*NAME, "part", F.array_join(F.col("conv_ids").cast("array<string>"), ",").alias("ids"), F.size("conv_ids").alias("n"))
    large = stored(joined.filter((F.col("n") == listed) & (F.col("part") == 0)).select(*NAME), "long-lists")
    short = joined.join(sized(large, 24), NAME, "left_anti").select(*NAME, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    parts = joined.join(sized(large, 24), NAME).repartition(*NAME).sortWithinPartitions(*NAME, "part").select(*NAME, "ids")
    return short.unionByName(parts.mapInArrow(_streamed, "depth long, p1 long, p2 long, ends_sha256 string"))
