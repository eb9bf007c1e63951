"""Near-duplicate groups by an LSH forest over MinHash signatures.

Every distinct shingle set has ``trees`` signatures of ``depth`` minima each. A
tree is the sorted order of its signatures. Sets that share the first ``root``
minima of a tree form a region; the neighbour with the longest common prefix
stands next to a set in the order, so neighbours are the first candidates. They
are confirmed on the full sets, and what is linked becomes one component. Trees
take part in turns (``ROUNDS``): a pair whose ends are in one component by then
needs no test, so that a group of near copies costs its first trees, not all.

Regions that still hold several components are searched to the end: they form
families, whose members outside the largest component meet all its members in
blocks of bounded size. So every pair that shares a region in any tree is either
in one component or was compared on the full sets; no region is cut off, and one
that is a single component costs nothing more. A pair of similarity 0.8 shares a
region with probability ``1 - (1 - 0.8 ** root) ** trees``, 0.9999994 with the
defaults. A family of ``s`` sets with ``o`` outside its largest component moves
about ``2 * s * o / chunk`` texts.

Equal sets are collapsed before (their links need no test) and share the
component of their smallest id. Hot regions and hot sets are spread: orders are
range-partitioned by the whole key, counts are pre-aggregated, blocks are dealt
one by one, and only texts of candidates are moved.

Defined results: null and empty texts and texts without words have an empty set
and link with nothing. A document without an id takes no part: its component is
null and it is kept. Rows that repeat an id are labelled by their sets; sets with
the same smallest id are one node, linked by any of its texts. Where several rows
with the kept id belong to a group, ``drop_near_duplicates`` keeps one of them. An
empty table gives an empty result. Other columns are ignored by
``near_duplicates`` and kept by ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ready_workers, sized, stored, text_of, unused
from termloom.llm.components import components
from termloom.llm.shingles import Shingler, similar

WORDS = 5
PERCENT = 80
TREES, DEPTH, ROOT = 20, 6, 3
# The trees before which components are labelled anew.
ROUNDS = (1, 2, 5)
SEED = 20240501
# Sets in one side of a block; fewer where they have more shingles than this each.
CHUNK, SET_SHINGLES = 512, 512
SKETCH = "doc_id long, digest long, n_shingles long, set_id binary, signature binary"
_BLOCK = 4096


def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Smallest high halves of ``shingles`` under each multiplier, in bounded memory."""
    best = np.full(len(odd), 0xFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(shingles), _BLOCK):
        product = np.multiply.outer(odd, shingles[i:i + _BLOCK])
        best = np.minimum(best, product.min(axis=1) >> np.uint64(32))
    return best.astype(">u4")


def text_digest() -> F.Column:
    return F.xxhash64(text_of())


def sketches(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """Text digest, set size, set identity and signature of every row; no signature for an empty set."""
    ready_workers(docs.sparkSession)
    odd = multipliers(trees * depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sizes, names, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingler(text)
                sizes.append(len(found))
                names.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(minima(found, odd).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(signatures, pa.binary())], ["doc_id", "digest", "n_shingles", "set_id", "signature"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, SKETCH)


def forest(firsts: DataFrame, trees: int, depth: int, root: int) -> DataFrame:
    """One row per set and tree: its region, the deeper part of its order key, its size."""
    width, top = 4 * depth, 4 * root
    rows = F.explode(F.array(*[
        F.struct(
            F.xxhash64(F.lit(t), F.substring("signature", t * width + 1, top)).alias("region"),
            F.substring("signature", t * width + top + 1, width - top).alias("deeper"), F.lit(t).alias("tree"),
        ) for t in range(trees)
    ]))
    return firsts.select("doc_id", "n_shingles", rows.alias("r")).select(
        "r.tree", "r.region", "r.deeper", "doc_id", "n_shingles"
    )


def shared_regions(rows: DataFrame) -> DataFrame:
    """The rows of regions that hold at least two sets."""
    regions = stored(
        rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("region"), "regions"
    )
    return stored(rows.join(sized(regions, 8), "region", "left_semi"), "forest")


def neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of a set and the one before it in a tree's order, in the same region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, doc_id, size = None, None, 0
        for batch in batches:
            left, right = [], []
            for r, d, n in zip(*(batch.column(c).to_pylist() for c in ("region", "doc_id", "n_shingles")), strict=True):
                if r == region and d != doc_id and 100 * min(n, size) >= percent * max(n, size):
                    left.append(min(d, doc_id))
                    right.append(max(d, doc_id))
                region, doc_id, size = r, d, n
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    order = ["region", "deeper", "doc_id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("region", "doc_id", "n_shingles")
    return placed.mapInArrow(run, "a long, b long").distinct()


def candidate_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The whole texts of ``ids``, each once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.join(sized(stored(ids, "candidates"), 8), "doc_id", "left_semi").distinct(), "candidate-texts")


def confirmed(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``pairs`` whose full shingle sets are similar enough."""
    texts = candidate_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        held: dict[str, np.ndarray] = {}

        def shingles(text: str) -> np.ndarray:
            if text not in held:
                if len(held) >= 256:
                    held.clear()
                held[text] = shingler(text)
            return held[text]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
            hits = [(a, b) for a, b, s, t in zip(*columns, strict=True) if similar(shingles(s), shingles(t), percent)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[i] for h in hits], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return stored(pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long").distinct(), "links")


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` after ``links`` between nodes; only the components that meet are searched anew."""
    if labels is None:
        return components(links)
    if links.isEmpty():
        return labels
    ends = links.select("a", "b").distinct()
    for side in ("a", "b"):
        ends = with_component(ends, labels, side)
    merged = components(ends.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    old = labels.withColumnRenamed("component", "old")
    new = merged.select(F.col("node").alias("old"), F.col("component").alias("new"))
    known = old.join(new, "old", "left").select("node", F.coalesce("new", "old").alias("component"))
    # A node that had no label was its own component.
    return stored(known.unionByName(merged.join(old.select("node"), "node", "left_anti")), "labels")


def with_component(pairs: DataFrame, labels: DataFrame, side: str) -> DataFrame:
    """``pairs`` with the component of one side, its own number where it has no label."""
    named = labels.select(F.col("node").alias(side), F.col("component").alias("found"))
    return pairs.join(named, side, "left").withColumn(f"{side}_component", F.coalesce("found", side)).drop("found")


def neighbour_labels(
    docs: DataFrame, rows: DataFrame, words: int, percent: int, trees: int, rounds: tuple[int, ...]
) -> DataFrame:
    """``node, component`` after all neighbours of all trees were compared or found linked."""
    cuts = [0, *(r for r in rounds if r < trees), trees]
    labels = None
    for low, high in zip(cuts, cuts[1:], strict=False):
        pairs = neighbours(rows.filter(F.col("tree").between(low, high - 1)), percent)
        if labels is not None:
            for side in ("a", "b"):
                pairs = with_component(pairs, labels, side)
            pairs = pairs.filter("a_component <> b_component").select("a", "b")
        labels = relabelled(labels, confirmed(docs, stored(pairs, "pairs"), words, percent))
    return labels


def families(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Sets to compare further: ``family, doc_id, component, lead``.

    A family joins regions that hold several components and share sets. Its
    leaders are the members outside its largest component.
    """
    own = F.coalesce("component", "doc_id").alias("component")
    members = stored(
        rows.select("region", "doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("region", "doc_id", "n_shingles", own), "members",
    )
    mixed = members.groupBy("region").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc_id").alias("first")
    ).filter("low < high").select("region", "first")
    mixed = stored(members.join(sized(stored(mixed, "open-regions"), 16), "region"), "open-members")
    family = components(mixed.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct())
    placed = stored(
        mixed.select("doc_id", "component", "n_shingles").distinct().join(
            family.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id"
        ), "families",
    )
    largest = F.struct("n", "component")
    main = placed.groupBy("family", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size")
    ).groupBy("family").agg(
        F.max_by("component", largest).alias("main"), F.sum("n").alias("members"), F.sum("size").alias("size"),
        (F.sum("n") - F.max("n")).alias("leaders"), (F.sum("size") - F.max_by("size", largest)).alias("lead_size"),
    )
    return placed.join(sized(stored(main, "main-components"), 48), "family").withColumn(
        "lead", F.col("component") != F.col("main")
    )


def block_links(docs: DataFrame, members: DataFrame, words: int, percent: int, chunk: int) -> DataFrame:
    """Links between components of a family, found block by block.

    Leaders and members are cut into chunks by a hash; a block is a chunk of each
    and compares its sets through one inverted index, so no pair is emitted that
    is not a link.
    """
    columns, rows = (
        F.ceil(F.greatest(F.col(count).cast("double"), F.col(size) / SET_SHINGLES) / chunk)
        for count, size in (("members", "size"), ("leaders", "lead_size"))
    )

    def chunk_of(count: F.Column) -> F.Column:
        return F.pmod(F.xxhash64("doc_id"), count)

    def every(count: F.Column) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))

    name = ["family", "doc_id", "component"]
    as_member = members.select(*name, F.lit(False).alias("lead"), every(rows).alias("i"), chunk_of(columns).alias("j"))
    as_leader = members.filter("lead").select(*name, F.lit(True).alias("lead"), chunk_of(rows).alias("i"), every(columns).alias("j"))

    def compare(block: pa.Table) -> pa.Table:
        shingler = Shingler(words)
        sets = [shingler(t) for t in block.column("text").to_pylist()]
        ids, parts, lead = (block.column(c).to_numpy() for c in ("doc_id", "component", "lead"))
        leaders = np.flatnonzero(lead)
        found: list[tuple[int, int]] = []
        if len(leaders):
            owner = np.repeat(np.arange(len(leaders)), [len(sets[i]) for i in leaders])
            index = np.concatenate([sets[i] for i in leaders])
            order = np.argsort(index, kind="stable")
            index, owner = index[order], owner[order]
            sizes = np.array([len(sets[i]) for i in leaders])
            for m in np.flatnonzero(~lead):
                low, high = np.searchsorted(index, sets[m]), np.searchsorted(index, sets[m], side="right")
                runs = high - low
                places = np.repeat(low - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(runs.sum())
                both = np.bincount(owner[places], minlength=len(leaders))
                hit = (100 * both >= percent * (sizes + len(sets[m]) - both)) & (parts[leaders] != parts[m])
                found += [(min(ids[m], ids[x]), max(ids[m], ids[x])) for x in leaders[hit]]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    blocks = as_member.unionByName(as_leader).join(candidate_texts(docs, members.select("doc_id").distinct()), "doc_id")
    return stored(blocks.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "links")


def labelled(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH,
    root: int = ROOT, chunk: int = CHUNK, rounds: tuple[int, ...] = ROUNDS,
) -> DataFrame:
    """``doc_id, digest, n_shingles, component``, one row per row of ``docs``."""
    sketch = stored(sketches(docs, words, trees, depth), "sketches")
    known = sketch.filter("doc_id is not null and set_id is not null")
    sets = stored(known.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "sets")
    firsts = known.join(sets, ["set_id", "doc_id"], "left_semi").dropDuplicates(["set_id", "doc_id"])
    rows = shared_regions(forest(firsts, trees, depth, root))
    labels = neighbour_labels(docs, rows, words, percent, trees, rounds)
    labels = relabelled(labels, block_links(docs, families(rows, labels), words, percent, chunk))
    named = sets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "set_id", F.coalesce("component", "doc_id").alias("component")
    )
    named = stored(named, "named-sets")
    # Rows without a set stay out of the join, where they would all be one key.
    columns = ["doc_id", "digest", "n_shingles"]
    alone = sketch.filter("doc_id is null or set_id is null").select(*columns, F.col("doc_id").alias("component"))
    return known.join(named, "set_id").select(*columns, "component").unionByName(alone)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``."""
    return labelled(docs, **options).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps, one of each group."""
    rows = stored(labelled(docs, **options).filter("component is not null"), "near-rows")
    first = F.col("doc_id") == F.col("component")
    # Several rows with the kept id: the smallest digest stays, and of equal texts one row.
    several = rows.filter(first).groupBy("component").agg(
        F.count(F.lit(1)).alias("rows"), F.min("digest").alias("stays")
    ).filter("rows > 1")
    several = sized(stored(several.select("component", "stays"), "repeated-ids"), 16)
    judged = rows.join(several, "component", "left").withColumn(
        "kept", first & (F.col("stays").isNull() | (F.col("digest") == F.col("stays")))
    )
    names = unused(docs, 2)
    gone = (F.col("doc_id").cast("long") == F.col(names[0])) & (text_digest() == F.col(names[1]))

    def keys(of: DataFrame) -> DataFrame:
        ids = of.select(F.col("doc_id").alias(names[0]), F.col("digest").alias(names[1])).distinct()
        return sized(stored(ids, "near-copies"), 16)

    kept = docs.join(keys(judged.filter("not kept")), gone, "left_anti")
    twice = keys(judged.filter("kept and stays is not null"))
    if twice.isEmpty():
        return kept
    mark = unused(docs, 3)[2]
    once = kept.join(twice, gone, "left_semi").withColumn(mark, text_digest()).dropDuplicates(["doc_id", mark]).drop(mark)
    return kept.join(twice, gone, "left_anti").unionByName(once)
