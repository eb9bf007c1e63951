"""Repeated word passages by prefix-partitioned suffix trees.

A window is ``window`` words in a row. Its anchor is the place of its least piece
of ``piece`` words by hash (the first of equals), so equal windows have equal
anchors. The suffixes that take part start at anchors and are as long as a
window: the words from the anchor to the window's end, then those before it.
Prefixes of variable length split them:

1. Pieces are the shortest prefixes. A piece that occurs in one row only starts
   no repeat and is dropped; for the others each document gives the stretch of
   words that holds all windows anchored there. Equal stretches are one, with
   the smallest id that holds it, which is a pre-aggregated minimum.
2. A piece with at most ``group`` different stretches belongs to a group that fits
   in memory. Its suffix tree is the sorted suffixes with the common prefixes of
   neighbours; internal nodes as deep as a window are the repeats, and the
   smallest id below a node owns it.
3. A piece with more stretches is a prefix that is too short. It grows to the
   whole window, where a node is one window and its owner again a pre-aggregated
   minimum. So no passage, however frequent, and no common phrase is one group.

Windows whose owner has a smaller id are merged per document: these are the
maximal repeats that go. Whole copies of a text are decided by their smallest id
and stay out of the trees. Words are compared as text; hashes choose anchors and
name stretches.

Defined results: words are runs outside ``[\\x20\\x09-\\x0D]``, unchanged. A null,
empty or blank text has no words. A null ``doc_id`` is smaller than every number.
Rows that repeat an id never remove words from each other. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import common
from termloom.llm.common import ready_workers, sized, stored, text_of
from termloom.llm.shingles import Shingler, joined

WINDOW, PIECE = 13, 5
# Different stretches of a group, which a task holds at once.
GROUP = 2048
# Pieces a task holds before it sends what it has seen.
HELD = 1 << 20
LOWEST = -(2**63)
ROW = ["owner", "digest"]
NAME = ["piece", "stretch"]
NAME_FIELDS = [("piece", pa.int64()), ("stretch", pa.int64())]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def places_of_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value among every ``width`` values in a row."""
    places, span = np.arange(len(values)), 1
    while span < width:
        # Two windows of ``span`` values, ``step`` apart, are one of ``span + step``.
        step = min(span, width - span)
        right = values[step:] < values[:-step]
        places = np.where(right, places[step:], places[:-step])
        values = np.where(right, values[step:], values[:-step])
        span += step
    return places


class Anchors:
    """The anchors of a text's windows."""

    def __init__(self, window: int, piece: int):
        self.window, self.piece = window, piece
        self.hash = Shingler(piece).word_hashes

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Piece, place, and first and last window of each anchor."""
        count = len(words) - self.window + 1
        if count < 1:
            return (np.empty(0, np.int64),) * 4
        pieces = joined(self.hash(words), self.piece)
        anchor = places_of_least(pieces, self.window - self.piece + 1)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        places = anchor[first]
        return pieces[places].view(np.int64), places, first, np.r_[first[1:], count] - 1


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, owner, digest, second, text``: the two digests name a text, owner and digest a row."""
    doc_id, text = F.col("doc_id").cast("long"), text_of()
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LOWEST)).alias("owner"), F.xxhash64(text).alias("digest"),
        F.xxhash64(F.lit("second"), text).alias("second"), text.alias("text"),
    )


def marked_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``whole``: a row with a smaller id has the same text."""
    groups = rows.groupBy("digest", "second").agg(F.min("owner").alias("first"), F.max("owner").alias("last"))
    groups = stored(groups.filter("first < last").select("digest", "second", "first"), "same-texts")
    later = F.coalesce(F.col("owner") > F.col("first"), F.lit(False))
    return rows.join(sized(groups, 24), ["digest", "second"], "left").withColumn("whole", later).drop("first")


def common_pieces(rows: DataFrame, window: int, piece: int) -> DataFrame:
    """``piece`` of the anchors that occur in more than one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(window, piece)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found, seen = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.minimum(seen, 2))], ["piece", "rows"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(np.unique(anchors(words_of(text))[0]))
                size += len(held[-1])
            if size >= HELD:
                yield flush()
                held, size = [], 0
        yield flush()

    seen = rows.select("text").mapInArrow(run, "piece long, rows long")
    return stored(seen.groupBy("piece").agg(F.sum("rows").alias("n")).filter("n > 1").select("piece"), "pieces")


def candidate_places(rows: DataFrame, pieces: DataFrame, window: int, piece: int) -> DataFrame:
    """``owner, digest, places``: the anchors of each row whose piece is common, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(window, piece)
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ROW]
            found = [anchors(words_of(text))[:2] for text in batch.column("text").to_pylist()]
            sizes = [len(places) for _, places in found]
            none = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays([
                *(pa.array(np.repeat(k, sizes)) for k in keys),
                *(pa.array(np.concatenate(none + [f[i] for f in found])) for i in (0, 1)),
            ], [*ROW, "piece", "place"])

    every = rows.select(*ROW, "text").mapInArrow(run, "owner long, digest long, piece long, place long")
    kept = every.join(sized(pieces, 8), "piece", "left_semi")
    # As many as the text of a row has.
    return stored(kept.groupBy(*ROW).agg(F.collect_set(F.col("place").cast("int")).alias("places")), "places")


def weighed(df: DataFrame, numbers: Column) -> DataFrame:
    """``df`` marked for broadcast when its rows, of two keys and some 4-byte ``numbers``, are small enough."""
    size = df.agg(F.sum(24 + 4 * numbers)).first()[0] or 0
    return F.broadcast(df) if size <= common.BROADCAST_BYTES else df


STRETCHES = pa.schema([
    *NAME_FIELDS, ("owner", pa.int64()), ("digest", pa.int64()),
    ("before", pa.int32()), ("words", pa.binary()), ("firsts", pa.list_(pa.int32())),
])


def stretches(rows: DataFrame, places: DataFrame, window: int, piece: int) -> DataFrame:
    """The words around the candidate anchors of every row, stored; equal ones of a row once.

    ``before`` words of a stretch stand before its anchor; ``firsts`` are the
    places of its first word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(window, piece)
        for batch in batches:
            out = []
            for owner, digest, text, wanted in zip(*(batch.column(c).to_pylist() for c in (*ROW, "text", "places")), strict=True):
                words, wanted, mine = words_of(text), set(wanted), {}
                for number, at, first, last in zip(*(x.tolist() for x in anchors(words)), strict=True):
                    if at in wanted:
                        held = b" ".join(words[first:last + window])
                        mine.setdefault((number, at - first, held), []).append(first)
                out += [
                    (number, xxhash.xxh64_intdigest(held, before) - 2**63, owner, digest, before, held, firsts)
                    for (number, before, held), firsts in mine.items()
                ]
            columns = zip(*out, strict=True) if out else [()] * len(STRETCHES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, STRETCHES, strict=True)], schema=STRETCHES
            )

    found = rows.select(*ROW, "text").join(weighed(places, F.size("places")), ROW).mapInArrow(
        run, "piece long, stretch long, owner long, digest long, before int, words binary, firsts array<int>"
    )
    return stored(found, "stretches")


def suffixes(before: int, words: list[bytes], window: int) -> Iterator[bytes]:
    """The suffix of every window of a stretch: from the anchor on, then what stands before it."""
    for start in range(len(words) - window + 1):
        at = before - start
        yield b" ".join((*words[before:start + window], *words[start:before], b"%d" % at))


def deep_nodes(leaves: list[tuple[bytes, int, int]]) -> Iterator[list[tuple[bytes, int, int]]]:
    """Nodes of the suffix tree that are as deep as a window, with the leaves below.

    Suffixes are as long as a window; sorted, those below one such node stand together.
    """
    leaves.sort()
    for _, node in groupby(leaves, key=lambda leaf: leaf[0]):
        yield list(node)


OWNERS = "piece long, stretch long, windows int, owner long, owners array<long>"
OWNERS_ARROW = pa.schema([
    *NAME_FIELDS, ("windows", pa.int32()), ("owner", pa.int64()), ("owners", pa.list_(pa.int64()))
])
DIFFERENT = (*NAME, "before", "words", "least", "most")


def _trees(window: int, group: int):
    """Owners of the windows of stretches in which some row gives up a window.

    Whole pieces come together, several in one tree. ``owners`` is null where one
    ``owner`` has all windows.
    """

    def grown(held: list[tuple]) -> pa.RecordBatch:
        leaves = [
            (suffix, i, j)
            for i, row in enumerate(held) for j, suffix in enumerate(suffixes(row[2], row[3].split(b" "), window))
        ]
        owners: list[dict[int, int]] = [{} for _ in held]
        for node in deep_nodes(leaves):
            least = min(held[i][4] for _, i, _ in node)
            for _, i, j in node:
                owners[i][j] = least
        out = []
        for (piece, stretch, _, _, _, most), mine in zip(held, owners, strict=True):
            least, last = min(mine.values()), max(mine.values())
            if least < most:
                out.append((piece, stretch, len(mine), least, None if least == last else [mine[j] for j in range(len(mine))]))
        columns = zip(*out, strict=True) if out else [()] * len(OWNERS_ARROW)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, OWNERS_ARROW, strict=True)], schema=OWNERS_ARROW
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in DIFFERENT), strict=True):
                if len(held) >= group and row[0] != held[-1][0]:
                    yield grown(held)
                    held = []
                held.append(row)
        if held:
            yield grown(held)

    return run


def _windows(window: int):
    """Each window of a stretch, named by a digest of its suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (xxhash.xxh3_128_digest(suffix), number, name, j, least, most)
                for number, name, before, words, least, most in zip(
                    *(batch.column(c).to_pylist() for c in DIFFERENT), strict=True)
                for j, suffix in enumerate(suffixes(before, words.split(b" "), window))
            ]
            columns = zip(*out, strict=True) if out else [()] * 6
            kinds = [pa.binary(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", *NAME, "place", "least", "most"]
            )

    return run


def window_owners(different: DataFrame, window: int, group: int) -> DataFrame:
    """``piece, stretch, windows, owner, owners``: the smallest id that holds each window of a stretch."""
    sizes = different.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group)
    large = sized(stored(sizes.select("piece"), "long-prefixes"), 8)
    small = different.join(large, "piece", "left_anti").select(*DIFFERENT)
    trees = small.repartition("piece").sortWithinPartitions("piece").mapInArrow(_trees(window, group), OWNERS)
    grown = different.join(large, "piece", "left_semi")
    alone = stored(grown.mapInArrow(
        _windows(window), "name binary, piece long, stretch long, place long, least long, most long"
    ), "windows")
    owner = stored(alone.groupBy("name").agg(F.min("least").alias("owner")), "window-owners")
    placed = alone.join(sized(owner, 32), "name").groupBy(*NAME).agg(
        F.count(F.lit(1)).cast("int").alias("windows"), F.min("owner").alias("owner"),
        F.sort_array(F.collect_list(F.struct("place", "owner"))).alias("found"), F.max("most").alias("most"),
    ).filter("owner < most")
    return stored(trees.unionByName(
        placed.select(*NAME, "windows", "owner", F.col("found.owner").alias("owners"))
    ), "owners")


def repeats(sources: DataFrame, window: int, piece: int, group: int) -> DataFrame:
    """``owner, digest, spans``: the maximal repeats of every row that a smaller id holds too, stored."""
    places = candidate_places(sources, common_pieces(sources, window, piece), window, piece)
    held = stretches(sources, places, window, piece)
    different = stored(held.groupBy(*NAME).agg(
        F.min("owner").alias("least"), F.max("owner").alias("most"), F.any_value("before").alias("before"),
        F.any_value("words").alias("words"),
    ), "different-stretches")
    owners = window_owners(different, window, group).withColumnRenamed("owner", "first")
    numbers = F.sequence(F.lit(0), F.col("windows") - 1)
    lost = F.when(F.col("owners").isNull(), numbers).otherwise(
        F.filter(numbers, lambda j: F.element_at("owners", j + 1) < F.col("owner"))
    )
    # Both sides grow with the corpus, so this join is a shuffle at every size.
    hits = held.select(*NAME, *ROW, "firsts").join(owners.hint("merge"), NAME)
    hits = hits.filter(F.col("first") < F.col("owner")).withColumn("lost", lost).filter(F.size("lost") > 0)
    starts = F.flatten(F.transform("firsts", lambda f: F.transform("lost", lambda j: f + j)))
    by_row = hits.select(*ROW, starts.alias("starts")).groupBy(*ROW).agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(starts, window) for starts in batch.column("starts").to_pylist()]
            ends = [pa.array([[s[i] for s in row] for row in spans], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ROW), *ends], [*ROW, "begins", "ends"])

    return stored(by_row.mapInArrow(run, "owner long, digest long, begins array<int>, ends array<int>"), "repeats")


def merged(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal stretches ``(start, end)`` that the windows at ``starts`` cover."""
    at = np.unique(np.array(starts, dtype=np.int64))
    cut = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + window])
    ends = at[np.r_[cut[1:], len(at)] - 1] + window
    return list(zip(at[cut].tolist(), ends.tolist(), strict=True))


CLEANED = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"
CLEANED_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def _cleaned(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "whole", "begins", "ends"))
            for doc_id, text, whole, begins, ends in zip(*columns, strict=True):
                words, spans, kept, done = words_of(text), [], [], 0
                if whole and len(words) >= window:
                    spans = [(0, len(words))]
                elif begins:
                    spans = list(zip(begins, ends, strict=True))
                for begin, end in spans:
                    kept += words[done:begin]
                    done = end
                kept += words[done:]
                out.append({
                    "doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(kept),
                    "kept": b" ".join(kept).decode(), "spans": [{"start": a, "end": b} for a, b in spans],
                })
            yield pa.RecordBatch.from_pylist(out, schema=CLEANED_ARROW)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans`` of every row.

    A word goes when a window that covers it also starts in a row with a smaller
    id; ``kept`` are the other words, ``spans`` the stretches that went.
    """
    ready_workers(docs.sparkSession)
    rows = marked_copies(keyed(docs))
    found = repeats(rows.filter("not whole"), window, piece, group)
    columns = ["doc_id", "text", "whole", "begins", "ends"]
    # Only texts that lose words meet the table of spans.
    touched = sized(found.select(*ROW), 16)
    none = F.lit(None).cast("array<int>")
    rest = rows.join(touched, ROW, "left_anti").withColumns({"begins": none, "ends": none})
    cut = rows.join(touched, ROW, "left_semi").join(weighed(found, F.size("begins") * 2 + 6), ROW)
    return rest.select(*columns).unionByName(cut.select(*columns)).mapInArrow(_cleaned(window), CLEANED)
