"""Scores summed document by document, for queries of which any word may match.

Postings of the words asked for are dealt by document, which moves each of them
once, however many clauses share its word. Clauses then meet them as Arrow
columns, and a task that knows ``k`` better matches of a query lets others go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from termloom.functions.scoring import SCORE_DIGITS

STEPS = 1 << 20  # pairs of clause and posting taken together, unless one document has more
KNOWN_SCORES = 1 << 21  # best scores a task keeps in mind, over all queries


def best_sums(postings: DataFrame, words: DataFrame, part: Column, k: int, whole: frozenset) -> DataFrame:
    """``(qid, path, score)`` of documents that hold a word of a query.

    A score sums ``weight * boost`` of ``words``, few enough to be broadcast, times
    ``part`` of the posting. Matches that are surely not among the ``k`` best of
    their query may be left out, but not those of the queries in ``whole``.
    """
    asked = words.select("term", "qid", (F.col("weight") * F.col("boost")).alias("factor")).collect()
    terms = sorted({row["term"] for row in asked})
    qids = list(dict.fromkeys(row["qid"] for row in asked))
    number, place = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(qids)}
    rows = sorted((number[row["term"]], place[row["qid"]], row["factor"]) for row in asked)
    kind = words.schema["qid"].dataType
    numbered = postings.sparkSession.createDataFrame(
        pa.table({"term": pa.array(terms, pa.string()), "_word": pa.array(range(len(terms)), pa.int32())}),
        "term string, _word int",
    )
    dealt = (
        postings.select("term", "path", part.alias("_part")).join(F.broadcast(numbered), "term")
        .select("path", "_word", "_part").repartition("path").sortWithinPartitions("path")
    )
    run = _summed(
        rows, pa.array(qids, to_arrow_type(kind)), np.array([q in whole for q in qids], bool),
        k if k * len(qids) <= KNOWN_SCORES else 0,
    )
    return dealt.mapInArrow(run, T.StructType([
        T.StructField("qid", kind), T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType()),
    ]))


def _summed(rows: list[tuple[int, int, float]], qids: pa.Array, whole: np.ndarray, k: int, steps: int = STEPS):
    """Postings ``(path, _word, _part)`` in the order of their paths to scores; self-contained.

    ``rows`` holds ``(word, query, factor)``, by word. ``k`` 0 keeps every match.
    """
    slack = 2 * 10.0 ** -SCORE_DIGITS  # scores are rounded before they are compared
    words, queries, factors = (np.array(column, kind) for column, kind in zip(zip(*rows) if rows else ((), (), ()), (np.int64, np.int64, float)))
    fan = np.bincount(words)
    first = np.cumsum(fan) - fan
    schema = pa.schema([("qid", qids.type), ("path", pa.string()), ("score", pa.float64())])

    def documents(paths: pa.Array) -> np.ndarray:
        """The number of each row's document, in order."""
        coded = paths.dictionary_encode("encode").indices.to_numpy()
        return np.cumsum(np.concatenate([[0], coded[1:] != coded[:-1]]))

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of one document, one per word."""
        word, part = (column.to_numpy(zero_copy_only=False) for column in batch.columns[1:])
        found, at = np.unique(word, return_inverse=True)
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(np.zeros(len(found), np.int64))), pa.array(found), pa.array(np.bincount(at, part)),
        ], schema=batch.schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """Whole documents, about ``steps`` pairs of them at a time."""
        held: list[pa.RecordBatch] = []
        n = 0

        def cut(last: bool) -> Iterator[tuple]:
            rest = pa.concat_batches(held)
            doc = documents(rest.column(0))
            word, part = (column.to_numpy(zero_copy_only=False) for column in rest.columns[1:])
            done = np.cumsum(fan[word])
            starts = np.concatenate([np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), [len(doc)]])
            upto = len(starts) - 1 if last else len(starts) - 2  # the last document may go on
            i = 0
            while i < upto:
                a = starts[i]
                before = done[a - 1] if a else 0
                # As many documents as fit, one at least.
                j = int(np.searchsorted(done[starts[i + 1:upto + 1] - 1], before + steps, "right"))
                i += max(j, 1)
                b = starts[i]
                yield rest.column(0).slice(a, b - a), doc[a:b] - doc[a], word[a:b], part[a:b]
            left = rest.slice(starts[upto])
            held[:] = [] if last else [merged(left) if len(left) > len(fan) else left]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += int(fan[batch.column(1).to_numpy(zero_copy_only=False)].sum())
                if n >= steps:
                    yield from cut(False)
                    n = 0
        if held:
            yield from cut(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(qids), k), -np.inf)
        bar = np.full(len(qids), -np.inf)
        for paths, doc, word, part in pieces(batches):
            times = fan[word]
            clause = np.repeat(first[word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            n_docs = int(doc[-1]) + 1
            pair = queries[clause] * n_docs + np.repeat(doc, times)
            value, cells = factors[clause] * np.repeat(part, times), n_docs * len(qids)
            if cells <= 2 * len(pair):
                pairs = np.flatnonzero(np.bincount(pair, minlength=cells))
                score = np.bincount(pair, value, cells)[pairs]
            else:  # few of the cells are met
                pairs, cell = np.unique(pair, return_inverse=True)
                score = np.bincount(cell, value)
            query, at = np.divmod(pairs, n_docs)
            if k:
                near = ~(score < bar[query])
                query, at, score = query[near], at[near], score[near]
                seen = np.unique(query[~whole[query]])
                mine = np.isin(query, seen)
                owner = np.concatenate([query[mine], np.repeat(seen, k)])
                known = np.concatenate([score[mine], best[seen].ravel()])
                ranked = np.lexsort((-known, owner))
                ends = np.searchsorted(owner[ranked], seen)
                best[seen] = known[ranked][ends[:, None] + np.arange(k)]
                bar[seen] = best[seen, -1] - slack
                near = ~(score < bar[query])
                query, at, score = query[near], at[near], score[near]
            where = np.searchsorted(doc, at)
            yield pa.RecordBatch.from_arrays(
                [qids.take(pa.array(query)), paths.take(pa.array(where)), pa.array(score)], schema=schema
            )

    return run
