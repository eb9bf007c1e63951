"""Scores summed document by document, against plain sums."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from termloom.operators.clauses import Clause
from termloom.operators.nested import Group
from termloom.operators.ranking import top_k
from termloom.operators.sums import _summed
from termloom.plans.index import MemoryIndex
from termloom.plans.search import matches, search, search_nested

BOTH = re.compile(r"hashpartitioning\((qid|node)#\d+L?, (group_id#\d+L?, )?path#")


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    rows = [(f"/{i:03d}.txt", " ".join(rng.choices("abcdefgh", weights=[9, 9, 5, 4, 3, 2, 1, 1], k=i % 17))) for i in range(150)]
    return MemoryIndex.build(spark.createDataFrame([*rows, (None, "a b c"), (None, "c d")], "path string, content string"))


def clauses(boosts=(1.0, 0.5, -2.0, 0.0, None)):
    rng = random.Random(5)
    asked = [Clause(q, i, terms=[w], boost=rng.choice(boosts)) for q in range(12) for i, w in enumerate(rng.choices("abcdefghz", k=4))]
    return [*asked, Clause(20, 0, terms=["a"]), Clause(20, 1, kind="phrase", terms=["b a"]), Clause(21, 0, kind="match_all"), Clause(21, 1, terms=["g"])]


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_best_matches_are_the_best_of_all(index, k):
    best = search(index, clauses(), k).collect()
    assert sorted(best, key=str) == sorted(top_k(matches(index, clauses()), k).collect(), key=str)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_any_word_moves_postings_not_matches(index):
    assert not BOTH.search(plan(search(index, [c for c in clauses() if c.qid < 20])))


def test_nested_groups_are_summed_where_their_documents_are(index):
    members = [(1, Clause(0, 0, terms=["a"])), (1, Clause(0, 1, terms=["b"])), (2, Clause(0, 2, terms=["c"]))]
    groups = [Group(0, 0), Group(0, 1, 0, "must"), Group(0, 2, 0, "must_not")]
    assert not BOTH.search(plan(search_nested(index, groups, members)))


@pytest.mark.parametrize("steps", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("k", [0, 2])
def test_documents_are_whole_however_they_are_cut(steps, k):
    rng = random.Random(steps)
    rows = sorted((rng.randrange(9), rng.randrange(5), rng.choice([1.0, 0.25, -1.0])) for _ in range(30))
    # A path that comes very often, as one without a name may.
    postings = sorted(((rng.choice(["", "x", *"abcdef"]), rng.randrange(9), rng.random()) for _ in range(400)), key=lambda p: p[0])
    want = defaultdict(float)
    for path, word, part in postings:
        for w, q, factor in rows:
            if w == word:
                want[q, path or None] += factor * part
    batches = [
        pa.RecordBatch.from_arrays([
            pa.array([p or None for p, _, _ in some], pa.string()), pa.array([w for _, w, _ in some], pa.int32()),
            pa.array([x for _, _, x in some], pa.float64()),
        ], names=["path", "_word", "_part"])
        for some in (postings[i:i + 13] for i in range(0, len(postings), 13))
    ]
    whole = np.array([True, False, False, False, False])
    found = [r for b in _summed(rows, pa.array(range(5), pa.int64()), whole, k, steps)(iter(batches)) for r in b.to_pylist()]
    got = {(r["qid"], r["path"]): r["score"] for r in found}
    assert len(got) == len(found) and all(abs(got[x] - want[x]) < 1e-9 for x in got)
    for q in range(5):
        mine = sorted((x for x in want if x[0] == q), key=lambda x: -want[x])
        assert set(mine if whole[q] or not k else mine[:k]) <= set(got)
    assert k or len(got) == len(want)
