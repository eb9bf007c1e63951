"""Nested queries against a plain evaluation of their trees."""

import random

import pytest

from termloom.operators.clauses import Clause
from termloom.operators.nested import Group, nested_matches
from termloom.plans.index import MemoryIndex
from termloom.plans.search import matches, search_nested

WORDS = ["alpha", "beta", "gamma", "delta", "x", "y", "z", "none"]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    files = {f"/{i:02d}.txt": " ".join(rng.choices(WORDS[:7], weights=[3, 2, 1, 1, 4, 2, 1], k=rng.randint(1, 9))) for i in range(40)}
    return MemoryIndex.build(spark.createDataFrame(list(files.items()), "path string, content string"))


@pytest.fixture(scope="module")
def single(index):
    """Scores of every word and of some phrases alone."""
    texts = [*WORDS, "x alpha", "alpha x", "--"]
    rows = matches(index, [Clause(i, 0, "should", "phrase", [t]) for i, t in enumerate(texts)]).collect()
    out = {t: {} for t in texts}
    for r in rows:
        out[texts[r.qid]][r.path] = r.score
    return out


def evaluate(group_id, groups, members, single):
    parts = [(c.occur, single[c.terms[0]]) for g, c in members if g == group_id and c.terms[0] != "--"]
    parts += [(g.occur, evaluate(g.group_id, groups, members, single)) for g in groups if g.parent_id == group_id]
    paths = {p for occur, found in parts if occur != "must_not" for p in found}
    return {
        p: sum(found.get(p, 0) for occur, found in parts if occur != "must_not") for p in paths
        if all((p in found) == (occur == "must") for occur, found in parts if occur != "should")
    }


def test_random_trees_equal_plain_evaluation(index, single):
    rng = random.Random(6)
    groups, members, want = [], [], {}
    for qid in range(1000):
        mine = [Group(qid, 0)]
        for g in range(1, rng.randrange(1, 6)):
            mine.append(Group(qid, g, rng.randrange(g), rng.choice(["must", "should", "should", "must_not"])))
        own = [
            (rng.randrange(len(mine)), Clause(qid, i, rng.choice(["must", "should", "should", "must_not"]), "phrase", [rng.choice(list(single))]))
            for i in range(rng.randrange(1, 7))
        ]
        groups += mine
        members += own
        for path, score in evaluate(0, mine, own, single).items():
            want[qid, path] = round(score, 6)
    got = {(r.qid, r.path): round(r.score, 6) for r in nested_matches(index, groups, members).collect()}
    assert got == want and len(want) > 1000


def test_deep_trees_and_ranks(index, single):
    depth = 6
    groups = [Group(0, g, g - 1 if g else None, "must") for g in range(depth)]
    hits = search_nested(index, groups, [(depth - 1, Clause(0, 0, terms=["alpha"]))], k=3).collect()
    best = sorted(single["alpha"].items(), key=lambda x: (-round(x[1], 6), x[0]))[:3]
    assert [(r["rank"], r.path) for r in sorted(hits, key=lambda r: r["rank"])] == [(i + 1, p) for i, (p, _) in enumerate(best)]


def test_wrong_trees_are_refused(index):
    clause = [(1, Clause(0, 0, terms=["alpha"]))]
    for groups in ([Group(0, 0), Group(0, 1, 7)], [Group(0, 0), Group(0, 1, 2), Group(0, 2, 1)]):
        with pytest.raises(ValueError, match="no way up"):
            nested_matches(index, groups, clause)
    assert nested_matches(index, [Group(0, 0)], clause).count() == 0
    assert nested_matches(index, [Group(0, 0), Group(0, 1, 0)], [(1, Clause(0, 0, "must_not", terms=["alpha"]))]).count() == 0
