"""Near-duplicate groups and top-k search against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from termloom.llm import near_dedup, topk
from termloom.llm.components import components
from termloom.llm.shingles import Shingler, similar


def shingle_set(text, words):
    tokens = (text or "").encode().lower().split()
    n = min(words, len(tokens))
    return {tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def brute_components(rows, words, percent=80):
    sets = {d: shingle_set(t, words) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def variants(rng, base, count, edits):
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(120)]
        texts += variants(rng, base, 9, 6)
    hot = [f"hot{rng.randrange(300)}" for _ in range(150)]
    texts += variants(rng, hot, 150, 7)
    texts += [" ".join(hot[:60] + [f"t{i}x{j}" for j in range(60)]) for i in range(10)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_equal_brute_force(spark, docs_of, corpus, edge_rows):
    extra = [(1000 + i, t) for i, (_, t) in enumerate(edge_rows)] + [(2000, corpus[3][1]), (2001, corpus[3][1].upper())]
    rows = corpus + extra
    got = near_dedup.near_duplicates(docs_of(rows, clashing=True), words=4, chunk=16).collect()
    want = brute_components(rows, 4)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(shingle_set(t, 4)) for d, t in rows}


def test_groups_with_null_and_repeated_ids(spark, docs_of, corpus):
    text = corpus[0][1]
    rows = [(None, text), (5, text), (5, text), (3, text + " tail"), (9, None), (8, "")]
    docs = docs_of(rows, clashing=True)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == Counter({(None, None, True): 1, (5, 3, False): 2, (3, 3, True): 1, (9, 9, True): 1, (8, 8, True): 1})
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 8, 9]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_drop_goes_by_rows_not_by_ids(spark, docs_of, corpus):
    text = corpus[0][1]
    unlike = " ".join(f"own{i}" for i in range(50))
    rows = [(3, text), (3, text), (5, text), (5, unlike), (3, text.upper()), (7, text + " tail"), (None, text), (None, unlike)]
    kept = near_dedup.drop_near_duplicates(docs_of(rows, clashing=True)).collect()
    left = Counter((r.doc_id, (r.text or "").lower()) for r in kept)
    assert left == Counter({(3, text.lower()): 1, (5, unlike): 1, (None, text.lower()): 1, (None, unlike): 1})


@pytest.mark.parametrize("rounds", [(), (1,), (1, 2, 3, 4, 5, 6)])
def test_rounds_give_the_same_groups(spark, docs_of, corpus, rounds):
    got = near_dedup.near_duplicates(docs_of(corpus[:120]), rounds=rounds).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(corpus[:120], 5)


def test_a_group_of_near_copies_is_confirmed_once(spark, docs_of, monkeypatch):
    rng = random.Random(4)
    rows = list(enumerate(variants(rng, [f"hot{i}" for i in range(200)], 400, 3)))
    tested = []
    confirmed = near_dedup.confirmed

    def counting(docs, pairs, *options):
        tested.append(pairs.count())
        return confirmed(docs, pairs, *options)

    monkeypatch.setattr(near_dedup, "confirmed", counting)
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(tested) < 2 * len(rows), tested


def test_without_broadcast(spark, docs_of, corpus, monkeypatch):
    monkeypatch.setattr("termloom.llm.common.BROADCAST_BYTES", 0)
    rows = corpus[:60]
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 5)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 60)] + [(-4, -9)]
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in root} and len(got) == len(root)


def test_shingles_and_similarity():
    assert [len(Shingler(4)(t)) for t in (None, "", " \n", "a", "a b c", "a b c d", "a b c d e", "a a a a a a")] == [0, 0, 0, 1, 1, 1, 2, 1]
    assert (Shingler(4)("A b\tC\x0bd") == Shingler(4)("a B c d")).all() and (Shingler(4)("É b c d") != Shingler(4)("é b c d")).all()
    a, b = np.arange(100, dtype=np.uint64), np.arange(11, 100, dtype=np.uint64)
    assert similar(a, b, 80) and similar(a, b, 89) and not similar(a, b, 90) and not similar(a, b[:0], 80)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, v string, norm string, score string"


def brute_top(rows, every, k=5):
    whole = []
    for vec_id, vector in rows:
        if vec_id is None or not vector or any(x is None or not np.isfinite(np.float32(x)) for x in vector):
            continue
        whole.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    out = Counter()
    for q in {i for i, _ in whole if i % every == 0}:
        scores = [
            (-sum(x * y for x, y in zip(a, b, strict=True)), c)
            for i, a in whole if i == q for c, b in whole if c != q and len(a) == len(b)
        ]
        out.update((q, rank + 1, c, -s) for rank, (s, c) in enumerate(sorted(scores)[:k]))
    return out


@pytest.mark.parametrize(("every", "block"), [(7, 8 << 20), (2, 20_000)])
def test_topk_equals_brute_force(spark, every, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=12) * rng.choice([0.01, 0.5, 3])]) for i in range(400)]
    rows += [(i, [1.0] * 12) for i in range(400, 430)] + [(i, [0.0] * 12) for i in range(430, 440)]
    rows += [(448, None), (455, []), (462, [float("nan")] + [1.0] * 11), (469, [None] + [1.0] * 11), (476, [float("inf")] * 12)]
    rows += [(None, [1.0] * 12), (7, rows[7][1]), (14, [-9.0] * 12), (1, [9.0] * 12), (1, [9.0] * 12), (490, [1.0, 2.0]), (497, [2.0, 1.0]), (504, [3.0])]
    rows += [(511, [3.0e38] * 12), (518, [-3.0e38] * 12)]
    table = spark.createDataFrame([(i, v, 0, "v", "n", "s") for i, v in rows], EMBEDDINGS)
    small = [r for r in rows if r[0] not in (511, 518)]
    got = topk.search(table.filter("vec_id is null or vec_id not in (511, 518)"), every=every, block_bytes=block).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(small, every)
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})
    # Beyond the range of a long a score is cut to it.
    huge = [r.score for r in topk.search(table, every=7, block_bytes=block).collect() if r.query_id == 511]
    assert len(huge) == 5 and huge[0] == 2**63 - 1


def test_topk_of_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0], 0, "", "", ""), (1, [2.0], 0, "", "", "")], EMBEDDINGS)
    assert [tuple(r) for r in topk.search(table).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.search(table.limit(0)).count() == 0
