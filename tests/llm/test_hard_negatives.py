"""Hard negatives against brute force."""

from collections import Counter

import numpy as np
import pytest

from termloom.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, row string, block string, anchor string"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    whole = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or not vector or any(x is None or not np.isfinite(np.float32(x)) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        whole.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in vector], label))
    out = Counter()
    for a, v, label in whole:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, w, m in whole if i != a and len(w) == len(v))
        for minus, p, _ in [s for s in scored if s[2] == label][:positives]:
            band = [s for s in scored if s[2] != label and -low * minus <= -100 * s[0] <= -high * minus]
            for rank, (score, n, _) in enumerate(band[:negatives], 1):
                out[a, p, rank, n, -minus, -score] += 1
    return out


def mined(table, **options):
    found = hard_negatives.mine(table, hard_negatives.changed_label(), **options).collect()
    return Counter(
        (r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found
    )


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 12))
    out = []
    for i in range(600):
        label = int(rng.integers(10)) if i % 3 else 4
        vector = (centres[label] + rng.normal(size=12)) * rng.choice([0.02, 0.4, 2])
        out.append((i, [float(x) for x in vector], label))
    out += [(i, [1.0] * 12, i % 10) for i in range(600, 640)] + [(i, [0.0] * 12, i % 2) for i in range(640, 660)]
    # Repeated ids, repeated rows, other dimensions, and what takes no part.
    out += [out[100], (200, [0.5] * 12, 3), (7, out[7][1], 2), out[301], out[301]]
    out += [(700, [1.0, 2.0], 1), (701, [2.0, 1.0], 1), (702, [1.0, 1.0], 2), (800, [3.0], 5), (900, [0.0] * 12, 1)]
    out += [(1000, None, 1), (1100, [], 1), (1200, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    return out + [(1300, [float("nan")] + [1.0] * 11, 1), (1400, [None] + [1.0] * 11, 1), (1500, [float("inf")] * 12, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, m, "r", "b", "a") for i, v, m in rows], ROWS)


@pytest.mark.parametrize(("every", "options"), [
    (100, {}), (10, {"bucket_rows": 16, "block_bytes": 8_000}), (20, {"bucket_rows": 5, "focus": 12, "positives": 3}),
    (10, {"low": -50, "high": 100, "negatives": 3, "bucket_rows": 64}),
])
def test_equals_brute_force(spark, rows, every, options):
    limits = {k: v for k, v in options.items() if k in ("positives", "negatives", "low", "high")}
    got, want = mined(frame(spark, rows), every=every, **options), brute(rows, every, **limits)
    assert got == want and len(want) > 50


def test_huge_and_few_rows(spark):
    big = [(0, [3.0e38] * 4, 1), (100, [2.9e38] * 4, 1), (1, [1.0] * 4, 1), (2, [1.0e38] * 4, 2), (3, [0.1] * 4, 2)]
    got = mined(frame(spark, big))
    assert all(-(2**63) <= k[4] < 2**63 for k in got)
    large = [(100, [2.0e10] * 4, 1), (1, [1.0e8, 1.0e8, 1.0e8, 0.0], 1), (2, [1.0e7] * 4, 2), (3, [9.0e7] * 4, 3)]
    assert mined(frame(spark, large)) == brute(large)
    assert mined(frame(spark, [(0, [1.0], 1), (1, [2.0], 1)])) == Counter()
    assert mined(frame(spark, big).limit(0)) == Counter()


def test_ranges_drop_no_row_and_drop_some():
    rng = np.random.default_rng(3)
    matrix = np.floor(256 * rng.normal(size=(500, 8)) * rng.choice([0.1, 1], size=(500, 1)))
    made = hard_negatives.buckets(np.arange(500), np.zeros(500, int), matrix, 100)
    visited = 0
    for q in matrix[:40]:
        anchor = hard_negatives.Anchor(-1, q, 4)
        theta = float(np.sort(matrix @ q)[-6])
        for bucket in made:
            rows = bucket.candidates(anchor.unit, anchor.focus, anchor.length, theta)
            reached = np.flatnonzero(bucket.matrix @ q >= theta)
            assert set(reached) <= set(rows)
            visited += len(rows)
    assert visited < 0.4 * 40 * 500
