"""Passage removal against brute force."""

import random
import re
from collections import Counter

import pytest

from termloom.llm import substring_dedup


def brute(rows, window=13):
    low = -(2**63)
    split = [(low if d is None else d, d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for owner, _, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            least[key] = min(owner, least.get(key, owner))
    out = Counter()
    for owner, doc_id, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i:i + window])] < owner:
                gone |= set(range(i, i + window))
        out[doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)] += 1
    return out


def removed(docs, **options):
    rows = substring_dedup.remove_repeats(docs, **options).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    passages = [[f"p{k}w{rng.randrange(60)}" for _ in range(rng.randrange(13, 70))] for k in range(12)]
    out = []
    for i in range(160):
        words = own(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a:a + rng.randrange(5, 70)] + own(rng.randrange(20))
        out.append((i, " ".join(words)))
    phrase = [f"common{j}" for j in range(6)]
    out += [(200 + i, " ".join([*own(15), *phrase, *own(15), *passages[0][:20], "x", *passages[0][:20]])) for i in range(80)]
    # Copies, a letter in upper case, other blanks, one word repeated, twelve words, repeated ids.
    out += [(1000 - i, out[3][1]) for i in range(30)] + [(400, out[200][1].upper()), (401, out[200][1].replace(" ", "\x0b\n"))]
    out += [(402 + i, "again " * (10 + i)) for i in range(8)] + [(420, " ".join(passages[1][:12])), (421, " ".join(passages[1][:12]))]
    out += [(3, out[7][1]), (3, out[7][1]), (3, out[5][1]), (None, " ".join(passages[2])), (None, " ".join(passages[2]))]
    return out


@pytest.mark.parametrize("options", [{}, {"group": 3}, {"group": 1, "piece": 3}, {"window": 6, "piece": 6}])
def test_equals_brute_force(spark, docs_of, rows, edge_rows, options):
    rows = rows + [(None if d is None else 5000 + d, t) for d, t in edge_rows]
    assert removed(docs_of(rows, clashing=True), **options) == brute(rows, options.get("window", 13))


def test_without_broadcast(spark, docs_of, rows, monkeypatch):
    monkeypatch.setattr("termloom.llm.common.BROADCAST_BYTES", 0)
    assert removed(docs_of(rows), group=20) == brute(rows)


def test_empty_table(spark, docs_of):
    assert substring_dedup.remove_repeats(docs_of([(1, "x")]).limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    anchors = substring_dedup.Anchors(13, 5)
    rng = random.Random(1)
    passage = [b"%d" % rng.randrange(40) for _ in range(40)]

    def suffixes_of(words):
        out = []
        for _, at, first, last in zip(*anchors(words), strict=True):
            out += substring_dedup.suffixes(at - first, words[first:last + 13], 13)
        return out

    here = suffixes_of(passage)
    assert len(here) == 28
    for k in (1, 7, 20):
        assert suffixes_of([b"z"] * k + passage)[k:] == here
