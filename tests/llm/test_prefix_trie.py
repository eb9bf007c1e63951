"""The conversation trie against a trie of nested dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from math import fmod

import pytest
from pyspark.sql import functions as F

from termloom.llm import prefix_trie
from termloom.llm.queries import trie_rows

ROWS = "conv_id long, turn long, role string, text string, depth string, first string, p1 string, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    original = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            original[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in original.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(fmod(c, 20)), [])[:h] + own[h:]
    return out


def brute(rows):
    nodes = defaultdict(list)
    full = rebuilt(rows)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for name in nodes:
        if name:
            kids[name[:-1]].append(name)
    out = set()
    for name, members in nodes.items():
        stack, leaves, saved = [name], 0, 0
        while stack:
            at = stack.pop()
            leaves += not kids[at]
            saved += (len(nodes[at]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", at[-1][1])) if at else 0)
            stack += kids[at]
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(name))
        out.add((min(members), len(name), min(nodes[name[:-1]]) if name else None, len(members), len(kids[name]), leaves,
                 saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], ROWS)


def found(conversations, **options):
    rows = trie_rows(conversations, **options).select(*COLUMNS).collect()
    assert len(rows) == len({(r.conv_id, r.depth) for r in rows})
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for c in range(0, 260):
        if c % 60 == 40:
            continue  # openers that are missing
        out += [(c, t, "user" if t % 2 == 0 else "bot", f"say {rng.randrange(2)} of\x0b{t} x") for t in range(rng.randrange(1, 6))]
    out += [(c, t, "user", f"hot {t} turn") for c in range(300, 400) for t in range(4)]
    # Nulls, ties, repeated rows, empty and very long texts, negative ids, one long conversation.
    out += [(400, None, None, None), (400, 1, "", ""), (401, None, "user", "a"), (401, None, "bot", "a"), (402, 0, "u", "b"), (402, 0, "u", "b")]
    out += [(None, 0, "user", "lost"), (403, 5, "user", "w " * 50_000), (404, 5, "user", None), (-5, 0, "user", "minus"), (-25, 1, "u", "two")]
    out += [(500 + k, t, "user", f"long {t}") for k in (0, 1, 2, 3) for t in range(90 + k)]
    return out


def test_equals_nested_dictionaries(spark, rows):
    want = brute(rows)
    assert found(frame(spark, rows)) == want
    assert any(n[3] >= 90 for n in want) and any(n[1] > 80 for n in want)


def test_spans_lists_and_hot_parents_are_cut(spark, rows, monkeypatch):
    assert found(frame(spark, rows), span=4, listed=3, children=2) == brute(rows)
    monkeypatch.setattr("termloom.llm.common.BROADCAST_BYTES", 0)
    few = [r for r in rows if r[0] is None or r[0] >= 250]
    assert found(frame(spark, few), span=7, listed=5, children=1) == brute(few)


def test_small_tables(spark):
    assert found(frame(spark, [(1, 0, "u", "x")]).limit(0)) == set()
    alone = [(c, 0, "u", "only turn") for c in range(1, 12)]
    assert found(frame(spark, alone)) == brute(alone)
    # A conversation that leaves out all its turns ends in the root.
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    trie = prefix_trie.prefix_trie(frame(spark, [(turnless, 0, "u", "x")]))
    assert [(r.depth, r.n_convs, r.n_ends) for r in trie.nodes.collect()] == [(0, 1, 1)]


def test_text_is_not_shuffled(spark, rows):
    trie = prefix_trie.prefix_trie(frame(spark, rows))
    assert "text" not in trie.nodes.columns
    parts = trie.ends.groupBy("depth", "p1", "p2").agg(F.sum(F.size("conv_ids")).alias("n"))
    assert parts.agg(F.sum("n")).first()[0] == len(rebuilt(rows))
