"""Exact and line deduplication against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest

from termloom.llm import exact_dedup, line_dedup
from termloom.llm.common import ready_workers

SPACE = " \t\n\x0b\x0c\r"


def low(n):
    return -(2**63) if n is None else n


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_decisions(spark, docs_of, edge_rows, counters):
    rows = edge_rows + [(i, "the same text") for i in range(100, 140)] + [(i, f"own {i}") for i in range(200, 230)]
    got = exact_dedup.decide(docs_of(rows, clashing=True), counters).collect()
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    want = Counter()
    for ids in groups.values():
        best = max(ids, key=low)
        for place, doc_id in enumerate(sorted(ids, key=low)):
            want[(doc_id, best, len(ids), place == len(ids) - 1)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    digests = {r.doc_id: bytes(r.digest) for r in got if r.doc_id == 6}
    assert digests[6] == hashlib.sha256(b"one two three four five six seven").digest()


def test_misra_gries_keeps_every_frequent_digest():
    stream = ["a"] * 40 + [f"x{i}" for i in range(100)] + ["b"] * 30
    total = Counter()
    for i in range(0, len(stream), 7):
        total = exact_dedup.merged(total + Counter(stream[i:i + 7]), 6)
    assert {"a", "b"} <= set(total) and len(total) <= 6
    assert 40 - len(stream) / 7 <= total["a"] <= 40


def test_drop_copies_keeps_one_row_of_each_text(spark, docs_of, edge_rows):
    docs = docs_of(edge_rows, clashing=True)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter({t or "": 1 for _, t in edge_rows})


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "x")]).limit(0)
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def brute_lines(rows, min_chars=20, min_documents=3):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = [(d, t or "", [x.strip(SPACE).translate(upper) for x in (t or "").split("\n")]) for d, t in rows]
    holders = defaultdict(set)
    for doc_id, text, keys in keyed:
        for key in keys:
            holders[key].add(doc_id if doc_id is not None else ("text", text))
    out = Counter()
    for doc_id, text, keys in keyed:
        gone = 0
        kept = []
        for line, key in zip(text.split("\n"), keys, strict=True):
            known = [h for h in holders[key] if isinstance(h, int)]
            repeated = len(key) >= min_chars and len(holders[key]) >= min_documents and known
            if repeated and (doc_id is None or doc_id < max(known)):
                gone += 1
            else:
                kept.append(line)
        out[(doc_id, len(keys), gone, "\n".join(kept))] += 1
    return out


def test_lines_against_brute_force(spark, docs_of, edge_rows):
    shared = "The licence line that many documents hold."
    rows = edge_rows + [(i, f"{shared}\n\nown line number {i} of this text\n\t{shared.upper()} \n") for i in range(50, 70)]
    rows += [(None, f"{shared}\nno id"), (80, "ÉCOLE Ünïcode line of this corpus"), (81, "École Ünïcode line of this corpus"),
             (82, "école Ünïcode LINE of this corpus"), (83, "ÉCOLE ünïcode line of this corpus"), (84, "ÉcoLe Ünïcode line OF this corpus")]
    got = line_dedup.dedup_lines(docs_of(rows, clashing=True)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == brute_lines(rows)


def test_lines_without_broadcast(spark, docs_of, monkeypatch):
    monkeypatch.setattr("termloom.llm.common.BROADCAST_BYTES", 0)
    rows = [(i, "\n".join(f"sentence number {(i * j) % 7} of this corpus" for j in range(9))) for i in range(40)]
    got = line_dedup.dedup_lines(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == brute_lines(rows)
    copies = exact_dedup.drop_copies(docs_of([*rows, (99, rows[0][1])]))
    assert copies.count() == len({t for _, t in rows})


def test_line_plan_has_no_python(spark, docs_of):
    plan = line_dedup.dedup_lines(docs_of([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ready_workers_keeps_a_chosen_size(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "77")
        ready_workers(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)
