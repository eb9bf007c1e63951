"""Change folding against a sequential simulation, and the feed operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from termloom.operators import changes as C
from termloom.operators import events as E
from termloom.operators import joins as J
from termloom.operators.ordinals import rank_in_group
from termloom.plans.index import MemoryIndex, StoredIndex

EXTENSIONS = ["txt"]


def ok(path):
    return path.endswith(".txt")


def simulate(base, log, corpus):
    """Apply the log one change at a time."""
    state = dict(base)
    for _, op, path, old in log:
        loads = op in ("create", "modify", "rename") and ok(path)
        if loads and path not in corpus:
            continue
        if op == "delete":
            state.pop(path, None)
        if op == "rename" and ok(old):
            state.pop(old, None)
        if op in ("delete_dir", "rename_dir"):
            prefix = path if op == "delete_dir" else old
            state = {p: t for p, t in state.items() if not p.startswith(prefix)}
        if loads:
            state[path] = corpus[path]
        if op in ("rename_dir", "create_dir"):
            state.update({p: t for p, t in corpus.items() if ok(p) and (p == path or p.startswith(path + "/"))})
    return state


def random_log(seed, n, folders=("/a", "/ab", "/a/c", "/d")):
    rng = random.Random(seed)
    files = [f"{d}/{i}.{e}" for d in folders for i in range(4) for e in ("txt", "bin")]
    log = []
    for seq in range(n):
        op = rng.choice(["create", "modify", "delete", "rename", "delete_dir", "rename_dir", "create_dir"])
        place = folders if op.endswith("_dir") else files
        log.append((seq, op, rng.choice(place), rng.choice(place) if op.startswith("rename") else None))
    corpus = {f: f"now {f}" for f in files if rng.random() < 0.7}
    base = {f: f"then {f}" for f in files if ok(f) and rng.random() < 0.5}
    return base, log, corpus


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_sequential_application(spark, corpus_of, changes_of, seed):
    base, log, corpus = random_log(seed, 60)
    rows = changes_of(log).orderBy(F.rand(seed))  # input order does not matter
    now = corpus_of(corpus)
    good, bad = C.split_loadable(rows, now, EXTENSIONS)
    final = C.fold(corpus_of(base), good, now, EXTENSIONS)
    assert {r.path: r.content for r in final.collect()} == simulate(base, log, corpus)
    missing = {s for s, op, p, _ in log if op in ("create", "modify", "rename") and ok(p) and p not in corpus}
    assert {r.seq for r in bad.collect()} == missing


def test_fold_without_broadcasts(spark, corpus_of, changes_of, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_BYTES", -1)
    base, log, corpus = random_log(4, 60)
    now = corpus_of(corpus)
    good, _ = C.split_loadable(changes_of(log), now, EXTENSIONS)
    final = C.fold(corpus_of(base), good, now, EXTENSIONS)
    assert {r.path: r.content for r in final.collect()} == simulate(base, log, corpus)


@pytest.mark.parametrize("seed", [6, 7])
def test_few_changes_and_many_give_the_same(spark, corpus_of, changes_of, seed):
    base, log, corpus = random_log(seed, 60)
    now, then = corpus_of(corpus), corpus_of(base)
    rows, pinned = C.pin(changes_of(log))
    assert pinned
    good, bad = C.split_loadable(rows, now, EXTENSIONS, True)
    resolved = C.resolve(C.expand(good, EXTENSIONS), now, EXTENSIONS, True)
    other_good, other_bad = C.split_loadable(changes_of(log), now, EXTENSIONS)
    other = C.resolve(C.expand(other_good, EXTENSIONS), now, EXTENSIONS)
    for here, there in [
        (bad, other_bad), (good, other_good), (resolved.puts, other.puts),
        (resolved.deletes, other.deletes), (resolved.prefixes, other.prefixes),
        (C.touched(then, resolved), C.touched(then, other)), (C.content_of(now, resolved), C.content_of(now, other)),
    ]:
        assert here.columns == there.columns
        assert sorted(map(str, here.collect())) == sorted(map(str, there.collect()))


def test_pinned_changes_keep_times_and_nulls(spark):
    at = datetime(2024, 5, 1, 23, 30, 1, 250)
    rows = spark.createDataFrame(
        [(1, at, "delete", "/a", None), (2, None, None, None, "/b")],
        "seq long, ts timestamp, op string, path string, old_path string",
    )
    pinned, few = C.pin(rows)
    assert few and sorted(pinned.collect()) == sorted(rows.collect())
    assert C.pin(rows.limit(0))[0].collect() == []


def test_more_changes_than_the_limit_stay_distributed(spark, changes_of, monkeypatch):
    monkeypatch.setattr(C, "PUSHDOWN_LIMIT", 2)
    rows = changes_of([(i, "delete", f"/{i}") for i in range(3)])
    assert C.pin(rows) == (rows, False)


@pytest.mark.parametrize("limit", [-1, 64 << 20])
def test_splitting_by_keys_loses_none_and_needs_no_shuffle_of_the_table(spark, monkeypatch, limit):
    monkeypatch.setattr(J, "BROADCAST_BYTES", limit)
    table = spark.range(20_000).selectExpr("concat('/d/', id) AS path", "id AS content")
    keys = spark.range(0, 20_000, 10).selectExpr("concat('/d/', id) AS path")
    candidates, others = J.split_by_keys(table, keys, "path")
    found = {r.content for r in candidates.collect()}
    assert found >= set(range(0, 20_000, 10)) and len(found) < 2_100
    assert {r.content for r in others.collect()} == set(range(20_000)) - found
    for part in (candidates, others):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert J.holding(table, keys, "path", False).count() == 2_000
    assert J.without(table, keys, "path", False).count() == 18_000


def test_splitting_by_crowded_bitmaps_is_still_exact(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(J, "FILTER_BITS", 64)
    rows = [(None, 0), ("", 1), *[(f"/{i}", i) for i in range(2, 200)], ("/7", 200)]
    table = spark.createDataFrame(rows, "path string, content long")
    keys = spark.createDataFrame([(f"/{i}",) for i in range(0, 200, 7)] + [("",), ("/nowhere",)], "path string")
    wanted = {k.path for k in keys.collect()}
    held = sorted(r.content for r in J.holding(table, keys, "path", False).collect())
    assert held == [n for p, n in rows if p in wanted]
    left = sorted(r.content for r in J.without(table, keys, "path", False).collect())
    assert left == [n for p, n in rows if p not in wanted]
    none = keys.limit(0)
    assert J.holding(table, none, "path", False).count() == 0
    assert J.without(table, none, "path", False).count() == len(rows)


def test_cuts_that_are_no_prefix_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_BYTES", -1)
    rng = random.Random(3)
    paths = ["/" + "".join(rng.choice("ab/") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    prefixes = sorted({p[: rng.randint(1, len(p))].rstrip("/") or "/" for p in paths[:150]})
    here = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n int")
    there = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    split, seen = J.split_by_keys, {}

    def watch(table, keys, column):
        kept, others = split(table, keys, column)
        seen["cuts"], seen["kept"] = table.count(), kept.count()
        return kept, others

    monkeypatch.setattr(J, "split_by_keys", watch)
    hits = J.covered_by(here, there)
    expected = sorted((i, q) for i, p in enumerate(paths) for q in prefixes if p.startswith(q))
    assert sorted((r.n, r.prefix) for r in hits.collect()) == expected
    assert seen["kept"] <= len(expected) * 1.01 + 5 < seen["cuts"]


def test_batches_give_the_same_index_as_a_fresh_build(spark, tmp_path, corpus_of, changes_of):
    base, log, corpus = random_log(5, 40)
    now = corpus_of(corpus)
    index = StoredIndex.open(spark, str(tmp_path / "i")).build(corpus_of(base), buckets=2)
    for batch, (low, high) in enumerate([(0, 7), (7, 25), (25, 40)]):
        index = index.apply(changes_of(log[low:high]), now, EXTENSIONS, batch_id=batch).index
    fresh = MemoryIndex.build(corpus_of(simulate(base, log, corpus)))

    def entries(i):
        return {(r.term, r.path, r.tf, tuple(r.positions), r.dl) for r in i.postings_for().collect()}

    assert entries(index) == entries(fresh)
    assert (index.n_docs, index.n_tokens) == (fresh.n_docs, fresh.n_tokens)
    assert {tuple(r) for r in index.terms_for().collect()} == {tuple(r) for r in fresh.terms_for().collect()}


@pytest.mark.parametrize("old,new,expected", [
    ("x.txt", "y.txt", {("delete", "x.txt"), ("put", "y.txt")}), ("x.txt", "x.bin", {("delete", "x.txt")}),
    ("x.bin", "x.txt", {("put", "x.txt")}), ("x.bin", "y.bin", set()),
])
def test_rename_truth_table(changes_of, old, new, expected):
    rows = C.expand(changes_of([(1, "rename", new, old)]), EXTENSIONS).collect()
    assert {(r.action, r.path) for r in rows} == expected


def test_pending_and_prefix_counts(spark, corpus_of, changes_of):
    changes = changes_of([(1, "create", "a.txt"), (2, "create", "b.txt"), (3, "delete", "a.txt")])
    assert {(r.op, r.n) for r in C.pending(changes, 1).collect()} == {("create", 1), ("delete", 1)}
    docs = corpus_of({"/foo/1.txt": "", "/foo/2.txt": "", "/foobar/3.txt": ""})
    prefixes = spark.createDataFrame([("/foo",), ("/none",)], "prefix string")
    assert {tuple(r) for r in C.covered_counts(docs, prefixes).collect()} == {("/foo", 3), ("/none", 0)}
    assert {tuple(r) for r in C.covered_counts(docs, prefixes, True).collect()} == {("/foo", 2), ("/none", 0)}


START = datetime(2024, 1, 1)


def raw(spark, rows):
    full = [(i, START, kind, paths, is_dir) for i, (kind, paths, is_dir) in enumerate(rows)]
    return spark.createDataFrame(
        full, "seq long, ts timestamp, kind string, paths array<string>, is_dir boolean"
    )


def test_classify(spark):
    got = E.classify(raw(spark, [
        ("create", ["./a.txt", "b.txt"], False), ("create", ["d"], True), ("modify_data", ["a.txt"], None),
        ("modify_metadata", ["a.txt"], False), ("rename_both", ["./o.txt", "n.txt"], False),
        ("rename_both", ["o", "n"], True), ("rename_both", ["half.txt"], False), ("rename_from", ["h"], False),
        ("remove_file", ["r.txt"], False), ("remove_folder", ["r"], True), ("remove_any", ["r"], None),
    ])).collect()
    assert [(r.seq, r.op, r.path, r.old_path) for r in got] == [
        (0, "create", "a.txt", None), (0, "create", "b.txt", None), (1, "create_dir", "d", None),
        (2, "modify", "a.txt", None), (4, "rename", "n.txt", "o.txt"), (5, "rename_dir", "n", "o"),
        (6, "rename", None, "half.txt"), (8, "delete", "r.txt", None), (9, "delete_dir", "r", None),
    ]


def timed(spark, rows):
    full = [(i, START + timedelta(milliseconds=ms), path, f"op{i}") for i, (ms, path) in enumerate(rows)]
    return spark.createDataFrame(full, "seq long, ts timestamp, path string, op string")


def test_debounce_boundaries(spark):
    rows = [(0, "a"), (1000, "a"), (2001, "a"), (2500, "a"), (100, "b"), (900, "b"), (1950, "b")]
    got = {(r.path, r.n, r.seq) for r in E.debounce(timed(spark, rows)).collect()}
    assert got == {("a", 2, 1), ("a", 2, 3), ("b", 2, 5), ("b", 1, 6)}


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_batches_of_ten_or_idle(spark, blocks):
    rng = random.Random(blocks)
    at, rows = 0, []
    for _ in range(120):
        at += rng.choice([1, 50, 499, 500, 501, 2000]) if rng.random() < 0.3 else 20
        rows.append((at, "p"))
    want, group, last, size = {}, 0, None, 0
    for seq, (ms, _) in enumerate(rows):
        if last is None or ms - last > 500:
            group, size = group + 1, 0
        want[seq] = (group, size // 10)
        last, size = ms, size + 1
    got = {r.seq: (r.group_no, r.batch_no) for r in E.form_batches(timed(spark, rows), blocks=blocks).collect()}
    assert got == want
    burst = E.form_batches(timed(spark, [(0, "p")] * 25), blocks=blocks)
    assert sorted(r["count"] for r in burst.groupBy("group_no", "batch_no").count().collect()) == [5, 10, 10]


def test_snapshot_diff_pairs_copies_in_order(spark):
    same = [(f"/old/{i:02d}", "h") for i in range(30)]
    before = spark.createDataFrame([*same, ("/keep", "k"), ("/edit", "e1"), ("/gone", "g")], "path string, hash string")
    moved = [(f"/new/{i:02d}", "h") for i in range(20)]
    after = spark.createDataFrame([*moved, ("/keep", "k"), ("/edit", "e2"), ("/fresh", "f")], "path string, hash string")
    got = {tuple(r) for r in E.snapshot_diff(before, after, blocks=5).collect()}
    assert got == (
        {("rename", f"/new/{i:02d}", f"/old/{i:02d}") for i in range(20)}
        | {("delete", f"/old/{i:02d}", None) for i in range(20, 30)}
        | {("modify", "/edit", None), ("create", "/fresh", None), ("delete", "/gone", None)}
    )


def test_ranks_cross_blocks(spark):
    rows = spark.range(200).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 7)) AS g", "id")
    got = rank_in_group(rows, ["g"], ["id"], "n", blocks=9).collect()
    by_group = {}
    for r in sorted(got, key=lambda r: r.id):
        by_group.setdefault(r.g, []).append(r.n)
    assert all(ns == list(range(1, len(ns) + 1)) for ns in by_group.values()) and len(got) == 200


def test_debounce_splits_a_busy_path(spark):
    """Bursts over block borders are the same as in one task."""
    rows = [(i * 400 + (5000 if i >= 300 else 0) + (9000 if i >= 500 else 0), "/busy") for i in range(700)]
    rows += [(i * 3000, f"/p{i % 3}") for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted((r.path, r.first_ts, r.n, r.seq) for r in E.debounce(timed(spark, rows)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
    assert [n for p, _, n, _ in got[0] if p == "/busy"] == [300, 200, 200]


@pytest.mark.parametrize("room,bits", [(64 << 20, 1 << 29), (20_000, 1 << 17)])
def test_content_is_not_shuffled_to_meet_many_keys(spark, monkeypatch, room, bits):
    """By hashes, and by bitmaps that take some rows in wrongly; null is no key."""
    monkeypatch.setattr(J, "BROADCAST_BYTES", room)
    monkeypatch.setattr(J, "FILTER_BITS", bits)
    rows = [(f"/{i}", i) for i in range(4_000)] + [("/0", -1), ("/1", -2), (None, -3)]
    table = spark.createDataFrame(rows, "path string, content long")
    keys = spark.createDataFrame([(f"/{i}",) for i in range(0, 4_000, 2)] + [("/0",), ("/none",), (None,)], "path string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        held = J.holding(table, keys, "path", False)
        content_side = held._jdf.queryExecution().executedPlan().toString().split("LocalTableScan")[0].split("Scan Existing")[0]
        assert "SortMergeJoin" not in content_side and "BroadcastHashJoin" in content_side
        assert sorted(r.content for r in held.collect()) == [-1, *range(0, 4_000, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_copies_of_labelled_documents_need_no_shuffle_of_content(spark, tmp_path, monkeypatch):
    from termloom.plans import bindings as B

    docs = [(1, "a", "s", "en"), (1, "a", "s", "en"), (2, "b", "s", None), (3, None, "s", "en"), (4, "d", "t", "en"), (None, "e", "s", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,), (None,)], "doc_id long")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    plain = ["/s/en/1.md", "/s/en/1.md", "/s/en/3.txt", "/t/en/4.md", None, None]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for room in (64 << 20, 96):
        monkeypatch.setattr(J, "BROADCAST_BYTES", room)
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            corpus = B.current_corpus(spark, str(tmp_path))
            assert "SortMergeJoin" not in corpus._jdf.queryExecution().executedPlan().toString()
            found = sorted((r.path or "", r.content) for r in corpus.collect())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert [p for p, _ in found if p.startswith("/moved")] == ["/moved/s/en/1.md", "/moved/s/en/1.md", "/moved/s/en/3.txt"]
        assert len(found) == 9 and [p for p, _ in found if not p.startswith("/moved")] == sorted(p or "" for p in plain)
