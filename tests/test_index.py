import re
import time
import uuid

import pytest

from termloom.operators.clauses import Clause
from termloom.plans import index as I
from termloom.plans.index import CommitConflict, MemoryIndex, StoredIndex
from termloom.plans.search import search

EXTENSIONS = ["txt"]


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


@pytest.fixture(params=["memory", "stored"])
def build(request, spark, root):
    def make(corpus, extensions=None):
        if request.param == "memory":
            return MemoryIndex.build(corpus, extensions)
        return StoredIndex.open(spark, root).build(corpus, extensions, buckets=3)

    return make


def found(index, word):
    return {r.path for r in search(index, [Clause(0, 0, terms=[word])], k=100).collect()}


def test_search_finds_the_file(build, corpus_of):
    assert found(build(corpus_of({"/sea/tide.txt": "low tide at noon"})), "tide") == {"/sea/tide.txt"}


def test_replace_and_delete(build, corpus_of, changes_of):
    index = build(corpus_of({"tide.txt": "low tide", "wind.txt": "calm"}))
    newer = corpus_of({"tide.txt": "high tide rising at the old pier", "wind.txt": "calm"})
    index = index.apply(changes_of([(1, "modify", "tide.txt")]), newer, EXTENSIONS).index
    assert found(index, "rising") == {"tide.txt"} == found(index, "tide") and found(index, "low") == set()
    assert (index.n_docs, index.n_tokens) == (2, 8)
    assert {r.term: r.df for r in index.terms_for().collect()}["tide"] == 1
    index = index.apply(changes_of([(2, "delete", "tide.txt"), (3, "delete", "x.bin")]), newer, EXTENSIONS).index
    assert found(index, "tide") == set()
    assert (index.n_docs, index.n_tokens) == (1, 1)


def test_prefix_delete(build, corpus_of, changes_of):
    index = build(corpus_of({
        "/bay/a.txt": "gull one", "/bay/b.txt": "gull two", "/bayside/c.txt": "gull", "/hill.txt": "gull",
    }))
    after = index.apply(changes_of([(1, "delete_dir", "/bay")]), corpus_of({"/hill.txt": "gull"}), EXTENSIONS).index
    assert found(after, "gull") == {"/hill.txt"}
    assert found(index, "gull") == {"/bay/a.txt", "/bay/b.txt", "/bayside/c.txt", "/hill.txt"}


FILES = {
    "gull.txt": "white gull", "tern.txt": "grey gull", "crow.md": "black gull",
    "/cliff/auk.txt": "small gull", "/cliff/skua.txt": "brown gull", "/cliff/raven.md": "loud gull",
}
KEPT = {p for p in FILES if p.endswith(".txt")}
NESTS = {"/rock/auk.txt": "small gull", "/rock/skua.txt": "brown gull", "/rock/new.md": "gull"}


@pytest.mark.parametrize("change,now,word,expected", [
    (None, {}, "gull", KEPT),
    ((1, "create", "swan.txt"), {"swan.txt": "mute swan"}, "swan", {"swan.txt"}),
    ((1, "modify", "tern.txt"), {"tern.txt": "arctic tern"}, "gull", KEPT - {"tern.txt"}),
    ((1, "delete", "gull.txt"), {}, "gull", KEPT - {"gull.txt"}),
    ((1, "rename", "kittiwake.txt", "gull.txt"), {"kittiwake.txt": "white gull"}, "gull",
     KEPT - {"gull.txt"} | {"kittiwake.txt"}),
    ((1, "delete_dir", "/cliff"), {}, "gull", {"gull.txt", "tern.txt"}),
    ((1, "rename_dir", "/rock", "/cliff"), NESTS, "gull",
     {"gull.txt", "tern.txt", "/rock/auk.txt", "/rock/skua.txt"}),
])
def test_changes_reach_the_index(build, corpus_of, changes_of, change, now, word, expected):
    index = build(corpus_of(FILES), EXTENSIONS)
    if change:
        index = index.apply(changes_of([change]), corpus_of(now or {"-": ""}), EXTENSIONS).index
    assert found(index, word) == expected


def test_documents_without_tokens_count(build, corpus_of):
    index = build(corpus_of({"a.txt": "", "b.txt": "one two"}))
    assert (index.n_docs, index.n_tokens) == (2, 2)
    assert {(r.path, r.dl) for r in index.docs.collect()} == {("a.txt", 0), ("b.txt", 2)}


def test_snapshots_replay_and_conflict(spark, root, corpus_of, changes_of):
    first = StoredIndex.open(spark, root).build(corpus_of({"a.txt": "one"}), buckets=2)
    now = corpus_of({"a.txt": "two", "b.txt": "one"})
    changes = changes_of([(1, "modify", "a.txt"), (2, "create", "b.txt"), (3, "create", "gone.txt"), (4, "chmod", "a.txt")])
    second = first.apply(changes, now, EXTENSIONS, batch_id=0, stream="s").index
    assert found(first, "one") == {"a.txt"}  # pinned
    assert found(second, "one") == {"b.txt"} and found(first.refresh(), "two") == {"a.txt"}
    aside = {("gone.txt", "not in corpus"), ("a.txt", "unknown operation")}
    assert {(r.path, r.reason) for r in second.quarantine().collect()} == aside
    again = second.apply(changes, now, EXTENSIONS, batch_id=0, stream="s").index
    assert again.snapshot == second.snapshot
    assert second.apply(changes.limit(0), now, EXTENSIONS).index.snapshot == second.snapshot
    with pytest.raises(CommitConflict):
        first.apply(changes, now, EXTENSIONS)
    small = second.compact(buckets=1)
    assert found(small, "one") == {"b.txt"} and found(small, "two") == {"a.txt"}
    assert (small.n_docs, small.n_tokens) == (second.n_docs, second.n_tokens) == (2, 2)
    assert len(small.snapshot.segments) == 1
    small.vacuum()
    rebuilt = small.build(now)
    for index in (small, rebuilt):  # what was set aside outlives a rewrite and a rebuild
        assert {(r.path, r.reason) for r in index.quarantine().collect()} == aside
    with pytest.raises(ValueError):
        StoredIndex.open(spark, root, snapshot=99)


def test_no_batch_is_lost(spark, root, corpus_of, changes_of):
    now = corpus_of({"a.txt": "one", "b.txt": "two", "c.txt": "three", "d.txt": "four"})
    index = StoredIndex.open(spark, root).build(corpus_of({"a.txt": "one"}))
    index = index.apply(changes_of([(7, "create", "b.txt")]), now, EXTENSIONS, batch_id=7, stream="first").index
    # A second stream counts its own batches.
    index = index.apply(changes_of([(8, "create", "c.txt")]), now, EXTENSIONS, batch_id=0, stream="second").index
    assert {r.path for r in index.docs.collect()} == {"a.txt", "b.txt", "c.txt"}
    # After a rebuild every stream starts anew, also one with a new checkpoint.
    index = index.build(corpus_of({"a.txt": "one"}))
    index = index.apply(changes_of([(9, "create", "d.txt")]), now, EXTENSIONS, batch_id=0, stream="first").index
    assert {r.path for r in index.docs.collect()} == {"a.txt", "d.txt"}
    # A true replay changes nothing.
    again = index.apply(changes_of([(9, "delete", "d.txt")]), now, EXTENSIONS, batch_id=0, stream="first").index
    assert again.snapshot == index.snapshot


def test_vacuum_keeps_the_latest_snapshot(spark, root, corpus_of, changes_of):
    index = StoredIndex.open(spark, root).build(corpus_of({"a.txt": "one"}), buckets=2)
    index = index.apply(changes_of([(1, "modify", "a.txt")]), corpus_of({"a.txt": "two"}), EXTENSIONS).index
    index = index.compact(buckets=1)
    index.vacuum()
    assert found(StoredIndex.open(spark, root), "two") == {"a.txt"}
    with pytest.raises(ValueError):
        StoredIndex.open(spark, root, snapshot=1)


@pytest.mark.parametrize("size,expected", [
    (0, (1, 16, 16)), (1 << 20, (1, 16, 16)), (1 << 40, (1, 1024, 1024)), (20 << 40, (2, 4096, 10240)), (100 << 40, (6, 4096, 17067)),
])
def test_layout_follows_the_text(size, expected):
    layout = I.layout_for(size)
    assert (layout.parts, layout.buckets, layout.tasks) == expected and layout.tasks <= 20_000


def test_layout_is_not_taken_from_a_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    joined = docs.join(labels, "doc_id", "left")
    assert I.layout_for(I.input_bytes(joined)) == I.layout_for(I.input_bytes(docs))
    assert I.input_bytes(joined) < 2 * I.input_bytes(docs)
    rows = spark.sparkContext.parallelize([("a", "x" * 1000)] * 50).toDF(["path", "content"])
    assert I.input_bytes(rows) == 50_000  # measured, since Spark does not know


def test_a_large_build_makes_several_segments(spark, root, corpus_of, monkeypatch):
    monkeypatch.setattr(I, "SEGMENT_BYTES", 100)
    files = {f"{i}.txt": f"word{i % 7} gull" for i in range(40)}
    index = StoredIndex.open(spark, root).build(corpus_of(files))
    assert len(index.snapshot.segments) > 1 and (index.n_docs, index.n_tokens) == (40, 80)
    assert {r.term: r.df for r in index.terms_for().collect()}["gull"] == 40
    assert found(index, "word3") == {f"{i}.txt" for i in range(40) if i % 7 == 3}


def test_a_large_rewrite_makes_several_segments(spark, root, corpus_of, changes_of, monkeypatch):
    files = {f"{i}.txt": f"word{i % 7} gull" for i in range(40)}
    corpus = corpus_of(files)
    index = StoredIndex.open(spark, root).build(corpus)
    index = index.apply(changes_of([(0, "delete", "3.txt"), (1, "modify", "10.txt")]), corpus, ["txt"]).index
    assert len(index.snapshot.segments) == 2 and (index.n_docs, index.n_tokens) == (39, 78)
    monkeypatch.setattr(I, "SEGMENT_BYTES", 200)
    index = index.compact()
    assert len(index.snapshot.segments) == 4 and (index.n_docs, index.n_tokens) == (39, 78)
    assert not any(s.tombstones for s in index.snapshot.segments)
    assert {r.term: r.df for r in index.terms_for().collect()}["gull"] == 39
    assert found(index, "word3") == {f"{i}.txt" for i in range(40) if i % 7 == 3 and i != 3}


def test_a_closed_memory_index_holds_no_memory(corpus_of, changes_of):
    corpus = corpus_of({"a.txt": "gull tern", "b.txt": "gull"})
    first = I.MemoryIndex.build(corpus)
    second = first.apply(changes_of([(0, "delete", "a.txt")]), corpus, ["txt"]).index
    held = [*second._layers, *second._ended]
    assert all(rows.storageLevel.useMemory for rows in held)
    second.close()
    assert not any(rows.storageLevel.useMemory for rows in held)
    assert second.docs.count() == 1 and first.docs.count() == 2


def test_a_hot_term_is_split_and_changes_use_many_tasks(spark, root, corpus_of, changes_of):
    """Every document holds one word; its postings must not all be in one file."""
    keys = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.files.openCostInBytes": "1k", "spark.sql.files.maxPartitionBytes": "64k",
    }
    before = {k: spark.conf.get(k) for k in keys}
    files = {f"/{i}.txt": " ".join(f"rare{(i * 31 + j) % 3000}" for j in range(20)) + " common" * 3 for i in range(3000)}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        corpus = corpus_of(files).repartition(12).cache()
        index = StoredIndex.open(spark, root).build(corpus)
        home = f"{root}/postings/{index.snapshot.segments[0].folder}"
        from pyspark.sql import functions as F

        written = spark.read.parquet(home)
        spread = written.filter("term = 'common'").select(F.input_file_name()).distinct().count()
        assert spread >= 4
        sizes = sorted(r.n for r in written.groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).agg(
            F.sum(F.octet_length("path") + F.octet_length("term") + 4 * F.size("positions")).alias("n")).collect())
        assert sizes[-1] <= 3 * max(sizes[len(sizes) // 2], 16_000)
        changed = index.apply(changes_of([(i, "modify", p) for i, p in enumerate(files)]), corpus, EXTENSIONS).index
        added = spark.read.parquet(f"{root}/postings/{changed.snapshot.segments[-1].folder}")
        assert len(added.inputFiles()) >= 0.5 * len(written.inputFiles())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_many_clauses_are_pruned_like_few(spark, root, corpus_of):
    index = StoredIndex.open(spark, root).build(corpus_of({"a.txt": "gull tern", "b.txt": "gull auk"}), buckets=64)
    for n in (2, 300):
        plan = search(index, [Clause(q, 0, terms=["gull"]) for q in range(n)])._jdf.queryExecution().toString()
        scans = [line for line in plan.split("\n") if "FileScan" in line and "tf:int" in line]
        assert scans and all(re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = ", s) for s in scans), n
        assert all(re.search(r"PushedFilters: \[[^]]*EqualTo\(term,gull\)", s) for s in scans), n


@pytest.mark.parametrize("size,tasks", [(1 << 30, 64), (6 << 30, 384), (16 << 30, 1024), (100 << 30, 1024)])
def test_partitions_of_a_build_are_small_enough_to_sort(size, tasks):
    """Many fine partitions while they are few, whatever adaptive execution makes of them."""
    assert I.layout_for(size) == I.Layout(1, tasks, tasks)


def test_postings_go_straight_to_few_partitions(spark, root, corpus_of, monkeypatch):
    """More than 200 partitions make every task sort and spill its postings before they are shuffled."""
    assert [I.shuffled_parts(spark, n) for n in (16, 200, 384, 1024, 20_000)] == [16, 200, 200, 1024, 20_000]
    monkeypatch.setattr(I, "FINE_BYTES", 15)
    key, context = "spark.sql.adaptive.coalescePartitions.enabled", spark.sparkContext
    before = spark.conf.get(key)
    files = {f"{i}.txt": f"word{i} gull" for i in range(400)}
    corpus = corpus_of(files).coalesce(2)
    tasks = I.layout_for(I.input_bytes(corpus)).tasks
    assert 200 < tasks < I.FINE_TASKS
    try:
        spark.conf.set(key, "false")
        context.setJobGroup("few", "few")
        index = StoredIndex.open(spark, root).build(corpus, buckets=3)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert I.shuffled_parts(spark, 384) == 384  # nothing would cut large partitions
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds]
    sizes = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
    assert 200 in sizes and tasks not in sizes  # as the layout says, but for the shuffles
    assert index.docs.count() == 400 and found(index, "word7") == {"7.txt"}


def test_shuffle_files_go_with_the_write_they_are_for(spark, root, corpus_of, changes_of):
    """Without waiting for the driver to collect its garbage; a later write needs no disk for them."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    first = spark.sparkContext._jsc.sc().newShuffleId()

    def shuffled():
        files = disk.getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return [n for n in names if n.startswith("shuffle_") and n.endswith(".data") and int(n.split("_")[1]) > first]

    files = {f"{i}.txt": f"word{i} gull" for i in range(200)}
    corpus = corpus_of(files).repartition(3)
    keys = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", I.ADVISED)
    settings = [spark.conf.get(key) for key in keys]
    index = StoredIndex.open(spark, root).build(corpus)
    for _ in range(50):
        if not shuffled():
            break
        time.sleep(0.2)
    assert not shuffled()
    assert [spark.conf.get(key) for key in keys] == settings
    assert found(index, "word7") == {"7.txt"}


@pytest.mark.parametrize("room,bits,joined", [(64 << 20, 1 << 29, False), (1000, 1 << 15, False), (-1, 64, True)])
def test_postings_are_not_shuffled_to_meet_many_tombstones(spark, root, changes_of, monkeypatch, room, bits, joined):
    """By hashes, by bitmaps that take some in wrongly, and by bitmaps that take in too many."""
    from termloom.operators import joins as J

    rows = [(f"{i}.txt", f"word{i % 7} gull") for i in range(300)] + [(None, "gull tern"), ("5.txt", "gull auk")]
    corpus = spark.createDataFrame(rows, "path string, content string")
    index = StoredIndex.open(spark, root).build(corpus)
    index = index.apply(changes_of([(i, "delete", f"{i}.txt") for i in range(200)]), corpus, EXTENSIONS).index
    index = index.apply(changes_of([(300 + i, "modify", f"{i}.txt") for i in range(150, 250)]), corpus, EXTENSIONS).index
    expected = sorted(map(str, index.postings_for().collect()))
    assert len(expected) == 302
    monkeypatch.setattr(I, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(J, "BROADCAST_BYTES", room)
    monkeypatch.setattr(J, "FILTER_BITS", bits)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        again = StoredIndex.open(spark, root)
        live = again.postings_for()
        posting_side = live._jdf.queryExecution().executedPlan().toString().split("Scan parquet")[0]
        assert ("SortMergeJoin" in posting_side) is joined
        assert sorted(map(str, live.collect())) == expected
        assert sorted(map(str, again.compact().postings_for().collect())) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
