"""Streams over a landing folder, fed in several files."""

import time
from datetime import datetime, timedelta

from termloom import schemas
from termloom.operators.events import classify
from termloom.plans.index import StoredIndex
from termloom.session import shared_dir
from termloom.streaming.apply import apply_stream
from termloom.streaming.feed import read_feed

START = datetime(2024, 1, 1)
EXTENSIONS = ["txt"]


def land(spark, folder, rows):
    """One landing file of (seq, milliseconds, kind, paths, is_dir) rows."""
    full = [(s, START + timedelta(milliseconds=ms), kind, paths, d) for s, ms, kind, paths, d in rows]
    spark.createDataFrame(full, schemas.RAW_EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_stream_keeps_an_index_current(spark, tmp_path, corpus_of):
    landing, root, progress = (str(tmp_path / n) for n in ("landing", "index", "progress"))
    StoredIndex.open(spark, root).build(corpus_of({"/a/1.txt": "one", "/a/2.txt": "two", "/b/3.txt": "three"}), buckets=2)
    reader = StoredIndex.open(spark, root)
    now = {"/a/1.txt": "uno", "/c/4.txt": "four", "/d/2.txt": "two"}

    def run():
        changes = classify(read_feed(spark, landing, schemas.RAW_EVENTS, files_per_batch=1))
        apply_stream(changes, root, lambda: corpus_of(now), EXTENSIONS, progress, available_now=True).awaitTermination()

    land(spark, landing, [(1, 0, "modify_data", ["/a/./1.txt"], False), (2, 5, "create", ["/c/4.txt"], False)])
    land(spark, landing, [(3, 10, "rename_both", ["/a/2.txt", "/d/2.txt"], False), (4, 11, "create", ["/gone.txt"], False)])
    run()
    index = StoredIndex.open(spark, root)
    assert list(index.snapshot.batches.values()) == [1] and index.snapshot.last_seq == 4
    assert {r.path for r in index.docs.collect()} == {"/a/1.txt", "/b/3.txt", "/c/4.txt", "/d/2.txt"}
    assert [(r.path, r.reason) for r in index.quarantine().collect()] == [("/gone.txt", "not in corpus")]
    assert {r.path for r in reader.docs.collect()} == {"/a/1.txt", "/a/2.txt", "/b/3.txt"}  # pinned

    land(spark, landing, [(5, 20, "remove_folder", ["/b"], True)])
    run()  # goes on from its checkpoint
    assert {r.path for r in StoredIndex.open(spark, root).docs.collect()} == {"/a/1.txt", "/c/4.txt", "/d/2.txt"}


def test_live_debounce_loses_no_change(spark, tmp_path, corpus_of):
    """Late, early and repeated events end in the index of the undebounced stream."""
    landing, root = str(tmp_path / "landing"), str(tmp_path / "index")
    now = {f"/{n}.txt": n for n in ("one", "two", "late", "early", "busy")}
    StoredIndex.open(spark, root).build(corpus_of({"/one.txt": "old", "/gone.txt": "gone"}))
    land(spark, landing, [(1, 0, "modify_data", ["/one.txt"], False), (2, 90_000, "create", ["/early.txt"], False)])
    changes = classify(read_feed(spark, landing, schemas.RAW_EVENTS))
    stream = apply_stream(
        changes, root, lambda: corpus_of(now), EXTENSIONS, str(tmp_path / "progress"), trigger="300 milliseconds", quiet_seconds=0.5
    )
    try:
        def wait_for(paths):
            end = time.time() + 90
            while {r.path for r in StoredIndex.open(spark, root).docs.collect()} != paths:
                assert stream.isActive and time.time() < end, stream.exception()
                time.sleep(0.5)

        # Nothing follows, and yet the burst ends.
        wait_for({"/one.txt", "/early.txt", "/gone.txt"})
        land(spark, landing, [(3, -50_000, "create", ["/late.txt"], False), (4, 0, "remove_file", ["/gone.txt"], False)])
        land(spark, landing, [(5, 95_000, "modify_data", ["/busy.txt"], False), (5, 95_000, "modify_data", ["/busy.txt"], False)])
        land(spark, landing, [(6, 10, "create", ["/two.txt"], False), (1, 0, "modify_data", ["/one.txt"], False)])
        wait_for(set(now))
    finally:
        stream.stop()


def test_a_new_stream_after_a_rebuild_loses_nothing(spark, tmp_path, corpus_of):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "index")
    now = {"/a/1.txt": "one", "/b/2.txt": "two"}
    land(spark, landing, [(1, 0, "create", ["/b/2.txt"], False)])
    for attempt in ("first", "second"):
        StoredIndex.open(spark, root).build(corpus_of({"/a/1.txt": "one"}))
        changes = classify(read_feed(spark, landing, schemas.RAW_EVENTS))
        apply_stream(
            changes, root, lambda: corpus_of(now), EXTENSIONS, str(tmp_path / attempt), available_now=True
        ).awaitTermination()
        assert {r.path for r in StoredIndex.open(spark, root).docs.collect()} == set(now)


def test_debounced_stream_into_an_index(spark, tmp_path, corpus_of):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "index")
    StoredIndex.open(spark, root).build(corpus_of({"/a/1.txt": "one"}))
    land(spark, landing, [(n, 10 * n, "modify_data", ["/a/1.txt"], False) for n in range(1, 6)])
    land(spark, landing, [(9, 60_000, "create", ["/late.txt"], False)])
    land(spark, landing, [(10, 120_000, "create", ["/later.txt"], False)])
    changes = classify(read_feed(spark, landing, schemas.RAW_EVENTS, files_per_batch=1))
    apply_stream(
        changes, root, lambda: corpus_of({"/a/1.txt": "uno", "/late.txt": "x", "/later.txt": "y"}), EXTENSIONS,
        str(tmp_path / "progress"), available_now=True, quiet_seconds=1.0,
    ).awaitTermination()
    index = StoredIndex.open(spark, root)
    assert {r.term for r in index.terms_for().collect()} >= {"uno"}
    assert {r.path for r in index.docs.collect()} == {"/a/1.txt", "/late.txt", "/later.txt"}
    assert index.snapshot.last_seq == 10


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
