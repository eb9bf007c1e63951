"""A directory watched by listings, up to the index that follows it."""

import os
import time

import pytest

from termloom.plans.index import StoredIndex
from termloom.sources.corpus import load_directory
from termloom.sources.tree import list_tree
from termloom.streaming import watch as W
from termloom.streaming.apply import apply_stream

EXTENSIONS = ["txt"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()

    def put(path, text, at=None):
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
        if at is not None:
            os.utime(file, (at, at))

    return root, put


def told(spark, home):
    """The kept changes, without the root of the tree."""
    rows = spark.read.parquet(f"{home}/steps/*/changes").collect()
    short = lambda path: path and path.split("/tree/", 1)[1]
    return sorted((r.seq, r.op, short(r.path), short(r.old_path) or "") for r in rows)


def test_listing(spark, tree, tmp_path):
    root, put = tree
    for n in range(130):  # more folders than one task takes
        put(f"d{n % 70}/e{n % 3}/{n}.txt", "x" * n)
    for name in ("a.bin", ".hidden.txt", "_part.txt", "d1/._x.txt", "with space%20.txt", "no_extension"):
        put(name, "x")
    os.symlink(root / "d1", root / "loop")
    os.symlink(root / "gone", root / "broken.txt")
    os.symlink(root / "d1/e1/1.txt", root / "link.txt")
    rows = list_tree(spark, f"file://{root}/", str(tmp_path / "list"), EXTENSIONS).collect()
    want = {f"{root}/d{n % 70}/e{n % 3}/{n}.txt": n for n in range(130)}
    want |= {f"{root}/with space%20.txt": 1, f"{root}/link.txt": 1}
    assert {r.path: r.length for r in rows} == want and len(rows) == len(want)
    assert all(r.mtime == os.stat(r.path).st_mtime_ns for r in rows)
    every = list_tree(spark, str(root), str(tmp_path / "all")).collect()
    assert {r.path for r in every} - set(want) == {f"{root}/a.bin", f"{root}/no_extension"}


def test_empty_and_missing_trees(spark, tree, tmp_path):
    root, _ = tree
    assert list_tree(spark, str(root), str(tmp_path / "list")).count() == 0
    watch = W.TreeWatch(spark, str(root), str(tmp_path / "watch"))
    assert watch.poll() is None
    with pytest.raises(Exception, match="No such file"):
        W.TreeWatch(spark, str(root / "gone"), str(tmp_path / "other")).poll()


def test_changes_reach_the_index(spark, tree, tmp_path, monkeypatch):
    root, put = tree
    home, index, progress = (str(tmp_path / n) for n in ("watch", "index", "progress"))
    for n, name in enumerate(("same", "edit", "drop", "move")):
        put(f"a/{name}.txt", name, 1000 + n)
    put("b/in/1.txt", "uno", 2000)
    put("b/2.txt", "dos", 2001)

    def run():
        apply_stream(
            W.TreeWatch(spark, str(root), home, EXTENSIONS).changes(files_per_batch=1), index,
            lambda: load_directory(spark, str(root), EXTENSIONS), EXTENSIONS, progress, available_now=True,
        ).awaitTermination()

    def held():
        rows = StoredIndex.open(spark, index).postings_for().select("path", "term").collect()
        return {(r.path.split("/tree/", 1)[1], r.term) for r in rows}

    watch = W.TreeWatch(spark, str(root), home, EXTENSIONS)
    assert watch.mark() == 0 and told(spark, home) == []
    put("a/early.txt", "early", 3000)  # between the mark and the build
    StoredIndex.open(spark, index).build(load_directory(spark, str(root), EXTENSIONS))
    put("a/edit.txt", "edited", 4000)
    (root / "a/drop.txt").unlink()
    (root / "a/move.txt").rename(root / "moved.txt")
    (root / "b").rename(root / "c")
    put("new/deep/er.txt", "new", 4001)
    assert watch.poll() == 1
    assert told(spark, home) == sorted([
        (1, "create", "a/early.txt", ""), (1, "modify", "a/edit.txt", ""), (1, "delete", "a/drop.txt", ""),
        (1, "rename", "moved.txt", "a/move.txt"), (1, "rename", "c/in/1.txt", "b/in/1.txt"),
        (1, "rename", "c/2.txt", "b/2.txt"), (1, "create", "new/deep/er.txt", ""),
    ])
    assert watch.poll() is None
    run()
    first = {
        ("a/same.txt", "same"), ("a/early.txt", "early"), ("a/edit.txt", "edited"), ("moved.txt", "move"),
        ("c/in/1.txt", "uno"), ("c/2.txt", "dos"), ("new/deep/er.txt", "new"),
    }
    assert held() == first

    # A look that dies before its step is in place leaves nothing behind.
    (root / "c/2.txt").unlink()
    put("a/drop.txt", "back", 5000)
    with monkeypatch.context() as broken:
        broken.setattr(W.storage, "publish_folder", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            watch.poll()
    run()
    assert held() == first
    again = W.TreeWatch(spark, str(root), home, EXTENSIONS)  # a new process
    assert again.poll() == 2 and again.poll() is None
    assert [row for row in told(spark, home) if row[0] == 2] == [(2, "create", "a/drop.txt", ""), (2, "delete", "c/2.txt", "")]
    run()
    run()
    after = first - {("c/2.txt", "dos")} | {("a/drop.txt", "back")}
    assert held() == after
    assert StoredIndex.open(spark, index).snapshot.last_seq == 2
    assert os.listdir(f"{home}/drafts") == [] and not os.path.exists(f"{home}/steps/000000000001/listing")


def test_equal_files_are_told_as_some_rename(spark, tree, tmp_path):
    """Files equal in length and time pair up by path; every path is told once."""
    root, put = tree
    home = str(tmp_path / "watch")
    for n in range(6):
        put(f"a/{n}.txt", "same", 1000)
    watch = W.TreeWatch(spark, str(root), home, EXTENSIONS)
    watch.mark()
    for n in range(4):
        (root / f"a/{n}.txt").rename(root / f"z{n}.txt")
    (root / "a/5.txt").unlink()
    watch.poll()
    rows = told(spark, home)
    assert sorted(op for _, op, _, _ in rows) == ["delete"] + ["rename"] * 4
    gone = [old or path for _, _, path, old in rows]
    assert sorted(gone) == ["a/0.txt", "a/1.txt", "a/2.txt", "a/3.txt", "a/5.txt"]


def test_a_live_watch_feeds_a_live_index(spark, tree, tmp_path):
    root, put = tree
    put("one.txt", "one")
    watch = W.TreeWatch(spark, str(root), str(tmp_path / "watch"), EXTENSIONS)
    index = str(tmp_path / "index")
    looking = watch.start("500 milliseconds")
    following = apply_stream(
        watch.changes(), index, lambda: load_directory(spark, str(root), EXTENSIONS), EXTENSIONS, str(tmp_path / "progress")
    )
    try:
        def wait_for(names):
            end = time.time() + 90
            while {r.path for r in StoredIndex.open(spark, index).docs.collect()} != {f"{root}/{n}" for n in names}:
                assert looking.isActive and following.isActive and time.time() < end
                time.sleep(0.5)

        wait_for({"one.txt"})
        put("two.txt", "two")
        (root / "one.txt").rename(root / "three.txt")
        wait_for({"two.txt", "three.txt"})
    finally:
        looking.stop()
        following.stop()
