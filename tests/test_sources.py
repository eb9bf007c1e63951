import os

from termloom.sources import corpus as S


def test_scan_skips_other_and_unreadable_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub" / "b.md").write_text("zwei ü")
    (tmp_path / "c.rs").write_text("no")
    (tmp_path / "d.TXT").write_text("no")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    got = {os.path.basename(r.path): r.content for r in S.load_directory(spark, str(tmp_path), ["txt", "md"]).collect()}
    assert got == {"a.txt": "one", "b.md": "zwei ü"}
    files = S.scan_files(spark, str(tmp_path))
    assert {os.path.basename(r.path) for r in files.collect()} == {"a.txt", "b.md", "c.rs", "d.TXT", "bad.txt"}
    bad = S.unreadable(files).collect()
    assert [(os.path.basename(r.path), r.n_bytes) for r in bad] == [("bad.txt", 2)]


def test_failed_reads_are_rejects(spark, tmp_path):
    (tmp_path / "good.txt").write_text("fine")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "long.txt").write_text("x" * 500)
    (tmp_path / "other.bin").write_bytes(b"\xff")
    kept = S.readable(S.scan_files(spark, str(tmp_path), ["txt"], longest=100))
    assert [os.path.basename(r.path) for r in kept.collect()] == ["good.txt"]
    rejected = S.rejected_files(spark, str(tmp_path), ["txt"], longest=100).collect()
    assert {(os.path.basename(r.path), r.n_bytes, r.reason) for r in rejected} == {
        ("bad.txt", 2, "invalid UTF-8"), ("long.txt", 500, "too long"),
    }


def test_large_requests_filter_before_the_shuffle(spark, corpus_of, monkeypatch):
    corpus = corpus_of({f"/{i}.txt": f"text {i}" for i in range(200)})
    requests = spark.createDataFrame([(f"/{i}.txt",) for i in range(0, 220, 2)], "path string")
    want = sorted((r.path, r.content or "", r.found) for r in S.load_by_path(requests, corpus).collect())
    monkeypatch.setattr(S, "fits_broadcast", lambda *a: False)
    found = S.load_by_path(requests, corpus)
    assert sorted((r.path, r.content or "", r.found) for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert "_hash" in plan and "BroadcastHashJoin [_hash" in plan


def test_paths_are_plain(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    assert S.load_directory(spark, str(tmp_path)).first().path == f"{tmp_path}/a.txt"


def test_load_by_path(spark, corpus_of):
    corpus = corpus_of({"/a.txt": "one", "/b.txt": ""})
    requests = spark.createDataFrame([("/a.txt",), ("/a.txt",), ("/b.txt",), ("/c.txt",)], "path string")
    got = sorted((r.path, r.content, r.found) for r in S.load_by_path(requests, corpus).collect() if r.found)
    assert got == [("/a.txt", "one", True), ("/a.txt", "one", True), ("/b.txt", "", True)]
    assert S.load_by_path(requests, corpus).filter("NOT found").collect()[0].path == "/c.txt"


def test_rejects_list_and_read_the_tree_once_in_tasks(spark, tmp_path, monkeypatch):
    """Neither a listing by Spark's reader, which the driver holds, nor a second pass."""
    from termloom.plans import bindings as B

    root = f"{tmp_path}/files"
    rows = [(1, b"fine"), (1, b"twice"), (2, b"\xff\xfe"), (3, b"x" * 500), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, content binary").coalesce(1)
    assert B.write_files(docs, root) == 4
    monkeypatch.setattr(S, "_files", lambda *a: 1 / 0)
    rejected = S.rejected_files(spark, root, ["txt"], longest=100)
    assert {(os.path.basename(r.path), r.n_bytes, r.reason) for r in rejected.collect()} == {
        ("doc_id=2.txt", 3, "invalid UTF-8"), ("doc_id=3.txt", 501, "too long"),
    }
    assert rejected.first().path.startswith(f"{root}/")
    monkeypatch.undo()
    texts = {"\n".join(sorted(r.content.split("\n"))) for r in S.load_directory(spark, root, ["txt"]).collect()}
    assert "\nfine\ntwice" in texts and "\n" in texts


def test_a_file_that_vanishes_after_the_listing_is_unreadable(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("one")
    rejected = S.rejected_files(spark, str(tmp_path), ["txt"])
    (tmp_path / "b.txt").unlink()
    assert [(os.path.basename(r.path), r.n_bytes, r.reason) for r in rejected.collect()] == [("b.txt", 3, "unreadable")]
