"""Postings cut out of many documents at a time, against a plain count of the same words."""

import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.functions.analysis import tokens
from termloom.operators import postings as O
from termloom.plans import index as I

ODD = [*"aBcZ09 .,-'’ΣσςΑİıß中字٣½\n\t_", "́", "\U00010400", "\U0001F600", "ẞ", "Ⅻ", "x" * 39, "é" * 20, "Ⱥ" * 20, "K" * 14]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    rows = [(f"/{i % 90}", "".join(rng.choice(ODD) for _ in range(rng.randrange(60)))) for i in range(600)]
    rows += [(None, "b a b"), (None, None), ("/n", None), ("/e", ""), ("/s", " a"), ("/t", "a "), ("/b", " ")]
    return spark.createDataFrame(rows, "path string, content string").cache()


def test_entries_are_the_words_of_each_row(odd):
    """Rows that repeat a path stay apart; long words keep their number and are left out."""
    expected = []
    for path, found in odd.select("path", tokens(F.col("content"))).collect():
        places = defaultdict(list)
        for word in found:
            places[word.term].append(word.pos)
        expected += [(w, path, len(p), p, len(found)) for w, p in places.items()] + [("", path, 0, [], len(found))]
    rows = [tuple(row) for row in O.build_entries(odd, 7).collect()]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_postings_come_in_runs(odd):
    """One run of (bucket, term, path) for the documents taken together, so that a sort has little left to do."""
    rows = O.build_entries(odd.filter("path IS NOT NULL").coalesce(1), 5).filter(~O.is_document()).collect()
    keys = [(zlib.crc32(r.term.encode()) % 5, r.term.encode(), r.path.encode()) for r in rows]
    assert keys == sorted(keys) and len({k[0] for k in keys}) == 5


@pytest.mark.parametrize("limit,rows_a_batch", [(1, 100), (5, 1), (12, 3), (1000, 2)])
def test_documents_are_dealt_by_their_text(limit, rows_a_batch):
    texts = ["a b a", "", "c" * 30, " b", "d e f", "", "", "a"]
    whole = pa.RecordBatch.from_arrays(
        [pa.array([str(i) for i in range(len(texts))]), pa.array(texts), pa.array(texts)], ["path", "written", "lowered"]
    )
    batches = [whole.slice(at, rows_a_batch) for at in range(0, len(texts), rows_a_batch)]
    seen = [tuple(row.values()) for batch in O._entries(3, limit, 2)(iter(batches)) for row in batch.to_pylist()]
    assert sorted(seen) == sorted([
        ("a", "0", 2, [0, 2], 3), ("b", "0", 1, [1], 3), ("c" * 30, "2", 1, [0], 1), ("b", "3", 1, [0], 1),
        *[(w, "4", 1, [i], 3) for i, w in enumerate("def")], ("a", "7", 1, [0], 1),
        *[("", str(i), 0, [], n) for i, n in enumerate([3, 0, 1, 1, 3, 0, 0, 1])],
    ])
    assert list(O._entries(3)(iter([]))) == []


def test_one_file_is_tokenised_by_all_cores(spark, tmp_path, changes_of, monkeypatch):
    """A file of one row group, of whatever size, for a build and for changes."""
    files = {f"/{i}.txt": f"gull word{i}" for i in range(300)}
    spark.createDataFrame(list(files.items()), "path string, content string").coalesce(1).write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    tasks = []

    def counted(rows, buckets=1):
        tasks.append(rows.select(F.spark_partition_id()).distinct().count())
        return O.build_entries(rows, buckets)

    monkeypatch.setattr(I, "build_entries", counted)
    monkeypatch.setattr(I, "FINE_BYTES", 100)
    per_task = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        index = I.StoredIndex.open(spark, str(tmp_path / "index")).build(corpus)
        index = index.apply(changes_of([(i, "modify", path) for i, path in enumerate(files)]), corpus, ["txt"]).index
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", per_task)
    assert len(tasks) == 2 and min(tasks) > 8
    assert (index.n_docs, index.n_tokens) == (300, 600) and index.docs.distinct().count() == 300


@pytest.mark.parametrize("buckets,limit,fused", [(1, 1 << 20, True), (7, 50, False), (300, 1000, False), (300, 1, True)])
def test_packed_entries_are_the_same_entries(odd, monkeypatch, buckets, limit, fused):
    """With null and repeated paths, of several lengths, and documents without words."""
    monkeypatch.setattr(O, "PACKED_AT_ONCE", limit)
    packer = O._packer
    monkeypatch.setattr(O, "_packer", lambda n, **cut: packer(n, limit, **cut))
    entries = O.build_entries(odd, buckets)
    packed = O.pack(entries if fused else entries.select("*"), buckets)
    expected = [
        (*row, O.DOCUMENT_BUCKET if row.term == "" else zlib.crc32(row.term.encode()) % buckets) for row in entries.collect()
    ]
    assert sorted(map(tuple, O.unpack(packed).collect()), key=str) == sorted(expected, key=str)
    assert packed.groupBy("bucket").count().count() == len({row[-1] for row in expected})


def test_packed_entries_are_small(odd):
    """A few rows, each a fraction of the postings it holds."""
    texts = odd.unionByName(odd.selectExpr("concat('/long/way/', path) AS path", "repeat(concat(content, ' gull '), 5) AS content"))
    entries = O.build_entries(texts.filter("path IS NOT NULL").coalesce(1), 3)
    plain = entries.selectExpr("sum(octet_length(term) + octet_length(path) + 4 * size(positions) + 16)").first()[0]
    rows = O.pack(entries, 3).collect()
    assert len(rows) == 4 and 3 * sum(len(r.packed) for r in rows) < plain
    assert list(O._packer(3)(iter([]))) == [] and list(O._unpacker()(iter([]))) == []
