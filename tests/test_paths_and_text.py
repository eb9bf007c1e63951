import pytest
from pyspark.sql import functions as F

from termloom.functions import paths as P
from termloom.functions.analysis import tokens
from termloom.operators.joins import covered_by


@pytest.mark.parametrize("path,extensions,expected", [
    (".bashrc", ["bashrc", ""], False), ("Makefile", [""], False), ("a.tar.gz", ["gz"], True),
    ("a.tar.gz", ["tar.gz"], False), ("A.TXT", ["txt"], False), ("foo.", [""], True),
    ("/x.d/readme", ["d"], False), ("/x/a.md", ["txt", "md"], True), ("..", [""], False),
])
def test_extension_filter(spark, path, extensions, expected):
    row = spark.range(1).select(P.is_target(F.lit(path), extensions).alias("x")).first()
    assert row.x is expected


@pytest.mark.parametrize("raw,expected", [
    ("./a/./b.txt", "a/b.txt"), ("/a/././b", "/a/b"), ("a//b/", "a/b"), ("/a/../b", "/a/../b"),
    ("/", "/"), ("file:/tmp/x.txt", "/tmp/x.txt"), ("file:///tmp/x.txt", "/tmp/x.txt"), ("a/.", "a"),
    ("/a/.b/c", "/a/.b/c"),
])
def test_normalize(spark, raw, expected):
    assert spark.range(1).select(P.normalize(F.lit(raw)).alias("x")).first().x == expected


def test_extension_option_is_trimmed():
    assert P.parse_extensions("txt, md") == ["txt", "md"]


def test_tokens_number_before_long_ones_are_dropped(spark):
    long = "x" * 40
    wide = "é" * 20  # 40 bytes in 20 characters
    text = f"Foo-bar {long} {'y' * 39} {wide} ÉTÉ 42"
    row = spark.range(1).select(tokens(F.lit(text)).alias("t")).first()
    assert [(t.pos, t.term) for t in row.t] == [
        (0, "foo"), (1, "bar"), (3, "y" * 39), (5, "été"), (6, "42")
    ]


def test_no_tokens(spark):
    rows = spark.sql("SELECT explode(array('', '--- !', null)) AS s").select(tokens(F.col("s")).alias("t"))
    assert [r.t for r in rows.collect()] == [[], [], []]


def test_prefix_by_text_and_by_component(spark):
    paths = spark.createDataFrame([("/foo/a",), ("/foobar/b",), ("/foo",), ("/x",)], "path string")
    prefixes = spark.createDataFrame([("/foo", 1), ("/foo/a", 2), ("/zz", 3)], "prefix string, seq int")
    pairs = {(r.path, r.seq) for r in covered_by(paths, prefixes).collect()}
    assert pairs == {("/foo/a", 1), ("/foo/a", 2), ("/foobar/b", 1), ("/foo", 1)}
    pairs = {(r.path, r.seq) for r in covered_by(paths, prefixes, component=True).collect()}
    assert pairs == {("/foo/a", 1), ("/foo/a", 2), ("/foo", 1)}
    salted = {(r.path, r.seq) for r in covered_by(paths, prefixes, small=False).collect()}
    assert salted == {("/foo/a", 1), ("/foo/a", 2), ("/foobar/b", 1), ("/foo", 1)}
    assert covered_by(paths, prefixes.limit(0)).count() == 0
