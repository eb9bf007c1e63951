"""Registered queries against their SQL, and the pipeline stage by stage."""

import check_oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from termloom.llm import near_dedup, queries, secrets

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check_oracle.connect(SF_DIR)


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, key):
    assert check_oracle.compare(spark, db, SF_DIR, key) is None


def test_stages(spark):
    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs, counts = source, [source.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == source.columns, name
        assert docs.join(before, "doc_id", "left_anti").isEmpty(), name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert docs.groupBy("text").count().filter("count > 1").isEmpty()
    assert near_dedup.near_duplicates(docs).filter("not kept").count() <= 1
    spans = secrets.scan(docs).filter(F.size("spans") > 0)
    assert spans.isEmpty()
    assert docs.filter("n_chars <> length(text)").isEmpty()


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF_DIR)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").isEmpty()
    assert pieces.filter("octet_length(ids) <> 4 * length").isEmpty()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
