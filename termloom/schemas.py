"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
])

# One row per (term, document). A document also has one row with term ''
# (no token is empty) so that its length is stored even when it has no token.
POSTINGS = T.StructType([
    T.StructField("term", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("tf", T.IntegerType(), False),
    T.StructField("positions", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("dl", T.IntegerType(), False),
])

TERMS = T.StructType([
    T.StructField("term", T.StringType(), False),
    T.StructField("df", T.LongType(), False),
])

TOMBSTONES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("dl", T.IntegerType(), False),
])

QUERIES = T.StructType([
    T.StructField("qid", T.LongType(), False),
    T.StructField("keyword", T.StringType(), True),
])

CLAUSES = T.StructType([
    T.StructField("qid", T.LongType(), False),
    T.StructField("clause_id", T.IntegerType(), False),
    T.StructField("occur", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("terms", T.ArrayType(T.StringType()), True),
    T.StructField("slop", T.IntegerType(), True),
    T.StructField("boost", T.DoubleType(), True),
    T.StructField("bounds", T.StringType(), True),
])

RAW_EVENTS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("kind", T.StringType(), True),
    T.StructField("paths", T.ArrayType(T.StringType()), True),
    T.StructField("is_dir", T.BooleanType(), True),
])

CHANGES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("op", T.StringType(), False),
    T.StructField("path", T.StringType(), True),
    T.StructField("old_path", T.StringType(), True),
])
