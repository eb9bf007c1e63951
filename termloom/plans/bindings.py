"""How the given tables are used as corpus, change feed and queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.paths import parse_extensions
from termloom.operators.clauses import Clause, clause_table
from termloom.operators.events import classify
from termloom.operators.joins import fits_broadcast, holding
from termloom.plans.index import MemoryIndex, StoredIndex
from termloom.session import shared_dir
from termloom.sources import corpus as S

ALL_EXTENSIONS = parse_extensions("txt,md,rs")

# Kinds of raw events; 'error' is a kind that classification ignores.
KIND_OF_EVENT = {
    "view": "create", "click": "modify_data", "signup": "rename_both", "purchase": "remove",
    "error": "access",
}

_indexes: dict[tuple[str, str, type], MemoryIndex | StoredIndex] = {}


def new_root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """Index of ``documents``, built once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir, StoredIndex)
    if key not in _indexes:
        index = StoredIndex.open(spark, new_root(spark, "index"))
        _indexes[key] = index.build(S.documents(spark, sf_dir))
    return _indexes[key]


def own_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """An index of ``documents`` of the caller's own, to be changed."""
    return StoredIndex.open(spark, new_root(spark, "index")).build(S.documents(spark, sf_dir))


def memory_index(spark: SparkSession, sf_dir: str) -> MemoryIndex:
    key = (spark.sparkContext.applicationId, sf_dir, MemoryIndex)
    if key not in _indexes:
        _indexes[key] = MemoryIndex.build(S.documents(spark, sf_dir))
    return _indexes[key]


def current_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tree holds when changes are applied.

    All documents where they were, and copies of the labelled ones under
    ``/moved``, so some renames find their target and some do not.
    """
    docs = S.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    # A path tells its document, so content need not move to meet the labels.
    labelled = holding(docs.select(_doc_id(), "path", "content"), labels, "doc_id", fits_broadcast(labels))
    copies = labelled.select(F.concat(F.lit("/moved"), "path").alias("path"), "content")
    return docs.unionByName(copies)


def _doc_id() -> Column:
    return F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id")


def _doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents(spark, sf_dir).select(_doc_id(), "path")


def utc(ts: Column) -> Column:
    """A zone-less timestamp read as UTC, whatever the session zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.timestamp_micros(micros)


def raw_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events`` as raw file events on the document of the same number."""
    if events is None:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
    located = events.join(
        _doc_paths(spark, sf_dir).withColumnRenamed("doc_id", "user_id"), "user_id"
    )
    is_dir = F.col("event_id") % 5 == 0
    kind = F.create_map(*[F.lit(x) for pair in KIND_OF_EVENT.items() for x in pair])[F.col("event_type")]
    kind = F.when(kind == "remove", F.when(is_dir, "remove_folder").otherwise("remove_file")).otherwise(kind)
    folder = F.regexp_extract("path", r"^(/.*)/[^/]+$", 1)
    here = F.when(is_dir & (kind != "modify_data"), folder).otherwise(F.col("path"))
    there = F.concat(F.lit("/moved"), here)
    binary = F.concat(F.regexp_extract("path", r"^(.*)\.", 1), F.lit(".bin"))
    target = F.when(~is_dir & (F.col("event_id") % 4 == 0), binary).otherwise(there)
    paths = (
        F.when((kind == "rename_both") & (F.col("event_id") % 11 == 0), F.array(here))
        .when(kind == "rename_both", F.array(here, target))
        .when((kind == "create") & ~is_dir & (F.col("event_id") % 3 == 0), F.array(here, there))
        .otherwise(F.array(F.concat(F.lit("/."), here)))
    )
    return located.select(
        F.col("event_id").alias("seq"), utc(F.col("ts")).alias("ts"), kind.alias("kind"),
        paths.alias("paths"), is_dir.alias("is_dir"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(raw_events(spark, sf_dir))


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` texts as keyword queries, whole."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("qid"), F.col("text").alias("keyword")
    )


def phrase_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` texts as phrases, whole, and a few short phrases."""
    items = keyword_queries(spark, sf_dir).select(
        "qid", F.lit(0).alias("clause_id"), F.lit("should").alias("occur"),
        F.lit("phrase").alias("kind"), F.array("keyword").alias("terms"), F.lit(0).alias("slop"),
        F.lit(1.0).alias("boost"), F.lit("[]").alias("bounds"),
    )
    short = ["of the", "the of", "in the and", "BY-NC", "the the"]
    listed = [Clause(-1 - i, 0, kind="phrase", terms=[text]) for i, text in enumerate(short)]
    return items.unionByName(clause_table(spark, listed))


def path_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path query per labelled document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    return _doc_paths(spark, sf_dir).join(labels, "doc_id", "left_semi").select(
        F.col("doc_id").alias("qid"), F.lit(0).alias("clause_id"), F.lit("should").alias("occur"),
        F.lit("path").alias("kind"), F.array("path").alias("terms"), F.lit(0).alias("slop"),
        F.lit(1.0).alias("boost"), F.lit("[]").alias("bounds"),
    )


def listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two listings of the tree: before and after a reorganisation.

    Afterwards documents of good quality have moved, toxic ones are gone,
    French ones are edited, and web pages have been added.
    """
    docs = S.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marked = docs.join(
        _doc_paths(spark, sf_dir).join(labels, "doc_id").select("path", "quality", "toxic"),
        "path", "left",
    )
    gone = F.coalesce((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(False))
    kept = marked.filter(~gone).select(
        F.when(F.col("quality") == 1, F.concat(F.lit("/moved"), "path"))
        .otherwise(F.col("path")).alias("path"),
        F.when(F.col("path").contains("/fr/"), F.concat("content", F.lit(" fin")))
        .otherwise(F.col("content")).alias("content"),
    )
    after = kept.unionByName(S.pages(spark, sf_dir))

    def hashed(corpus: DataFrame) -> DataFrame:
        return corpus.select("path", F.md5(F.col("content").cast("binary")).alias("hash"))

    return hashed(docs), hashed(after)


def write_files(files: DataFrame, root: str) -> int:
    """One text file per ``doc_id`` of a task's rows ``(doc_id, content BINARY)``; the number of files.

    A value is followed by a line end, as Spark's text writer has it. The tasks write
    ``<root>/task=T/NNNN/doc_id=D.txt`` themselves, a thousand files a folder, so
    nothing is left for the driver to rename; a task that is repeated writes the same files.
    """
    arrow_fs.FileSystem.from_uri(root)[0].create_dir(arrow_fs.FileSystem.from_uri(root)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = arrow_fs.FileSystem.from_uri(root)
        home, n, last, out = f"{base}/task={TaskContext.get().partitionId():05d}", 0, None, None
        for batch in batches:
            first = n
            for doc_id, content in zip(*(column.to_pylist() for column in batch.columns)):
                if out is None or doc_id != last:
                    if out is not None:
                        out.close()
                    folder = f"{home}/{n // 1000:04d}"
                    if n % 1000 == 0:
                        system.create_dir(folder, recursive=True)
                    out, last, n = system.open_output_stream(f"{folder}/doc_id={doc_id}.txt"), doc_id, n + 1
                out.write((content or b"") + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([n - first], pa.int64())], ["files"])
        if out is not None:
            out.close()

    rows = files.select("doc_id", "content").sortWithinPartitions("doc_id")
    return rows.mapInArrow(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def change_files(files: DataFrame, root: str) -> int:
    """Write, move or delete the files ``(path, content, moved_to)`` below ``root``; their number.

    A file without content is moved, and deleted when it has nowhere to go.
    """
    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = arrow_fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                path, moved = base + row["path"], row["moved_to"] and base + row["moved_to"]
                for target in filter(None, (row["content"] is not None and path, moved)):
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                if row["content"] is not None:
                    with system.open_output_stream(path) as out:
                        out.write(row["content"].encode())
                elif system.get_file_info(path).is_file:  # not so when the task runs again
                    system.move(path, moved) if moved else system.delete_file(path)
            yield batch.select(["path"])

    rows = files.select("path", "content", "moved_to").dropDuplicates(["path"])
    return rows.mapInArrow(change, "path string").count()
