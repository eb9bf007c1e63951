"""Documents as ``(path, content)`` rows: file trees, tables, lookups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import paths as P
from termloom.operators.joins import fits_broadcast, holding, narrow
from termloom.session import shared_dir
from termloom.sources.tree import MAX_TASKS, kept_entries, list_tree

# Longer files are set aside unread: a file is one value, which cannot exceed 2 GB.
MAX_FILE_BYTES = 512 << 20
FILES_PER_TASK, READ_BYTES = 4096, 128 << 20  # what one task reads of a listed tree


def _files(spark: SparkSession, root: str, extensions: list[str] | None) -> DataFrame:
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True)
    )
    if extensions and not any(set("{}[]*?,\\") & set(e) for e in extensions):
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    files = reader.load(root).withColumn("path", P.normalize(F.col("path")))
    return files if not extensions else files.filter(P.is_target(F.col("path"), extensions))


def scan_files(
    spark: SparkSession, root: str, extensions: list[str] | None = None, longest: int = MAX_FILE_BYTES
) -> DataFrame:
    """Every file below ``root`` as ``(path, content BINARY)``.

    With ``extensions`` the listing is narrowed first, so other files are
    never opened, and then tested exactly. Files that vanish between listing
    and reading, cannot be read, or are longer than ``longest`` are skipped.
    Spark leaves out names starting ``.`` or ``_``.
    """
    return _files(spark, root, extensions).filter(F.col("length") <= longest).select("path", "content")


def rejected_files(
    spark: SparkSession, root: str, extensions: list[str] | None = None, longest: int = MAX_FILE_BYTES
) -> DataFrame:
    """``(path, n_bytes, reason)`` of every file that ``load_directory`` leaves out.

    The tree is listed by tasks into a table, and each file is read once. Long
    files are known from the listing; content is never kept.
    """
    store = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}"
    list_tree(spark, root, store, extensions or None)
    files = kept_entries(spark, store).select("path", F.col("length").alias("n_bytes"))
    short = F.col("n_bytes") <= longest
    count, n_bytes = files.agg(F.count(F.when(short, 1)), F.coalesce(F.sum(F.when(short, F.col("n_bytes"))), F.lit(0))).first()
    tasks = min(max(1, -(-count // FILES_PER_TASK), -(-n_bytes // READ_BYTES)), MAX_TASKS)
    held = files.filter(short).repartition(tasks).mapInArrow(_reader(), "path string, n_bytes long, content binary")
    unread = F.when(F.col("content").isNull(), "unreadable").otherwise("invalid UTF-8")
    left_out = files.filter(F.col("n_bytes") > longest).select("*", F.lit("too long").alias("reason")).unionByName(
        held.filter(_utf8("content").isNull()).select("path", "n_bytes", unread.alias("reason"))
    )
    return left_out.withColumn("path", P.normalize(F.col("path")))


def _reader(rows: int = 256, size: int = 8 << 20):
    """Listed files to their bytes, null where a file cannot be read; self-contained."""
    schema = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("content", pa.binary())])

    def content(path: str) -> bytes | None:
        try:
            if path.startswith("/"):
                with open(path, "rb") as file:
                    return file.read()
            system, inner = arrow_fs.FileSystem.from_uri(path)
            with system.open_input_stream(inner, compression=None) as file:
                return file.read()
        except OSError:
            return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for path, n_bytes in zip(*(column.to_pylist() for column in batch.columns)):
                found.append((path, n_bytes, content(path)))
                held += len(found[-1][2] or b"")
                if len(found) == rows or held > size:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
                    found, held = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return read


def readable(files: DataFrame) -> DataFrame:
    """Rows of ``(path, content BINARY)`` whose bytes are valid UTF-8."""
    text = files.select("path", _utf8("content").alias("content"))
    return text.filter(F.col("content").isNotNull())


def unreadable(files: DataFrame) -> DataFrame:
    """The rows ``readable`` leaves out, with their size and the reason."""
    return files.filter(_utf8("content").isNull()).select(
        "path",
        F.octet_length("content").cast("long").alias("n_bytes"),
        F.when(F.col("content").isNull(), "no content").otherwise("invalid UTF-8").alias("reason"),
    )


def _utf8(name: str) -> Column:
    return F.try_validate_utf8(F.col(name).cast("string"))


def load_directory(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Readable files below ``root``."""
    return readable(scan_files(spark, root, extensions))


def table_corpus(table: DataFrame, path: Column, content: Column) -> DataFrame:
    """Any table as a corpus; the caller names the path and text columns."""
    return table.select(path.alias("path"), content.alias("content"))


def load_by_path(requests: DataFrame, corpus: DataFrame) -> DataFrame:
    """Content for each requested path, for one path or for millions.

    The corpus is first cut down to the paths asked for, so content nobody
    asked for is not moved.
    """
    asked = requests.select("path").distinct()
    small = fits_broadcast(asked, "path")
    if small:
        corpus = narrow(corpus, "path", asked)
    held = holding(corpus.select("path", "content"), asked, "path", small)
    return requests.join(held.withColumn("held", F.lit(True)), "path", "left").select(
        *requests.columns, "content", F.coalesce("held", F.lit(False)).alias("found")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as a corpus."""
    ext = F.element_at(
        F.array(F.lit("txt"), F.lit("md"), F.lit("rs")), (F.col("doc_id") % 3 + 1).cast("int")
    )
    path = F.concat(
        F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"),
        F.lit("."), ext,
    )
    return table_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, F.col("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``pages`` table as a corpus of ``.html`` files."""
    path = F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return table_corpus(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, F.col("html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``conversations`` table as a corpus, one ``.md`` file per turn."""
    path = F.concat(
        F.lit("/conversations/"), F.col("conv_id").cast("string"), F.lit("/"),
        F.col("turn").cast("string"), F.lit(".md"),
    )
    return table_corpus(spark.read.parquet(f"{sf_dir}/conversations.parquet"), path, F.col("text"))
