"""Listings of a file tree, read folder by folder in tasks."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termloom.functions import paths as P

LISTING = "path string, length long, mtime long"
FOLDERS_PER_TASK = 64
MAX_TASKS = 20_000
_ENTRIES = "path string, is_dir boolean, length long, mtime long"


def _lister(root: str, rows: int = 10_000):
    """Folders to their entries; self-contained, so that tasks need no code of ours."""
    schema = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("mtime", pa.int64())])

    def local(folder: str) -> Iterator[tuple]:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    entry.name.encode()
                    is_dir, state = entry.is_dir(follow_symlinks=False), entry.stat()
                except (FileNotFoundError, UnicodeEncodeError):
                    continue
                if is_dir or stat.S_ISREG(state.st_mode):
                    yield entry.name, is_dir, state.st_size, state.st_mtime_ns

    def remote(folder: str) -> Iterator[tuple]:
        system, inner = arrow_fs.FileSystem.from_uri(folder)
        for info in system.get_file_info(arrow_fs.FileSelector(inner)):
            if info.type in (arrow_fs.FileType.File, arrow_fs.FileType.Directory):
                yield info.base_name, info.type == arrow_fs.FileType.Directory, info.size, info.mtime_ns

    def entries(folder: str) -> Iterator[tuple]:
        try:
            for name, is_dir, length, mtime in (local if folder.startswith("/") else remote)(folder):
                hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
                if not hidden:
                    yield f"{folder.rstrip('/')}/{name}", is_dir, length, mtime
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            if folder == root:
                raise

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, f.type) for column, f in zip(zip(*found), schema)], schema=schema
            )

        for folders in batches:
            for folder in folders.column(0).to_pylist():
                for entry in entries(folder):
                    found.append(entry)
                    if len(found) == rows:
                        yield batch()
                        found.clear()
        if found:
            yield batch()

    return listed


def list_tree(spark: SparkSession, root: str, store: str, extensions: list[str] | None = None) -> DataFrame:
    """Every file below ``root`` as ``(path, length, mtime)``, kept in the new folder ``store``.

    The tree is read level by level, the folders of a level dealt over tasks, so
    no listing of the tree passes through the driver; one folder is one task's,
    and of a local one no more than a batch of entries is held. Paths are those of
    ``scan_files`` (a root of another file system must be named in full), and
    names that Spark leaves out are left out. Links to files count as files,
    links to folders are not followed. A folder that vanishes or may not be read is
    empty, but a missing ``root`` is an error: an unmounted tree is not an empty one.
    """
    root = re.sub(r"^file:(//)?(?=/)", "", root)
    folders, count, level = spark.createDataFrame([(root,)], "path string"), 1, 0
    wanted = F.lit(True) if extensions is None else P.is_target(F.col("path"), extensions)
    while count:
        tasks = min(-(-count // FOLDERS_PER_TASK), MAX_TASKS)
        seen = Observation()
        home = f"{store}/level={level}"
        (
            folders.repartition(tasks).mapInArrow(_lister(root), _ENTRIES)
            .filter(F.col("is_dir") | wanted)
            .observe(seen, F.count(F.when(F.col("is_dir"), 1)).alias("folders"))
            .write.parquet(home)
        )
        count, level = seen.get["folders"], level + 1
        folders = spark.read.schema(_ENTRIES).parquet(home).filter("is_dir").select("path")
    return read_listing(spark, store)


def read_listing(spark: SparkSession, store: str) -> DataFrame:
    """A listing that ``list_tree`` kept."""
    return kept_entries(spark, store).withColumn("path", P.normalize(F.col("path")))


def kept_entries(spark: SparkSession, store: str) -> DataFrame:
    """The same under the paths at which the files can be opened."""
    files = spark.read.schema(_ENTRIES).parquet(f"{store}/level=*").filter("NOT is_dir")
    return files.select("path", "length", "mtime")
