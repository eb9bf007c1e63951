"""A directory as a change feed: listings, their differences, a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom import schemas
from termloom.operators.events import snapshot_diff
from termloom.session import shared_dir
from termloom.sources import storage
from termloom.sources.tree import LISTING, list_tree, read_listing
from termloom.streaming.feed import read_feed

# Fixed value: how often a live watch looks at the tree.
TRIGGER = "1 second"


class TreeWatch:
    """Changes of the files below ``root``, kept under ``home``.

    A look lists the tree, compares the listing with the last one and keeps both
    the listing and the changes as one step::

        steps/<number>/listing/   what the tree held
        steps/<number>/changes/   how it came about, seq = number

    A step is made in a draft folder and put in place by one rename, so after a
    crash it is there as a whole or the next look makes it again: no change is
    lost or told twice. A file counts as changed when its length or its time of
    change differs; a vanished and a new file equal in both are a rename. A
    renamed folder is a rename of each of its files. One watch at a time per ``home``.
    """

    def __init__(self, spark: SparkSession, root: str, home: str, extensions: list[str] | None = None):
        self.spark, self.root, self.home, self.extensions = spark, root, home.rstrip("/"), extensions

    def mark(self) -> int:
        """Take the tree as it is for known, before an index is built from it.

        What changes during the build is then told by the next look.
        """
        return self._look(tell=False)

    def poll(self) -> int | None:
        """Look once; the number of the new step, or None when nothing changed.

        Without an earlier step every file is new.
        """
        return self._look(tell=True)

    def start(self, trigger: str = TRIGGER) -> StreamingQuery:
        """Look again and again, until the returned query is stopped."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def look(tick: DataFrame, number: int) -> None:
            self.poll()

        return (
            ticks.writeStream.foreachBatch(look).option("checkpointLocation", f"{self.home}/ticks")
            .trigger(processingTime=trigger).start()
        )

    def changes(self, files_per_batch: int | None = None) -> DataFrame:
        """The changes as a stream, for ``apply_stream``."""
        return read_feed(self.spark, f"{self.home}/steps/*/changes", schemas.CHANGES, files_per_batch=files_per_batch)

    def _look(self, tell: bool) -> int | None:
        spark, steps = self.spark, f"{self.home}/steps"
        shared_dir(spark)
        for name in storage.list_names(spark, f"{self.home}/drafts"):  # of looks that did not end
            storage.delete(spark, f"{self.home}/drafts/{name}")
        known = storage.list_names(spark, steps)
        number = int(known[-1]) + 1 if known else 0
        draft = f"{self.home}/drafts/{uuid.uuid4().hex}"
        after = list_tree(spark, self.root, f"{draft}/listing", self.extensions)
        if known and tell:
            before = read_listing(spark, f"{steps}/{known[-1]}/listing")
        else:
            before = spark.createDataFrame([], LISTING)
        found = snapshot_diff(_versions(before), _versions(after if tell else before))
        rows = found.select(
            F.lit(number).cast("long").alias("seq"), F.current_timestamp().alias("ts"), "op", "path", "old_path"
        )
        rows.write.parquet(f"{draft}/changes")
        if tell and spark.read.schema(schemas.CHANGES).parquet(f"{draft}/changes").isEmpty():
            storage.delete(spark, draft)
            return None
        if not storage.publish_folder(spark, draft, f"{steps}/{number:012d}"):
            raise RuntimeError(f"another watch keeps its steps in {self.home}")
        for name in known:  # only the last listing is ever read again
            storage.delete(spark, f"{steps}/{name}/listing")
        return number


def _versions(listing: DataFrame) -> DataFrame:
    return listing.select("path", F.concat_ws(":", "length", "mtime").alias("hash"))
