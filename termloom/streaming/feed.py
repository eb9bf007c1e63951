"""Change feeds as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from termloom.operators.changes import expand
from termloom.operators.events import DEBOUNCE_SECONDS

# Quiet times after which a burst that never pauses is sent all the same.
LONGEST_WAIT = 10
# Changes that say the same as the primitive actions.
_AS_CHANGE = {"put": "modify", "delete": "delete", "delete_prefix": "delete_dir", "put_dir": "create_dir"}


def read_feed(
    spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of Parquet rows landing in ``folder``."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


_LAST = "seq long, ts timestamp, action string, since long"
_CHANGES = "seq long, ts timestamp, op string, path string, old_path string"


def _last_per_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last action per path of each batch of rows, before they are shuffled."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).append_column("n", pa.array(range(batch.num_rows)))
        order = table.sort_by([("seq", "ascending"), ("n", "ascending")])
        last = order.drop_columns("n").append_column("n", pa.array(range(batch.num_rows)))
        places = last.group_by(["path", "folder"]).aggregate([("n", "max")]).column("n_max")
        yield from last.take(places).drop_columns("n").combine_chunks().to_batches()


def debounced(
    changes: DataFrame, extensions: list[str], seconds: float = DEBOUNCE_SECONDS,
) -> DataFrame:
    """Streaming changes with bursts to one path reduced to their last one.

    Bursts go by arrival, so no change is too late or too early: every one is in
    some burst. A path's burst ends when nothing has arrived for ``seconds``, by a
    timer of its own, or ``LONGEST_WAIT`` times that after it began, so a file that
    is always written is indexed as well. The last change of a burst is the one
    that arrived last; what arrives in one batch goes by ``seq``. Renames are split
    first, so neither half can hide the other. Timers need a stream that goes on: a
    run over what is there would never end.
    """
    single = expand(changes, extensions, keep=["ts"]).filter("path is not null")
    folder = F.col("action").isin("delete_prefix", "put_dir")
    rows = single.select("seq", "ts", "action", "path", folder.alias("folder"))
    combined = rows.mapInArrow(_last_per_path, rows.schema)
    quiet = max(1, int(seconds * 1000))

    def change(path: str, last: tuple) -> pd.DataFrame:
        return pd.DataFrame({
            "seq": [last[0]], "ts": [last[1]], "op": [_AS_CHANGE[last[2]]], "path": [path], "old_path": [None],
        })

    def burst(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            last = state.get
            state.remove()
            yield change(key[0], last)
            return
        newest = None
        for frame in frames:
            row = frame.loc[frame["seq"].idxmax()]
            if newest is None or row["seq"] >= newest[0]:
                newest = (int(row["seq"]), None if pd.isna(row["ts"]) else row["ts"], row["action"])
        since = state.get[3] if state.exists else now
        if now - since >= LONGEST_WAIT * quiet:
            if state.exists:
                state.remove()
            yield change(key[0], newest)
        else:
            state.update((*newest, since))
            state.setTimeoutDuration(quiet)

    return combined.groupBy("path", "folder").applyInPandasWithState(
        burst, _CHANGES, _LAST, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
