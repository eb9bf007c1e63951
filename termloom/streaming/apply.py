"""A change stream folded into a stored index, batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from termloom.plans.index import StoredIndex
from termloom.sources import storage
from termloom.streaming.feed import debounced

# Fixed value: how often a live stream forms a batch.
TRIGGER = "500 milliseconds"


def apply_stream(
    changes: DataFrame, root: str, corpus: Callable[[], DataFrame], extensions: list[str],
    checkpoint: str, available_now: bool = False, trigger: str = TRIGGER, quiet_seconds: float | None = None,
) -> StreamingQuery:
    """Start folding streaming ``changes`` into the index at ``root``.

    ``corpus`` is called per batch, so each batch sees current content. The
    stream's identity (kept in its checkpoint) and batch number go into the
    manifest with the data, so a batch replayed after a failure changes nothing,
    while a new stream or a rebuilt index starts from its first batch. Readers
    keep the snapshot they opened. With ``quiet_seconds`` bursts of changes to
    a path are reduced to their last one first, by their arrival; a run over what
    is there (``available_now``) waits for nothing, as each batch is reduced per
    path anyway. ``trigger`` sets how often a live stream forms a batch.
    """
    spark = changes.sparkSession
    if quiet_seconds is not None and not available_now:
        changes = debounced(changes, extensions, quiet_seconds)
        # Bursts that wait are part of this progress; a stream without them has its own.
        checkpoint = f"{checkpoint}/debounced"

    def fold(batch: DataFrame, batch_id: int) -> None:
        stream = json.loads(storage.read_text(spark, f"{checkpoint}/metadata"))["id"]
        batch.persist()
        try:
            StoredIndex.open(spark, root).apply(batch, corpus(), extensions, batch_id=batch_id, stream=stream)
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    timing = {"availableNow": True} if available_now else {"processingTime": trigger}
    return writer.trigger(**timing).start()
