"""The searchable index: in memory, or as Parquet tables under a manifest.

Stored layout, below one root folder::

    postings/seg=N/attempt=A/bucket=B/   term, path, tf, positions, dl
    terms/seg=N/attempt=A/bucket=B/      term, df
    tombstones/seg=N/attempt=A/          path, dl of documents segment N ends
    quarantine/seg=N/attempt=A/          changes set aside, and why
    manifest/<snapshot>.json             segments, totals, applied batches

Every attempt to write a segment has its own folder, so an attempt that fails
or loses to another writer cannot harm what a manifest already names.
Bucket -1 of ``postings`` holds the document rows. A document is live when no
tombstone of its path is newer than its segment. Files are never changed once
a manifest names them, so an open index keeps reading the snapshot it opened.
One writer at a time; where renaming onto an existing file fails (HDFS, local
disks) a second one fails at the manifest instead of overwriting it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from termloom import schemas
from termloom.functions.paths import is_target
from termloom.operators import changes as C
from termloom.operators.joins import BROADCAST_BYTES, ROW_BYTES, sieve
from termloom.operators.postings import DOCUMENT_BUCKET, bucket_of, build_entries, is_document, pack, term_stats, unpack
from termloom.session import settings
from termloom.sources import storage

TASK_BYTES = 1 << 30  # text behind one reduce partition, at most
FINE_BYTES, FINE_TASKS = 16 << 20, 1024  # and while there are not too many of them
MIN_BUCKETS, MAX_BUCKETS = 16, 4096
MAX_TASKS = 20_000  # reduce partitions of one shuffle
SEGMENT_BYTES = MAX_TASKS * TASK_BYTES  # text behind one segment of a build
SPREAD_BYTES = 64 << 30  # text that may be moved once more before it is tokenised
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
PACKING = 4  # so many times smaller is a posting that is packed, about
UNKNOWN_BYTES = 1 << 60  # Spark's estimates from here on say that it does not know
TOKEN_BYTES = 8  # text behind one token, for layouts of what is indexed already


class CommitConflict(RuntimeError):
    """Another writer published this snapshot first."""


@dataclass(frozen=True)
class Applied:
    """An updated index and the changes that were set aside."""

    index: "MemoryIndex | StoredIndex"
    rejected: DataFrame


def _wanted(words: tuple[str, ...] | None, ranges: Column | None) -> Column | None:
    """Scan condition on ``term``; None when the whole table is wanted."""
    if words is None:
        return None
    # As one SQL text, since thousands of literals made one by one take seconds.
    listed = F.expr("term IN (%s)" % ",".join(map(_quoted, words))) if words else F.lit(False)
    return listed if ranges is None else listed | ranges


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _totals(docs: DataFrame) -> tuple[int, int, int]:
    """Documents, tokens, bytes of the longest path."""
    longest = F.coalesce(F.max(F.octet_length("path")), F.lit(0))
    return tuple(map(int, docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0)), longest).first()))


class _Totals:
    n_docs: int
    n_tokens: int
    longest_path: int  # bytes, deleted documents included

    @property
    def avg_dl(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


def _live(rows: DataFrame, ended: DataFrame | None) -> DataFrame:
    """Rows whose path has no tombstone of a later segment."""
    if ended is None:
        return rows
    return _met(rows, ended, "left_anti")


def _met(rows: DataFrame, ended: DataFrame, how: str) -> DataFrame:
    ended = ended.select(F.col("path").alias("_path"), F.col("seg").alias("_seg"))
    newer = (F.col("path") == F.col("_path")) & (F.col("_seg") > F.col("seg"))
    return rows.join(ended, newer, how)


class MemoryIndex(_Totals):
    """An index held as persisted DataFrames for the length of a session.

    An update adds a layer and the paths it ends; earlier layers are shared.
    """

    def __init__(self, layers: list[DataFrame], ended: list[DataFrame], totals: tuple[int, int, int]):
        self.spark = layers[0].sparkSession
        self._layers, self._ended = layers, ended
        self.n_docs, self.n_tokens, self.longest_path = totals

    @classmethod
    def build(cls, corpus: DataFrame, extensions: list[str] | None = None) -> "MemoryIndex":
        entries = build_entries(_filtered(corpus, extensions)).persist(StorageLevel.MEMORY_AND_DISK)
        return cls([entries], [], _totals(entries.filter(is_document())))

    def close(self) -> None:
        """Give the layers' memory back; indexes that share them compute theirs anew."""
        for rows in [*self._layers, *self._ended]:
            rows.unpersist()

    def _rows(self, condition: Column) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [
            layer.filter(condition).withColumn("seg", F.lit(seg))
            for seg, layer in enumerate(self._layers)
        ])
        ended = reduce(DataFrame.unionByName, self._ended) if self._ended else None
        return _live(rows, ended).drop("seg")

    @property
    def docs(self) -> DataFrame:
        return self._rows(is_document()).select("path", "dl")

    def postings_for(self, words=None, ranges=None) -> DataFrame:
        wanted = _wanted(words, ranges)
        return self._rows(~is_document() if wanted is None else ~is_document() & wanted)

    def terms_for(self, words=None, ranges=None) -> DataFrame:
        return term_stats(self.postings_for(words, ranges))

    def apply(self, changes: DataFrame, corpus: DataFrame, extensions: list[str]) -> Applied:
        """A new index with ``changes`` folded in; this one stays as it is."""
        good, bad = C.split_loadable(changes, corpus, extensions)
        resolved = C.resolve(C.expand(good, extensions), corpus, extensions)
        ended = C.touched(self.docs, resolved).withColumn("seg", F.lit(len(self._layers)))
        added = build_entries(C.content_of(corpus, resolved))
        ended, added = (df.persist(StorageLevel.MEMORY_AND_DISK) for df in (ended, added))
        (gone, gone_tokens, _), (new, new_tokens, longest) = _totals(ended), _totals(added.filter(is_document()))
        totals = (
            self.n_docs - gone + new, self.n_tokens - gone_tokens + new_tokens, max(self.longest_path, longest)
        )
        return Applied(MemoryIndex([*self._layers, added], [*self._ended, ended], totals), bad)


@dataclass(frozen=True)
class Segment:
    seg: int
    attempt: str
    buckets: int
    tombstones: int = 0  # bytes of the paths this segment ends
    longest_path: int = 1 << 20  # bytes; where a manifest does not say, a path may be long

    @property
    def folder(self) -> str:
        return f"seg={self.seg:09d}/attempt={self.attempt}"


@dataclass(frozen=True)
class Snapshot:
    snapshot: int = 0
    segments: tuple[Segment, ...] = field(default_factory=tuple)
    n_docs: int = 0
    n_tokens: int = 0
    batches: dict[str, int] = field(default_factory=dict)  # last applied batch of each stream
    last_seq: int = -1
    quarantined: tuple[str, ...] = ()  # folders of changes set aside, kept over rewrites

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> "Snapshot":
        raw = json.loads(text)
        raw["segments"] = tuple(Segment(**s) for s in raw["segments"])
        raw["quarantined"] = tuple(raw["quarantined"])
        return cls(**raw)


class StoredIndex(_Totals):
    """An index on disk, read at one snapshot."""

    def __init__(self, spark: SparkSession, root: str, snapshot: Snapshot):
        self.spark, self.root, self.snapshot = spark, root.rstrip("/"), snapshot
        self.n_docs, self.n_tokens = snapshot.n_docs, snapshot.n_tokens
        self.longest_path = max((s.longest_path for s in snapshot.segments), default=0)
        self._scans: dict[tuple[str, int], DataFrame] = {}
        self._dead: Callable[[DataFrame], DataFrame] | None = None

    # -- opening and building ------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, root: str, snapshot: int | None = None) -> "StoredIndex":
        """Open the latest (or a given) snapshot; a new root opens empty."""
        names = [n for n in storage.list_names(spark, f"{root}/manifest") if n.endswith(".json")]
        if snapshot is not None:
            names = [n for n in names if n == _manifest_name(snapshot)]
            if not names:
                raise ValueError(f"no snapshot {snapshot} in {root}")
        if not names:
            return cls(spark, root, Snapshot())
        text = storage.read_text(spark, f"{root}/manifest/{names[-1]}")
        return cls(spark, root, Snapshot.from_json(text))

    def refresh(self) -> "StoredIndex":
        return StoredIndex.open(self.spark, self.root)

    def build(
        self, corpus: DataFrame, extensions: list[str] | None = None, buckets: int | None = None,
        feed_start: int = -1,
    ) -> "StoredIndex":
        """Index the whole corpus and publish it in place of what is there.

        ``buckets`` divides terms and follows the corpus size unless given; a
        corpus above ``SEGMENT_BYTES`` is built as several segments, by a hash
        of the path, so that no shuffle has too many partitions. ``feed_start``
        is the last change the corpus already contains. Streams start anew:
        whatever batch they bring next is applied.
        """
        kept = _filtered(corpus, extensions)
        segments, n_docs, n_tokens = self._write_parts(
            kept, layout_for(input_bytes(corpus)), buckets, build_entries
        )
        return self._publish(
            segments=segments, n_docs=n_docs, n_tokens=n_tokens, batches={}, last_seq=feed_start
        )

    # -- reading ----------------------------------------------------------------

    @property
    def docs(self) -> DataFrame:
        """Live documents ``(path, dl)``."""
        return self._live(self._documents().select("path", "dl", "seg")).select("path", "dl")

    def _documents(self) -> DataFrame:
        return self._read("postings", schemas.POSTINGS, F.lit(DOCUMENT_BUCKET) == F.col("bucket"))

    def postings_for(self, words=None, ranges=None) -> DataFrame:
        """Live postings, narrowed to the buckets and terms asked for."""
        rows = self._read("postings", schemas.POSTINGS, F.col("bucket") >= 0, words, ranges)
        return self._live(rows, many=True).drop("seg")

    def terms_for(self, words=None, ranges=None) -> DataFrame:
        """Live document frequencies ``(term, df)``, narrowed likewise."""
        if any(s.tombstones for s in self.snapshot.segments):
            return term_stats(self.postings_for(words, ranges))
        rows = self._read("terms", schemas.TERMS, F.col("bucket") >= 0, words, ranges)
        if len(self.snapshot.segments) == 1:
            return rows.select("term", "df")
        return rows.groupBy("term").agg(F.sum("df").alias("df"))

    def _scan(self, table: str, schema: T.StructType, buckets: int) -> DataFrame:
        """Segments with the same number of buckets, as one listed scan.

        The files of a snapshot never change, so they are listed once.
        """
        if (table, buckets) not in self._scans:
            paths = [
                f"{self.root}/{table}/{s.folder}"
                for s in self.snapshot.segments if s.buckets == buckets
            ]
            self._scans[table, buckets] = self.spark.read.schema(schema).option(
                "basePath", f"{self.root}/{table}"
            ).parquet(*paths)
        return self._scans[table, buckets]

    def _read(self, table, schema, condition, words=None, ranges=None) -> DataFrame:
        full = T.StructType([
            *schema.fields, T.StructField("seg", T.LongType()), T.StructField("bucket", T.IntegerType()),
        ])
        parts = []
        for buckets in sorted({s.buckets for s in self.snapshot.segments}):
            rows = self._scan(table, full, buckets).filter(condition)
            if words and ranges is None:
                homes = {zlib.crc32(w.encode()) % buckets for w in words}
                rows = rows.filter(F.col("bucket").isin(sorted(homes)))
            parts.append(rows.drop("bucket", "attempt"))
        if not parts:
            return self.spark.createDataFrame([], full).drop("bucket")
        rows = reduce(DataFrame.unionByName, parts)
        wanted = _wanted(words, ranges)
        return rows if wanted is None else rows.filter(wanted)

    def _live(self, rows: DataFrame, many: bool = False) -> DataFrame:
        """Live ``rows``; of ``many`` for a document, none is shuffled to meet tombstones that cannot be broadcast."""
        paths = [
            f"{self.root}/tombstones/{s.folder}" for s in self.snapshot.segments if s.tombstones
        ]
        if not paths:
            return rows
        schema = T.StructType([*schemas.TOMBSTONES.fields, T.StructField("seg", T.LongType())])
        ended = self.spark.read.schema(schema).option(
            "basePath", f"{self.root}/tombstones"
        ).parquet(*paths)
        # Their size was counted when they were committed.
        small = sum(s.tombstones for s in self.snapshot.segments) <= BROADCAST_BYTES
        if small or not many:
            return _live(rows, F.broadcast(ended.select("path", "seg")) if small else ended)
        key = F.struct("path", "seg").alias("_document")
        if self._dead is None:
            documents = self._documents().select("path", "seg")
            dead = _met(documents, ended, "left_semi").select(key)
            self._dead = sieve(dead, documents.select(key), "_document", "_document.path")
        if self._dead is None:
            return _live(rows, ended)
        return self._dead(rows.select("*", key)).filter("NOT _listed").drop("_document", "_listed")

    # -- changing ---------------------------------------------------------------

    def apply(
        self, changes: DataFrame, corpus: DataFrame, extensions: list[str],
        batch_id: int | None = None, stream: str = "", buckets: int | None = None,
    ) -> Applied:
        """Fold ``changes`` in and publish the result as one snapshot.

        A batch that ``stream`` brought already changes nothing, and neither
        does an empty batch. The segment is laid out like a build, from the
        text it takes in.
        """
        if batch_id is not None and batch_id <= self.snapshot.batches.get(stream, -1):
            return Applied(self, changes.withColumn("reason", F.lit("")).limit(0))
        changes, pinned = C.pin(changes)
        good, bad = C.split_loadable(changes, corpus, extensions, pinned)
        seen = good.select("seq", F.lit(0).alias("bad")).unionByName(bad.select("seq", F.lit(1).alias("bad")))
        seen = seen.coalesce(1) if pinned else seen
        last_seq, n_bad = seen.agg(F.max("seq"), F.coalesce(F.sum("bad"), F.lit(0))).first()
        if last_seq is None:
            return Applied(self, bad)
        resolved = C.resolve(C.expand(good, extensions), corpus, extensions, pinned)
        added = C.content_of(corpus, resolved)
        size = _text_bytes(added)
        layout = layout_for(size)
        if size > FINE_BYTES:  # less is one task's work
            added = _spread(added, size)
        segment = self._new_segment(buckets or layout.buckets)
        quarantine = f"quarantine/{segment.folder}"
        rejected = bad
        if n_bad:
            bad.write.parquet(f"{self.root}/{quarantine}")
            rejected = self.spark.read.schema(bad.schema).parquet(f"{self.root}/{quarantine}")
        # Counted by the tasks that write them.
        ended = Observation()
        with settings(self.spark, _passing()):
            (
                C.touched(self.docs, resolved).select("path", "dl")
                .observe(
                    ended, F.count(F.lit(1)).alias("docs"), F.sum("dl").alias("tokens"),
                    F.sum(F.octet_length("path") + ROW_BYTES).alias("bytes"),
                )
                .write.parquet(f"{self.root}/tombstones/{segment.folder}")
            )
        gone = ended.get
        added_docs, added_tokens, longest = self._write_segment(
            build_entries(added, segment.buckets), segment, layout.tasks
        )
        applied = {} if batch_id is None else {stream: batch_id}
        after = self._publish(
            segments=(
                *self.snapshot.segments, replace(segment, tombstones=gone["bytes"] or 0, longest_path=longest)
            ),
            n_docs=self.n_docs + added_docs - gone["docs"],
            n_tokens=self.n_tokens + added_tokens - (gone["tokens"] or 0),
            batches={**self.snapshot.batches, **applied},
            last_seq=max(self.snapshot.last_seq, int(last_seq)),
            quarantined=(*self.snapshot.quarantined, quarantine) if n_bad else self.snapshot.quarantined,
        )
        return Applied(after, rejected)

    def compact(self, buckets: int | None = None) -> "StoredIndex":
        """Rewrite the live rows without tombstones, in as few segments as a build.

        The layout is that of a build over as many tokens, unless given.
        """
        documents = self.docs.select(
            F.lit("").alias("term"), "path", F.lit(0).alias("tf"),
            F.array().cast("array<int>").alias("positions"), "dl",
        )
        segments, n_docs, n_tokens = self._write_parts(
            self.postings_for().unionByName(documents), layout_for(self.n_tokens * TOKEN_BYTES), buckets
        )
        return self._publish(segments=segments, n_docs=n_docs, n_tokens=n_tokens)

    def vacuum(self, keep: int = 1) -> None:
        """Delete what the latest ``keep`` snapshots do not need.

        Not while a writer is active or readers are on older snapshots.
        """
        manifest = f"{self.root}/manifest"
        names = [n for n in storage.list_names(self.spark, manifest) if n.endswith(".json")]
        kept = names[-max(keep, 1):]
        texts = [storage.read_text(self.spark, f"{manifest}/{n}") for n in kept]
        snapshots = [Snapshot.from_json(text) for text in texts]
        used = {f"{t}/{s.folder}" for x in snapshots for s in x.segments for t in ("postings", "terms", "tombstones")}
        used |= {folder for x in snapshots for folder in x.quarantined}
        for name in names[: len(names) - len(kept)]:
            storage.delete(self.spark, f"{manifest}/{name}")
        for table in ("postings", "terms", "tombstones", "quarantine"):
            for seg in storage.list_names(self.spark, f"{self.root}/{table}"):
                for attempt in storage.list_names(self.spark, f"{self.root}/{table}/{seg}"):
                    if f"{table}/{seg}/{attempt}" not in used:
                        storage.delete(self.spark, f"{self.root}/{table}/{seg}/{attempt}")

    def quarantine(self) -> DataFrame:
        """Changes set aside so far, also before a rebuild or a rewrite."""
        schema = T.StructType([
            *schemas.CHANGES.fields, T.StructField("reason", T.StringType()),
            T.StructField("seg", T.LongType()),
        ])
        folders = [f"{self.root}/{folder}" for folder in self.snapshot.quarantined]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option(
            "basePath", f"{self.root}/quarantine"
        ).parquet(*folders).drop("attempt")

    # -- writing ------------------------------------------------------------------

    def _new_segment(self, buckets: int) -> Segment:
        if storage.exists(self.spark, self._manifest(self.snapshot.snapshot + 1)):
            raise CommitConflict("the index has moved on: open it again and repeat")
        return Segment(self.snapshot.snapshot + 1, uuid.uuid4().hex, buckets)

    def _write_parts(
        self, rows: DataFrame, layout: "Layout", buckets: int | None,
        entries: Callable[[DataFrame, int], DataFrame] = lambda rows, buckets: rows,
    ) -> tuple[tuple[Segment, ...], int, int]:
        """Write ``rows`` as the segments of ``layout``, by a hash of the path; with documents and tokens."""
        segments, n_docs, n_tokens = [], 0, 0
        for part in range(layout.parts):
            mine = rows if layout.parts == 1 else rows.filter(
                F.pmod(F.xxhash64("path"), F.lit(layout.parts)) == part
            )
            segment = self._new_segment(buckets or layout.buckets)
            docs, tokens, longest = self._write_segment(entries(mine, segment.buckets), segment, layout.tasks)
            segments.append(replace(segment, longest_path=longest))
            n_docs, n_tokens = n_docs + docs, n_tokens + tokens
        return tuple(segments), n_docs, n_tokens

    def _write_segment(self, entries: DataFrame, segment: Segment, tasks: int) -> tuple[int, int, int]:
        """Write postings and terms of one segment; returns its totals.

        Rebalanced by bucket: adaptive execution measures every reduce
        partition, splits the large ones (hot terms, document rows) over several
        tasks and files, and joins small ones. Postings are packed for the shuffle,
        whose files go with the write they are for.
        """
        buckets, tasks = segment.buckets, shuffled_parts(self.spark, tasks)
        home = f"{self.root}/postings/{segment.folder}"
        # Above the last shuffle, so a task that is repeated counts once.
        totals = Observation()
        with settings(entries.sparkSession, {**_passing(), ADVISED: str(_advised_bytes(entries.sparkSession) // PACKING)}):
            (
                unpack(pack(entries, buckets).hint("rebalance", tasks, F.col("bucket")))
                .observe(
                    totals, F.count(F.when(is_document(), 1)).alias("docs"),
                    F.sum(F.when(is_document(), F.col("dl"))).alias("tokens"),
                    F.max(F.when(is_document(), F.octet_length("path"))).alias("longest"),
                )
                .sortWithinPartitions("bucket", "term", "path")
                .write.option("compression", "zstd").partitionBy("bucket").parquet(home)
            )
        full = T.StructType([*schemas.POSTINGS.fields, T.StructField("bucket", T.IntegerType())])
        written = self.spark.read.schema(full).parquet(home)
        with settings(self.spark, _passing()):
            (
                term_stats(written.filter("bucket >= 0"))
                .withColumn("bucket", bucket_of(F.col("term"), buckets))
                .hint("rebalance", min(tasks, buckets), F.col("bucket"))
                .sortWithinPartitions("bucket", "term")
                .write.option("compression", "zstd").partitionBy("bucket")
                .parquet(f"{self.root}/terms/{segment.folder}")
            )
        seen = totals.get
        return seen["docs"], seen["tokens"] or 0, seen["longest"] or 0

    def _publish(self, **changed) -> "StoredIndex":
        after = replace(self.snapshot, snapshot=self.snapshot.snapshot + 1, **changed)
        if not storage.publish_text(self.spark, self._manifest(after.snapshot), after.to_json()):
            raise CommitConflict("the index has moved on: open it again and repeat")
        return StoredIndex(self.spark, self.root, after)

    def _manifest(self, snapshot: int) -> str:
        return f"{self.root}/manifest/{_manifest_name(snapshot)}"


def _manifest_name(snapshot: int) -> str:
    return f"{snapshot:012d}.json"


def _filtered(corpus: DataFrame, extensions: list[str] | None) -> DataFrame:
    kept = corpus if extensions is None else corpus.filter(is_target(F.col("path"), extensions))
    return _spread(kept)


@dataclass(frozen=True)
class Layout:
    """How a corpus is divided: segments, term buckets, reduce partitions."""

    parts: int
    buckets: int
    tasks: int


def layout_for(text_bytes: int) -> Layout:
    """Text behind each reduce partition: ``FINE_BYTES`` up to ``FINE_TASKS`` of them, then up to ``TASK_BYTES``.

    A posting takes many times its text while it is sorted, so that a fine
    partition is sorted without a spill.
    """
    parts = max(1, -(-text_bytes // SEGMENT_BYTES))
    fine = min(-(-text_bytes // FINE_BYTES), FINE_TASKS)
    tasks = min(max(-(-text_bytes // (parts * TASK_BYTES)), fine, MIN_BUCKETS), MAX_TASKS)
    return Layout(parts, min(tasks, MAX_BUCKETS), tasks)


def shuffled_parts(spark: SparkSession, tasks: int) -> int:
    """Reduce partitions to shuffle into, for a layout of ``tasks`` of them.

    Into a few of them (``spark.shuffle.sort.bypassMergeThreshold``) a task writes each
    posting straight to its partition's file; for more it sorts all its postings first and
    spills them. The few are large, which is no loss as long as adaptive execution cuts
    them to size. Above ``FINE_TASKS`` that would make very many files, so there the
    layout stands.
    """
    cut = all(spark.conf.get(f"spark.sql.adaptive.{key}", "true").lower() == "true" for key in (
        "enabled", "optimizeSkewsInRebalancePartitions.enabled"
    ))
    few = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return min(tasks, max(few, MIN_BUCKETS)) if cut and tasks < FINE_TASKS else tasks


def _passing() -> dict[str, str]:
    """Settings of a write whose shuffle files go when it ends, and not when the driver collects its garbage."""
    return {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _advised_bytes(spark: SparkSession) -> int:
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ADVISED))
    return max(int(size), PACKING)


def _text_bytes(corpus: DataFrame) -> int:
    return int(corpus.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0])


def input_bytes(corpus: DataFrame) -> int:
    """Bytes of the tables a corpus reads; never the estimate of a join.

    Where Spark does not know them the text is measured.
    """
    leaves = corpus._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < UNKNOWN_BYTES else _text_bytes(corpus)


def _spread(corpus: DataFrame, size: int | None = None) -> DataFrame:
    """Redistribute a corpus of ``size`` bytes that is held in fewer files than there are cores.

    A file is split no finer than its row groups, and one may hold a million
    documents. A corpus in more files, or above ``SPREAD_BYTES``, is read as it
    lies and never moved before it is tokenised.
    """
    spark = corpus.sparkSession
    cores = spark.sparkContext.defaultParallelism
    per_task = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = input_bytes(corpus) if size is None else size
    # The list of files comes to the driver only for a corpus of a bounded size.
    if size > SPREAD_BYTES or not 0 < len(corpus._jdf.inputFiles()) < cores:
        return corpus
    return corpus.repartition(min(max(3 * cores, -(-size // per_task)), MAX_TASKS), "path")
