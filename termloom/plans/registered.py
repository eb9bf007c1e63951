"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import schemas
from termloom.functions import paths as P
from termloom.operators import changes as C
from termloom.operators import events as E
from termloom.operators import postings as O
from termloom.operators.clauses import Clause
from termloom.operators.nested import Group
from termloom.operators.ranking import with_status
from termloom.operators.ranking import hits_as_json as json_list
from termloom.plans import bindings as B
from termloom.plans.index import StoredIndex
from termloom.plans.search import search, search_keywords
from termloom.plans.search import search_nested as nested_hits
from termloom.sources import corpus as S
from termloom.streaming.apply import apply_stream
from termloom.streaming.feed import read_feed
from termloom.streaming.watch import TreeWatch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Fixed values of the search queries.
WORDS = ["trash", "bleble", "aié", "thrend", "oror", "lynt", "the", "of"]


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


# -- sources and sinks -------------------------------------------------------


@query
def corpus_scan(spark, sf_dir):
    """Write the documents as a tree of text files, then scan that tree."""
    root = B.new_root(spark, "tree")
    (
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text")
        .write.partitionBy("source", "lang").option("maxRecordsPerFile", 1000).text(root)
    )
    tokens = O.doc_lengths(S.load_directory(spark, root, ["txt"]))
    return tokens.groupBy(
        F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("source"),
        F.regexp_extract("path", r"/lang=([^/]+)/", 1).alias("lang"),
    ).agg(F.sum("dl").alias("n_tokens"))


LONGEST_FILE = 20_000  # so that some documents are set aside as too long


@query
def corpus_rejects(spark, sf_dir):
    """One file per document; every third ends in bytes that are no text, long ones stay unread."""
    root = B.new_root(spark, "rejects")
    raw = F.encode("text", "utf-8")
    spoilt = F.concat(raw, F.lit(b"\xff\xfe"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    B.write_files(docs.select("doc_id", F.when(F.col("doc_id") % 3 == 2, spoilt).otherwise(raw).alias("content")), root)
    rejected = S.rejected_files(spark, root, ["txt"], LONGEST_FILE)
    doc_id = F.regexp_extract("path", r"/doc_id=(\d+)\.txt$", 1).cast("long").alias("doc_id")
    return rejected.select(doc_id, "n_bytes", "reason")


@query
def load_by_path(spark, sf_dir):
    """Content of every path named by a change, as far as the tree has it."""
    named = B.changes(spark, sf_dir).filter("path IS NOT NULL").select("path").distinct()
    return S.load_by_path(named, B.current_corpus(spark, sf_dir))


@query
def index_roundtrip(spark, sf_dir):
    """Write an index, open it again, and read terms with their counts."""
    built = B.stored_index(spark, sf_dir)
    index = StoredIndex.open(spark, built.root)
    counts = index.postings_for().groupBy("term").agg(F.sum("tf").alias("n_tokens"))
    return index.terms_for().join(counts, "term").select("term", "df", "n_tokens")


@query
def index_in_memory(spark, sf_dir):
    index = B.memory_index(spark, sf_dir)
    return search(index, [Clause(i, 0, terms=[w]) for i, w in enumerate(WORDS)])


@query
def hits_as_json(spark, sf_dir):
    return json_list(search_keywords(B.stored_index(spark, sf_dir), B.keyword_queries(spark, sf_dir)))


@query
def search_status(spark, sf_dir):
    """Every query with its answer; reversed texts find next to nothing."""
    texts = B.keyword_queries(spark, sf_dir)
    backwards = texts.select((-1 - F.col("qid")).alias("qid"), F.reverse("keyword").alias("keyword"))
    queries = texts.unionByName(backwards).unionByName(
        spark.range(1).select(F.lit(-1000).cast("long").alias("qid"), F.lit("qqqqxxxx").alias("keyword"))
    )
    return with_status(queries, search_keywords(B.stored_index(spark, sf_dir), queries))


# -- paths ---------------------------------------------------------------------


@query
def filter_extension(spark, sf_dir):
    corpus = S.documents(spark, sf_dir).unionByName(S.pages(spark, sf_dir)).unionByName(
        S.conversations(spark, sf_dir)
    )
    path = F.col("path")
    return corpus.select(
        "path", P.extension(path).alias("extension"),
        P.is_target(path, P.parse_extensions("txt, md")).alias("is_target"),
    )


@query
def normalize_path(spark, sf_dir):
    raw = B.raw_events(spark, sf_dir).select("seq", F.posexplode("paths").alias("n", "raw_path"))
    dotted = F.concat(F.lit("."), F.col("raw_path"), F.lit("/./"))
    return raw.select(
        "seq", "n", P.normalize(F.col("raw_path")).alias("path"), P.normalize(dotted).alias("dotted")
    )


@query
def filter_path_prefix(spark, sf_dir):
    docs = S.documents(spark, sf_dir)
    return docs.filter(P.under(F.col("path"), F.lit("/src1"))).select("path")


@query
def delete_prefix_count(spark, sf_dir):
    """How many documents each deleted folder takes with it."""
    folders = (
        B.changes(spark, sf_dir).filter("op = 'delete_dir'")
        .select(F.col("path").alias("prefix")).distinct()
    )
    docs = B.stored_index(spark, sf_dir).docs.select("path")
    return C.covered_counts(docs, folders)


@query
def expand_renames(spark, sf_dir):
    changes = B.changes(spark, sf_dir)
    return C.expand(changes.filter("op = 'rename'"), P.parse_extensions(P.DEFAULT_EXTENSIONS))


# -- analysis and index build ----------------------------------------------------


@query
def tokenize(spark, sf_dir):
    return O.tokenize(S.documents(spark, sf_dir))


@query
def tokenize_pages(spark, sf_dir):
    return O.tokenize(S.pages(spark, sf_dir))


@query
def build_postings(spark, sf_dir):
    return O.build_postings(S.documents(spark, sf_dir)).select(
        "term", "path", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), "dl"
    )


@query
def doc_lengths(spark, sf_dir):
    return O.doc_lengths(S.conversations(spark, sf_dir))


@query
def term_stats(spark, sf_dir):
    return O.term_stats(O.build_postings(S.documents(spark, sf_dir)))


@query
def corpus_stats(spark, sf_dir):
    return O.doc_lengths(S.documents(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("dl"), 6).alias("avg_dl")
    )


@query
def build_index(spark, sf_dir):
    """Scan, filter, index and commit; the documents the index then holds."""
    index = StoredIndex.open(spark, B.new_root(spark, "build"))
    return index.build(S.documents(spark, sf_dir), P.parse_extensions(P.DEFAULT_EXTENSIONS)).docs


# -- index upkeep ------------------------------------------------------------------


def _after(spark, sf_dir, *ops: str) -> DataFrame:
    """Documents of a stored index once all changes of some kinds are in."""
    changes = B.changes(spark, sf_dir).filter(F.col("op").isin(*ops))
    corpus = B.current_corpus(spark, sf_dir)
    return B.own_index(spark, sf_dir).apply(changes, corpus, B.ALL_EXTENSIONS).index.docs


@query
def apply_create(spark, sf_dir):
    return _after(spark, sf_dir, "create", "create_dir")


@query
def apply_modify(spark, sf_dir):
    return _after(spark, sf_dir, "modify")


@query
def apply_delete(spark, sf_dir):
    return _after(spark, sf_dir, "delete")


@query
def apply_delete_prefix(spark, sf_dir):
    return _after(spark, sf_dir, "delete_dir")


@query
def apply_rename(spark, sf_dir):
    return _after(spark, sf_dir, "rename")


@query
def apply_rename_dir(spark, sf_dir):
    return _after(spark, sf_dir, "rename_dir")


@query
def fold_change_log(spark, sf_dir):
    """Documents after the whole change log, from ``documents`` onwards."""
    corpus = B.current_corpus(spark, sf_dir)
    good, _ = C.split_loadable(B.changes(spark, sf_dir), corpus, B.ALL_EXTENSIONS)
    final = C.fold(S.documents(spark, sf_dir), good, corpus, B.ALL_EXTENSIONS)
    return final.select("path", F.md5(F.col("content").cast("binary")).alias("hash"))


@query
def commit_visibility(spark, sf_dir):
    """Terms seen by a reader opened before a commit and by one after it."""
    root = B.new_root(spark, "commit")
    before = StoredIndex.open(spark, root).build(S.documents(spark, sf_dir))
    after = before.apply(
        B.changes(spark, sf_dir), B.current_corpus(spark, sf_dir), B.ALL_EXTENSIONS
    ).index
    return before.terms_for().select(F.lit("before").alias("reader"), "term", "df").unionByName(
        after.terms_for().select(F.lit("after").alias("reader"), "term", "df")
    )


@query
def compacted_index(spark, sf_dir):
    """The same changes, then a rewrite into one segment without tombstones."""
    root = B.new_root(spark, "compact")
    index = StoredIndex.open(spark, root).build(S.documents(spark, sf_dir)).apply(
        B.changes(spark, sf_dir), B.current_corpus(spark, sf_dir), B.ALL_EXTENSIONS
    ).index.compact()
    return index.postings_for().groupBy("path").agg(
        F.count(F.lit(1)).alias("n_terms"), F.max("dl").alias("dl")
    )


@query
def pending_changes(spark, sf_dir):
    """Changes by kind that an index has yet to see; its build saw the older half."""
    changes = B.changes(spark, sf_dir)
    seen = changes.agg(F.max("seq")).first()[0] // 2
    index = StoredIndex.open(spark, B.new_root(spark, "pending")).build(S.documents(spark, sf_dir), feed_start=seen)
    return C.pending(changes, StoredIndex.open(spark, index.root).snapshot.last_seq)


# -- search ----------------------------------------------------------------------


@query
def search_term(spark, sf_dir):
    return search(B.stored_index(spark, sf_dir), [Clause(i, 0, terms=[w]) for i, w in enumerate(WORDS)])


@query
def search_any(spark, sf_dir):
    return search_keywords(B.stored_index(spark, sf_dir), B.keyword_queries(spark, sf_dir))


@query
def search_topk(spark, sf_dir):
    """The same queries with a longer list of results."""
    return search_keywords(B.stored_index(spark, sf_dir), B.keyword_queries(spark, sf_dir), k=100)


@query
def search_all(spark, sf_dir):
    groups = [["the", "of"], ["trash", "the"], ["the", "lynt", "of"], ["trash", "aié"]]
    return search(B.stored_index(spark, sf_dir), [
        Clause(q, i, "must", terms=[w]) for q, ws in enumerate(groups) for i, w in enumerate(ws)
    ] + [Clause(2, 9, "should", terms=["thrend"])])


@query
def search_exclude(spark, sf_dir):
    return search(B.stored_index(spark, sf_dir), [
        Clause(0, 0, "should", terms=["the"]), Clause(0, 1, "must_not", terms=["of"]),
        Clause(1, 0, "should", terms=["trash"]), Clause(1, 1, "should", terms=["lynt"]),
        Clause(1, 2, "must_not", kind="phrase", terms=["of the"]),
    ])


@query
def search_phrase(spark, sf_dir):
    return search(B.stored_index(spark, sf_dir), B.phrase_queries(spark, sf_dir))


@query
def search_phrase_slop(spark, sf_dir):
    return search(B.stored_index(spark, sf_dir), [
        Clause(0, 0, kind="phrase", terms=["of the"], slop=2),
        Clause(1, 0, kind="phrase", terms=["the of and"], slop=5),
        Clause(2, 0, kind="phrase", terms=["the the"], slop=3),
        Clause(3, 0, kind="phrase", terms=["of the"], slop=0),
    ])


@query
def search_phrase_prefix(spark, sf_dir):
    return search(B.stored_index(spark, sf_dir), [
        Clause(0, 0, kind="phrase_prefix", terms=["of th"]),
        Clause(1, 0, kind="phrase_prefix", terms=["in the a"]),
        Clause(2, 0, kind="phrase_prefix", terms=["tras"]),
    ])


@query
def search_term_set(spark, sf_dir):
    return search(B.stored_index(spark, sf_dir), [
        Clause(0, 0, kind="term_set", terms=["trash", "oror"]),
        Clause(1, 0, kind="term_set", terms=["the", "lynt", "aié"], boost=2.0),
        Clause(1, 1, "must", terms=["bleble"]),
    ])


@query
def search_term_range(spark, sf_dir):
    return search(B.stored_index(spark, sf_dir), [
        Clause(0, 0, kind="term_range", terms=["tra", "tre"], bounds="[}"),
        Clause(1, 0, kind="term_range", terms=["w", None]),
        Clause(2, 0, kind="term_range", terms=["trash", "trash"]),
        Clause(3, 0, kind="term_range", terms=["aié", "b"], bounds="{}"),
        Clause(3, 1, "must", terms=["thrend"]),
    ])


@query
def search_boost(spark, sf_dir):
    return search(B.stored_index(spark, sf_dir), [
        Clause(0, 0, terms=["the"]), Clause(0, 1, terms=["trash"], boost=2.5),
        Clause(1, 0, terms=["lynt"], boost=0.5), Clause(1, 1, kind="phrase", terms=["of the"], boost=3.0),
    ])


@query
def search_match_all(spark, sf_dir):
    return search(B.stored_index(spark, sf_dir), [
        Clause(0, 0, kind="match_all"),
        Clause(1, 0, kind="match_all"), Clause(1, 1, "must_not", terms=["the"]),
        Clause(2, 0, "must", kind="match_all", boost=2.0), Clause(2, 1, terms=["trash"]),
    ], k=200)


@query
def search_by_path(spark, sf_dir):
    return search(B.stored_index(spark, sf_dir), B.path_queries(spark, sf_dir))


@query
def search_nested(spark, sf_dir):
    """``(trash OR lynt) AND the``, and ``(trash lynt) OR ("of the" -in)``."""
    groups = [
        Group(0, 0), Group(0, 1, 0, "must"), Group(0, 2, 0, "must"),
        Group(1, 0), Group(1, 1, 0), Group(1, 2, 0),
    ]
    return nested_hits(B.stored_index(spark, sf_dir), groups, [
        (1, Clause(0, 0, terms=["trash"])), (1, Clause(0, 1, terms=["lynt"])), (2, Clause(0, 2, terms=["the"])),
        (1, Clause(1, 0, "must", terms=["trash"])), (1, Clause(1, 1, "must", terms=["lynt"])),
        (2, Clause(1, 2, kind="phrase", terms=["of the"])), (2, Clause(1, 3, "must_not", terms=["in"])),
    ])


@query
def search_nested_table(spark, sf_dir):
    """For every benchmark text, ``(first word OR second word) AND NOT (third AND fourth)``."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("qid"), F.posexplode(F.slice(F.split("text", r"[^a-zA-Z]+"), 1, 4)).alias("clause_id", "word")
    ).filter("word <> ''")
    clauses = words.select(
        "qid", F.when(F.col("clause_id") < 2, 1).otherwise(2).cast("long").alias("group_id"), "clause_id",
        F.when(F.col("clause_id") < 2, "should").otherwise("must").alias("occur"), F.lit("term").alias("kind"),
        F.array("word").alias("terms"), F.lit(0).alias("slop"), F.lit(1.0).alias("boost"), F.lit("[]").alias("bounds"),
    )
    tree = F.expr("""array(named_struct('group_id', 0L, 'parent_id', CAST(NULL AS BIGINT), 'occur', 'should'),
        named_struct('group_id', 1L, 'parent_id', 0L, 'occur', 'must'),
        named_struct('group_id', 2L, 'parent_id', 0L, 'occur', 'must_not'))""")
    groups = words.select("qid").distinct().select("qid", F.inline(tree))
    return nested_hits(B.stored_index(spark, sf_dir), groups, clauses)


@query
def search_updated_index(spark, sf_dir):
    """Search after a change batch: tombstones and new segments count."""
    root = B.new_root(spark, "updated")
    index = StoredIndex.open(spark, root).build(S.documents(spark, sf_dir)).apply(
        B.changes(spark, sf_dir), B.current_corpus(spark, sf_dir), B.ALL_EXTENSIONS
    ).index
    return search_keywords(index, B.keyword_queries(spark, sf_dir))


# -- change feed and streaming -------------------------------------------------------


@query
def stream_changes(spark, sf_dir):
    """The event table read as a stream, classified, and landed as a table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    feed = read_feed(spark, sf_dir, schema, glob="events.parquet")
    out = B.new_root(spark, "changes")
    stream = E.classify(B.raw_events(spark, sf_dir, feed)).writeStream.format("parquet").option(
        "checkpointLocation", f"{out}-progress"
    )
    stream.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(schemas.CHANGES).parquet(out).select("seq", "op", "path", "old_path")


@query
def stream_apply(spark, sf_dir):
    """The same stream folded into an index; the documents it ends with."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    feed = read_feed(spark, sf_dir, schema, glob="events.parquet")
    root = B.new_root(spark, "stream")
    StoredIndex.open(spark, root).build(S.documents(spark, sf_dir))
    apply_stream(
        E.classify(B.raw_events(spark, sf_dir, feed)), root,
        lambda: B.current_corpus(spark, sf_dir), B.ALL_EXTENSIONS, f"{root}/progress",
        available_now=True,
    ).awaitTermination()
    return StoredIndex.open(spark, root).docs


@query
def watch_tree(spark, sf_dir):
    """One file per document, watched while they are edited, deleted, moved and added."""
    root, home = f"{B.new_root(spark, 'tree')}/files", B.new_root(spark, "watch")
    docs = S.documents(spark, sf_dir).filter("path IS NOT NULL").select(
        "path", F.coalesce("content", F.lit("")).alias("content"), F.lit(None).cast("string").alias("moved_to"),
        F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id"),
    )
    part = F.col("doc_id") % 7
    B.change_files(docs.filter(part != 3), root)
    watch = TreeWatch(spark, root, home, B.ALL_EXTENSIONS)
    watch.poll()
    edited = F.when(part == 0, F.concat("content", F.lit(" fin"))).when(part == 3, F.col("content"))
    moved = F.when(part == 2, F.concat(F.lit("/moved"), "path"))
    B.change_files(docs.filter(part < 4).withColumn("content", edited).withColumn("moved_to", moved), root)
    watch.poll()
    feed = f"{home}/feed"
    C.expand(watch.changes(), B.ALL_EXTENSIONS).writeStream.format("parquet").option(
        "checkpointLocation", f"{home}/progress"
    ).trigger(availableNow=True).start(feed).awaitTermination()
    told = spark.read.schema("seq long, action string, path string").parquet(feed)
    return told.withColumn("path", F.regexp_extract("path", r"/tree-[0-9a-f]{32}/files(/.*)$", 1))


@query
def snapshot_diff(spark, sf_dir):
    return E.snapshot_diff(*B.listings(spark, sf_dir))


@query
def classify_events(spark, sf_dir):
    return B.changes(spark, sf_dir).withColumn("ts", F.unix_micros("ts"))


@query
def debounce(spark, sf_dir):
    """Bursts of changes to one path, two hours being quiet."""
    bursts = E.debounce(B.changes(spark, sf_dir).filter("path IS NOT NULL"), "path", 7200)
    return bursts.select(
        "path", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"),
        "n", "seq", "op",
    )


@query
def batch_changes(spark, sf_dir):
    """The batch of every event, five minutes being idle."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"), B.utc(F.col("ts")).alias("ts")
    )
    return E.form_batches(events, 300).select("seq", "group_no", "batch_no")


@query
def quarantine(spark, sf_dir):
    """Changes that could not be applied, with the reason."""
    _, bad = C.split_loadable(
        B.changes(spark, sf_dir), B.current_corpus(spark, sf_dir), B.ALL_EXTENSIONS
    )
    return bad.select("seq", "op", "path", "old_path", "reason")
