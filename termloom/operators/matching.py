"""Which documents match which clauses, and with what score.

All queries of a table are evaluated by one job. Clause words meet postings
in one equi-join per clause family; boolean logic is one aggregation by
``(qid, path)``. Clause tables are broadcast only below a checked row count
(a term is under 40 bytes, so rows are small); larger ones are joined with
salting.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from termloom.functions.scoring import idf, saturation
from termloom.operators.clauses import analysed
from termloom.operators.joins import BROADCAST_BYTES, narrow, salted_join, split_by_keys
from termloom.operators.sums import best_sums
from termloom.session import shared_dir

BROADCAST_ROWS = 200_000
LITERAL_CLAUSES = 10_000
LITERAL_WORDS = 10_000
LOOSE_STEPS = 1 << 18  # positions compared for a loose phrase inside one row; longer documents go by windows
WHOLE_LISTS = 2  # lists are read whole when lookups are more than this part of them
SCORED_KINDS = ["term", "phrase", "phrase_prefix"]
CONSTANT_KINDS = ["term_set", "prefix", "term_range"]
PREFIX_KINDS = ["phrase_prefix", "prefix"]

CARRIED = ["qid", "clause_id", "occur", "boost", "n_must"]
HIT_COLUMNS = [*CARRIED, "path", "score"]


@dataclass(frozen=True)
class Prepared:
    """Analysed clauses and the facts that decide how they are joined."""

    clauses: DataFrame
    kinds: frozenset[str]
    small: bool  # clause words may be broadcast
    any_match: bool  # every clause of every query is optional
    sloppy: bool
    prefix_lengths: tuple[int, ...]
    words: tuple[str, ...] | None  # the words to look up, when few
    ranges: Column | None  # the same for prefixes and ranges, when few
    mixed: frozenset = frozenset()  # queries that are more than terms, when ``small``


def prepare(clauses: DataFrame) -> Prepared:
    """Analyse a clause table and look at it once.

    A query of exclusions only matches nothing, so it is left out here. A table of few clauses is pinned as a local relation and its words go to
    the scans as literals; a larger one stays distributed and only its
    counts come to the driver.
    """
    ready = analysed(clauses)
    head = ready.limit(LITERAL_CLAUSES + 1).collect()
    return _prepare_few(ready, head) if len(head) <= LITERAL_CLAUSES else _prepare_many(ready)


def _prepare_few(ready: DataFrame, rows: list[Row]) -> Prepared:
    positive = {r["qid"] for r in rows if r["occur"] != "must_not"}
    rows = [r for r in rows if r["qid"] in positive]
    n_must = Counter(r["qid"] for r in rows if r["occur"] == "must")
    pinned = [{**r.asDict(recursive=True), "n_must": n_must[r["qid"]]} for r in rows]
    schema = T.StructType([*ready.schema.fields, T.StructField("n_must", T.LongType(), False)])
    local = ready.sparkSession.createDataFrame(
        pa.Table.from_pylist(pinned, schema=to_arrow_schema(schema)), schema
    )
    words, ranges, lengths = set(), [], set()  # what the scans may be narrowed to
    for r in pinned:
        found = [w["term"] for w in r["words"] or []]
        if r["kind"] in PREFIX_KINDS:
            ranges.append(F.col("term").startswith(found[-1]))
            lengths.add(len(found.pop()))
        elif r["kind"] == "term_range":
            low, high = [*r["terms"], None, None][:2]
            ends = [F.lit(True)]
            ends += [F.col("term") >= low.lower()] if low is not None else []
            ends += [F.col("term") <= high.lower()] if high is not None else []
            ranges.append(reduce(lambda x, y: x & y, ends))
        words.update(found)
    return Prepared(
        local, frozenset(r["kind"] for r in rows), sum(len(r["words"] or [1]) for r in rows) <= BROADCAST_ROWS, {r["occur"] for r in rows} == {"should"},
        any(r["kind"] == "phrase" and r["slop"] > 0 for r in rows), tuple(sorted(lengths)),
        tuple(sorted(words)) if len(words) <= LITERAL_WORDS else None, reduce(lambda x, y: x | y, ranges) if ranges else None,
        frozenset(r["qid"] for r in rows if r["kind"] != "term"),
    )


def _prepare_many(ready: DataFrame) -> Prepared:
    shared_dir(ready.sparkSession)
    per_query = ready.groupBy("qid").agg(
        F.count(F.when(F.col("occur") == "must", 1)).alias("n_must"),
        F.count(F.when(F.col("occur") != "must_not", 1)).alias("_positive"),
    )
    ready = ready.join(per_query.filter("_positive > 0").drop("_positive"), "qid").checkpoint()
    last = F.try_element_at(F.col("words.term"), F.lit(-1))
    facts = ready.agg(
        F.collect_set("kind").alias("kinds"), F.collect_set("occur").alias("occurs"),
        F.sum(F.greatest(F.size("words"), F.lit(1))).alias("n_words"),
        F.max((F.col("kind") == "phrase") & (F.col("slop") > 0)).alias("sloppy"),
        # A term has fewer than 40 characters, so this set is bounded.
        F.collect_set(F.when(F.col("kind").isin(PREFIX_KINDS), F.length(last))).alias("lengths"),
    ).first()
    small = (facts["n_words"] or 0) <= BROADCAST_ROWS
    mixed = ready.filter("kind <> 'term'").select("qid").distinct().collect() if small else []
    return Prepared(
        ready, frozenset(facts["kinds"]), small, set(facts["occurs"]) == {"should"}, bool(facts["sloppy"]),
        tuple(sorted(facts["lengths"])), None, None, frozenset(row["qid"] for row in mixed),
    )


def _words(clauses: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per whole word to look up, with its offset inside the clause.

    The last word of a phrase prefix is open, so it is not among them.
    """
    first = F.try_element_at(F.col("words.pos"), F.lit(1))
    whole = F.when(
        F.col("kind") == "phrase_prefix", F.slice("words", 1, F.size("words") - 1)
    ).otherwise(F.col("words"))
    return (
        clauses.filter(F.col("kind").isin(kinds))
        .select(*CARRIED, "kind", "slop", F.size("words").alias("n_terms"),
                first.alias("_first"), F.inline(whole))
        .withColumn("offset", F.col("pos") - F.col("_first")).drop("pos", "_first")
    )


def _join_words(postings: DataFrame, words: DataFrame, small: bool) -> DataFrame:
    if small:
        return postings.join(F.broadcast(words), "term")
    return salted_join(postings, words, ["term"], F.col("path"))


def _counted(words: DataFrame) -> bool:
    """Whether expanded words, whose number only the index tells, may be broadcast."""
    return words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _with_frequency(terms: DataFrame, words: DataFrame, small: bool) -> DataFrame:
    """Words that occur in the index, with their document frequency.

    An index term is unique, so there are never more rows than words. Without
    a broadcast only the terms asked for are repeated to spread a word that
    very many clauses share.
    """
    if small:
        return terms.join(F.broadcast(words), "term")
    asked = terms.join(words.select("term").distinct(), "term")
    return salted_join(words, asked, ["term"], F.struct("qid", "clause_id"))


def _prefix_words(terms: DataFrame, query: Prepared, kind: str) -> DataFrame:
    """Every row of ``terms`` that completes the last word of a ``kind`` clause: index terms, or postings.

    They are cut at the prefix lengths in use, so this is an equi-join.
    """
    wanted = query.clauses.filter(F.col("kind") == kind).select(
        *CARRIED, "kind", "slop", F.size("words").alias("n_terms"),
        (F.try_element_at(F.col("words.pos"), F.lit(-1)) - F.try_element_at(F.col("words.pos"), F.lit(1))).alias("offset"),
        F.try_element_at(F.col("words.term"), F.lit(-1)).alias("_prefix"),
    )
    lengths = F.array(*[F.lit(n) for n in query.prefix_lengths])
    cut = terms.select("*", F.explode(lengths).alias("_len")).filter(
        F.length("term") >= F.col("_len")
    ).select(*terms.columns, F.substr(F.col("term"), F.lit(1), F.col("_len")).alias("_prefix"))
    if query.small:
        return cut.join(F.broadcast(wanted), "_prefix").drop("_prefix")
    return salted_join(cut, wanted, ["_prefix"], F.col("term")).drop("_prefix")


def _first_byte(term: Column) -> Column:
    return F.conv(F.substring(F.hex(term), 1, 2), 16, 10).cast("int")


def _range_words(terms: DataFrame, query: Prepared) -> DataFrame:
    """Every row of ``terms`` inside a clause's range: index terms, or postings.

    Ends and terms meet on the term's first byte, then are compared exactly.
    """
    low, high = F.lower(F.get("terms", F.lit(0))), F.lower(F.get("terms", F.lit(1)))
    from_byte = F.coalesce(_first_byte(low), F.lit(0))
    to_byte = F.coalesce(_first_byte(high), F.lit(255))
    wanted = query.clauses.filter("kind = 'term_range'").select(
        *CARRIED, low.alias("_low"), high.alias("_high"), F.coalesce("bounds", F.lit("[]")).alias("_bounds"),
        F.explode(F.when(from_byte <= to_byte, F.sequence(from_byte, to_byte))).alias("_byte"),
    )
    keyed = terms.select("*", _first_byte(F.col("term")).alias("_byte"))
    if query.small:
        met = keyed.join(F.broadcast(wanted), "_byte")
    else:
        met = salted_join(keyed, wanted, ["_byte"], F.col("term"))
    term, b = F.col("term"), F.col("_bounds")
    above = F.col("_low").isNull() | (term > F.col("_low")) | (
        (term == F.col("_low")) & (F.substring(b, 1, 1) == "[")
    )
    below = F.col("_high").isNull() | (term < F.col("_high")) | (
        (term == F.col("_high")) & (F.substring(b, 2, 1) == "]")
    )
    return met.filter(above & below).drop("_low", "_high", "_bounds", "_byte")


def _near_rarest(postings: DataFrame, words: DataFrame, small: bool, longest_path: int) -> DataFrame:
    """Postings of phrase words, kept to documents that hold the rarest one.

    The rarest word of each clause bounds its candidates, and exactly the
    (term, document) pairs of candidates are looked up, so long lists of common
    words are cut before any shuffle. Clauses are taken by rising number of
    lookups (candidates times words) into a broadcast as long as all of them
    together fit; the others are joined by shuffle, behind a filter of pair hashes.
    Only a clause whose lookups come near its whole lists (all its words are
    frequent) reads them whole. A clause with a word that is nowhere is left out.
    """
    if not small:
        return _join_words(postings, words, small)
    shared_dir(words.sparkSession)
    words = words.checkpoint()  # read several times; few enough to be broadcast
    clause = ["qid", "clause_id"]
    rarest = words.groupBy(*clause, "n_terms").agg(
        F.min(F.struct("df", "term")).alias("_r"), F.sum("df").alias("_whole"), F.count(F.lit(1)).alias("_n")
    ).filter("_n = n_terms").select(
        *clause, "_r.term", (F.col("_r.df") * F.col("n_terms")).alias("_lookups"), "_whole",
        F.ceil(F.log2(F.col("_r.df") * F.col("n_terms"))).alias("_size"),
    )
    # One row per power of two.
    sizes = rarest.groupBy("_size").agg(F.sum("_lookups").alias("n")).orderBy("_size").collect()
    allowed = min(BROADCAST_ROWS, BROADCAST_BYTES // (longest_path + 200))
    sums = list(accumulate(row["n"] for row in sizes))
    fitting = [row["_size"] for row, total in zip(sizes, sums) if total <= allowed]
    looked_up = F.col("_size") <= F.lit(fitting[-1] if fitting else -1)
    whole = ~looked_up & (F.col("_lookups") * WHOLE_LISTS > F.col("_whole"))

    def candidates(clauses: DataFrame) -> DataFrame:
        met = postings.join(F.broadcast(clauses.select(*clause, "term")), "term")
        return met.select(*clause, "path")

    def wanted(holders: DataFrame) -> DataFrame:
        return holders.join(F.broadcast(words), clause)

    # Always there, so that the columns are known; empty when nothing fits.
    found = postings.join(F.broadcast(wanted(candidates(rarest.filter(looked_up)))), ["term", "path"])
    if len(fitting) == len(sizes):
        return found
    beyond = words.join(F.broadcast(rarest.filter(whole).select(*clause)), clause, "left_semi")
    read_whole = _join_words(narrow(postings, "term", beyond.select("term")), beyond, small)
    found = found.unionByName(read_whole.select(*found.columns))
    many = rarest.filter(~looked_up & ~whole)
    if many.isEmpty():
        return found
    asked = wanted(candidates(many).checkpoint())
    pair = F.xxhash64("term", "path").alias("_pair")
    held = split_by_keys(postings.select("*", pair), asked.select(pair), "_pair")[0].drop("_pair")
    return found.unionByName(held.join(asked, ["term", "path"]).select(*found.columns))


def _chains() -> Column:
    """Of ``found``, every start with the end of its nearest chain through all later words."""
    begin = F.transform(
        F.get("found", F.lit(0))["positions"], lambda p: F.struct(p.alias("start"), p.alias("at"))
    )

    def step(acc: Column, f: Column) -> Column:
        moved = F.transform(acc, lambda a: F.struct(
            a["start"].alias("start"), F.array_min(F.filter(f["positions"], lambda p: p > a["at"])).alias("at")
        ))
        return F.filter(moved, lambda a: a["at"].isNotNull())

    return F.aggregate(F.slice("found", 2, F.size("found")), begin, step)


def _phrase_frequency(matched: DataFrame, sloppy: bool, open_end: bool = False) -> DataFrame:
    """``(…, path, tf, dl, weight)`` for clauses whose words all fall in place.

    One row per clause word and document comes in, so a group holds no more
    than the words of one clause, with positions of one document.
    """
    keys = [*CARRIED, "slop", "n_terms", "path", "dl"]
    if open_end:
        # The open last word may be several index terms: join their positions.
        # Both aggregations use this one partitioning.
        matched = matched.repartition("qid", "clause_id", "path").groupBy(*keys, "offset").agg(
            F.flatten(F.collect_list("positions")).alias("positions"), F.sum("weight").alias("weight")
        )
    grouped = matched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_present"),
        F.array_sort(F.collect_list(F.struct("offset", "positions"))).alias("found"),
        F.sum("weight").alias("weight"),
    ).filter("_present = n_terms").drop("_present")
    # Shifting every word back by its offset makes a match an equal start.
    starts = F.aggregate(
        F.slice("found", 2, F.size("found")),
        F.get("found", F.lit(0))["positions"],
        lambda acc, f: F.array_intersect(acc, F.transform(f["positions"], lambda p: p - f["offset"])),
    )
    columns = [*CARRIED, "path", "tf", "dl", "weight"]
    exact = grouped.withColumn("tf", F.size(starts))
    if not sloppy:
        return exact.filter("tf > 0").select(*columns)
    grouped = grouped.withColumn("offsets", F.col("found.offset"))
    loose = grouped.filter("slop > 0")
    steps = F.size(F.get("found", F.lit(0))["positions"]).cast("long") * F.aggregate(
        "found", F.lit(0), lambda n, f: n + F.size(f["positions"])
    )
    span = F.try_element_at(F.col("offsets"), F.lit(-1)) + 1 + F.col("slop")
    # Exploded, so that the filter on it does not work it out a second time.
    in_row = F.explode(F.array(F.size(F.filter(_chains(), lambda a: a["at"] - a["start"] < span))))
    near = loose.filter(steps <= LOOSE_STEPS).select("*", in_row.alias("tf"))
    loose = loose.filter(steps > LOOSE_STEPS)
    # A loose match spans at most n_terms + slop positions, so positions of a
    # document too long for that are put into windows of that width (own and previous one); each window
    # is then small whatever the document length.
    spots = loose.select(
        *keys, "offsets", "weight", span.alias("width"),
        F.inline(F.flatten(F.transform(
            "found",
            lambda f: F.transform(
                f["positions"], lambda p: F.struct(f["offset"].alias("offset"), p.alias("pos"))
            ),
        ))),
    ).withColumn("_own", F.floor(F.col("pos") / F.col("width")))
    spots = spots.select("*", F.explode(F.array(F.col("_own"), F.col("_own") - 1)).alias("_window"))
    windows = spots.groupBy(*keys, "_window").agg(
        F.first("offsets").alias("offsets"), F.first("weight").alias("weight"),
        F.first("width").alias("width"),
        F.sort_array(F.collect_list(F.struct("pos", "offset", "_own"))).alias("spots"),
    )
    # For each start in this window, take the nearest next position of every
    # later word; the gaps over the phrase's own may add up to the slop.
    begin = F.transform(
        F.filter("spots", lambda s: (s["offset"] == 0) & (s["_own"] == F.col("_window"))),
        lambda s: F.struct(s["pos"].alias("start"), s["pos"].alias("at")),
    )

    def step(acc: Column, o: Column) -> Column:
        moved = F.transform(
            acc,
            lambda a: F.struct(
                a["start"].alias("start"),
                F.array_min(F.transform(
                    F.filter("spots", lambda s: (s["offset"] == o) & (s["pos"] > a["at"])),
                    lambda s: s["pos"],
                )).alias("at"),
            ),
        )
        return F.filter(moved, lambda a: a["at"].isNotNull())

    chains = F.aggregate(F.slice("offsets", 2, F.size("offsets")), begin, step)
    hit = F.filter(chains, lambda a: a["at"] - a["start"] < F.col("width"))
    counted = windows.withColumn("tf", F.size(hit)).groupBy(*[k for k in keys if k not in ("slop", "n_terms")]).agg(
        F.sum("tf").cast("int").alias("tf"), F.first("weight").alias("weight")
    )
    return reduce(DataFrame.unionByName, [
        part.filter("tf > 0").select(*columns) for part in (exact.filter("slop = 0"), near, counted)
    ])


def _scored_hits(index, query: Prepared, k: int | None) -> list[DataFrame]:
    """Hits of terms and phrases, scored by BM25.

    With ``k`` the hits of terms are whole matches ``(qid, path, score)``, and
    of queries that are terms only at least the ``k`` best.
    """
    kinds = [k for k in SCORED_KINDS if k in query.kinds]
    if not kinds:
        return []
    words = _with_frequency(
        index.terms_for(query.words), _words(query.clauses, kinds), query.small
    )
    words = words.withColumn("weight", idf(index.n_docs, F.col("df")))
    score = (
        F.col("weight") * F.col("boost") * saturation(F.col("tf"), F.col("dl"), index.avg_dl)
    ).alias("score")
    hits = []
    if "term" in kinds:
        postings, wanted = index.postings_for(query.words), words.filter("kind = 'term'")
        if k:
            part = saturation(F.col("tf"), F.col("dl"), index.avg_dl)
            hits.append(best_sums(postings, wanted, part, k, query.mixed))
        else:
            if query.small and query.any_match:
                # Dealt by document once; sums by query and path then need no shuffle of their own.
                postings = postings.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").select(
                    "term", "path", "tf", "dl"
                ).repartition("path")
            hits.append(_join_words(postings, wanted, query.small).select(*CARRIED, "path", score))
    if "phrase" in kinds:
        found = _near_rarest(
            index.postings_for(query.words), words.filter("kind = 'phrase'"), query.small, index.longest_path
        )
        hits.append(_phrase_frequency(found, query.sloppy).select(*CARRIED, "path", score))
    if "phrase_prefix" in kinds:
        postings = index.postings_for(query.words, query.ranges)
        whole = words.filter("kind = 'phrase_prefix'").drop("df")
        ends = _prefix_words(index.terms_for(query.words, query.ranges).select("term"), query, "phrase_prefix")
        needed = whole.unionByName(ends.withColumn("weight", F.lit(0.0)))
        counted = _counted(needed)
        if query.small and not counted:
            # Very many terms complete a word: postings then meet the clauses themselves, and none is shuffled for that.
            found = _join_words(postings, whole, True)
            ends = _prefix_words(postings, query, "phrase_prefix").withColumn("weight", F.lit(0.0))
            found = found.unionByName(ends.select(*found.columns))
        else:
            found = _join_words(postings, needed, counted)
        hits.append(_phrase_frequency(found, False, True).select(*CARRIED, "path", score))
    return hits


def _constant_hits(index, query: Prepared) -> list[DataFrame]:
    """Hits of term sets, single prefixes and ranges; the score is the boost."""
    kinds = [k for k in CONSTANT_KINDS if k in query.kinds]
    if not kinds:
        return []
    terms = index.terms_for(query.words, query.ranges).select("term")
    postings = index.postings_for(query.words, query.ranges).select("term", "path")
    sets = _words(query.clauses, ["term_set"]).select(*CARRIED, "term")

    def open_words(rows: DataFrame) -> list[DataFrame]:
        parts = [_prefix_words(rows, query, "prefix")] if "prefix" in kinds else []
        parts += [_range_words(rows, query)] if "term_range" in kinds else []
        return [part.select(*CARRIED, *rows.columns) for part in parts]

    wanted = reduce(DataFrame.unionByName, [*([sets] if "term_set" in kinds else []), *open_words(terms)]).distinct()
    small = query.small if kinds == ["term_set"] else _counted(wanted)
    if query.small and not small:
        # Very many terms: as for phrase prefixes.
        parts = [_join_words(postings, sets, True)] if "term_set" in kinds else []
        found = reduce(DataFrame.unionByName, [*parts, *open_words(postings)])
    else:
        found = _join_words(postings, wanted, small)
    return [found.select(*CARRIED, "path").distinct().withColumn("score", F.col("boost"))]


def _path_hits(index, query: Prepared) -> list[DataFrame]:
    """The document a ``path`` clause names; one document has that path."""
    if "path" not in query.kinds:
        return []
    asked = query.clauses.filter("kind = 'path'").select(
        *CARRIED, F.get("terms", F.lit(0)).alias("path")
    )
    docs = narrow(index.docs, "path", asked.select("path")).select("path")
    score = idf(index.n_docs, F.lit(1.0)) * F.col("boost")
    return [docs.join(asked, "path").withColumn("score", score)]


def _all_hits(index, query: Prepared) -> list[DataFrame]:
    """Every document, for each ``match_all`` clause; that is the whole result."""
    if "match_all" not in query.kinds:
        return []
    asked = query.clauses.filter("kind = 'match_all'").agg(
        F.collect_list(F.struct(*CARRIED))
    ).scalar()
    return [index.docs.select("path", F.inline(asked)).withColumn("score", F.col("boost"))]


def match(index, clauses: DataFrame, k: int | None = None) -> DataFrame:
    """All matches ``(qid, path, score)`` of every query, unranked.

    With ``k`` matches that are surely not among the ``k`` best may be missing.
    """
    query = prepare(clauses)
    if not (query.any_match and query.small):
        k = None
    parts = [
        *_scored_hits(index, query, k), *_constant_hits(index, query),
        *_path_hits(index, query), *_all_hits(index, query),
    ]
    if not parts:
        return clauses.select("qid", F.lit("").alias("path"), F.lit(0.0).alias("score")).limit(0)
    columns = HIT_COLUMNS if k is None else ["qid", "path", "score"]
    hits = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    if k and query.kinds == {"term"}:
        return hits
    by_document = hits.groupBy("qid", "path")
    if query.any_match:
        return by_document.agg(F.sum("score").alias("score"))
    excluded = F.col("occur") == "must_not"
    return (
        by_document.agg(
            F.sum(F.when(~excluded, F.col("score"))).alias("score"),
            F.count(F.when(F.col("occur") == "must", 1)).alias("_must"),
            F.max("n_must").alias("n_must"),
            F.count(F.when(excluded, 1)).alias("_excluded"),
        )
        .filter("_excluded = 0 AND _must = n_must")
        .select("qid", "path", "score")
    )
