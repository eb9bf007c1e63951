"""Search against a plain Python evaluation of the same rules."""

import math
import random
import re

import pytest

from termloom.operators import clauses as K
from termloom.operators import matching as M
from termloom.operators.clauses import Clause, clause_table, keyword_clauses
from termloom.operators.ranking import NO_RESULTS, combine, top_k, with_status
from termloom.plans.index import MemoryIndex, StoredIndex
from termloom.plans.search import matches, search, search_keywords

VOCABULARY = ["alpha", "alpine", "beta", "bet", "gamma", "x", "y", "été"]


@pytest.fixture(scope="module")
def files():
    rng = random.Random(7)
    made = {
        f"/d{i % 3}/{i:03d}.txt": " ".join(rng.choices(VOCABULARY, weights=[9, 1, 4, 2, 3, 30, 8, 1], k=rng.randint(0, 60)))
        for i in range(60)
    }
    made["/copy.txt"] = made["/d1/001.txt"]
    return made


@pytest.fixture(scope="module")
def index(spark, files):
    return MemoryIndex.build(spark.createDataFrame(list(files.items()), "path string, content string"))


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


class Plain:
    """Brute-force scores of one clause over all documents."""

    def __init__(self, files):
        self.docs = {p: words(t) for p, t in files.items()}
        self.avg = sum(map(len, self.docs.values())) / len(self.docs)

    def idf(self, word):
        df = sum(word in d for d in self.docs.values())
        return math.log(1 + (len(self.docs) - df + 0.5) / (df + 0.5))

    def bm25(self, weight, tf, path):
        return weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(self.docs[path]) / self.avg))

    def phrase(self, terms, slop, doc):
        hits = 0
        for start in (i for i, w in enumerate(doc) if w == terms[0]):
            at = start
            for term in terms[1:]:
                at = next((i for i in range(at + 1, len(doc)) if doc[i] == term), None)
                if at is None:
                    break
            hits += at is not None and at - start <= len(terms) - 1 + slop
        return hits

    def clause(self, c):
        out = {}
        terms = words(" ".join(t for t in c.terms if t)) if c.kind != "path" else []
        for path, doc in self.docs.items():
            if c.kind in ("term", "phrase"):
                tf = self.phrase(terms, c.slop, doc)
                score = self.bm25(sum(map(self.idf, terms)), tf, path) if tf else None
            elif c.kind == "phrase_prefix":
                head, last = terms[:-1], terms[-1]
                tf = sum(
                    doc[i:i + len(head)] == head and i + len(head) < len(doc) and doc[i + len(head)].startswith(last)
                    for i in range(len(doc))
                )
                score = (self.bm25(sum(map(self.idf, head)), tf, path) if head else 1.0) if tf else None
            elif c.kind == "term_set":
                score = 1.0 if set(terms) & set(doc) else None
            elif c.kind == "term_range":
                low, high = c.terms
                score = 1.0 if any(
                    (low is None or w > low or (w == low and c.bounds[0] == "["))
                    and (high is None or w < high or (w == high and c.bounds[1] == "]")) for w in doc
                ) else None
            elif c.kind == "match_all":
                score = 1.0
            else:
                score = math.log(1 + (len(self.docs) - 0.5) / 1.5) if path == c.terms[0] else None
            if score is not None:
                out[path] = score * c.boost
        return out

    def query(self, clauses):
        hits = [(c, self.clause(c)) for c in clauses]
        out = {}
        for path in self.docs:
            if any(path in h for c, h in hits if c.occur == "must_not"):
                continue
            if not all(path in h for c, h in hits if c.occur == "must"):
                continue
            scores = [h[path] for c, h in hits if c.occur != "must_not" and path in h]
            if scores:
                out[path] = sum(scores)
        return out


QUERIES = {
    0: [("should", "term", ["Alpha"])],
    1: [("should", "term", ["x"]), ("should", "term", ["été"]), ("should", "term", ["x"])],
    2: [("must", "term", ["x"]), ("must", "term", ["beta"]), ("should", "term", ["y"])],
    3: [("should", "term", ["x"]), ("must_not", "term", ["gamma"])],
    4: [("should", "phrase", ["x x"])],
    5: [("should", "phrase", ["x beta x"], 3)],
    6: [("should", "phrase", ["x x y"], 2), ("should", "term", ["bet"])],
    7: [("should", "phrase_prefix", ["x al"])],
    8: [("should", "phrase_prefix", ["bet"])],
    9: [("should", "term_set", ["alpine", "été"])],
    10: [("should", "term_range", ["alpha", "bet"], 0, 1.0, "{]")],
    11: [("should", "term_range", [None, "alz"], 0, 2.0), ("should", "term", ["y"], 0, 0.5)],
    12: [("should", "match_all", []), ("must_not", "term", ["x"])],
    13: [("should", "path", ["/d0/003.txt"]), ("should", "term", ["x"])],
    14: [("must", "term", ["nowhere"]), ("should", "term", ["x"])],
    15: [("should", "term", ["x-beta"])],
    16: [("must", "phrase_prefix", ["y x bet"]), ("must_not", "term_range", ["g", "h"])],
    17: [("should", "phrase", ["x y"], 0), ("must", "term", ["?!"])],
}
CLAUSES = [Clause(q, i, *parts) for q, rows in QUERIES.items() for i, parts in enumerate(rows)]


def collected(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.qid, {})[r.path] = round(r.score, 6)
    return got


def expected(files):
    plain, want = Plain(files), {}
    for q in QUERIES:
        clauses = [c for c in CLAUSES if c.qid == q and c.terms != ["?!"]]
        found = plain.query(clauses)
        if found:
            want[q] = {p: round(s, 6) for p, s in found.items()}
    return want


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert got[q] == pytest.approx(want[q], abs=2e-6), q


def test_every_clause_kind(index, files):
    same(collected(matches(index, CLAUSES)), expected(files))


def test_large_clause_tables_give_the_same(index, files, monkeypatch):
    monkeypatch.setattr(M, "LITERAL_CLAUSES", 0)
    same(collected(matches(index, CLAUSES)), expected(files))


def test_salted_joins_give_the_same(index, files, monkeypatch):
    monkeypatch.setattr(M, "LITERAL_CLAUSES", 0)
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    same(collected(matches(index, CLAUSES)), expected(files))


@pytest.mark.parametrize("lookups", [1, 40, 100, 10_000])
def test_phrases_are_looked_up_or_read_whole_clause_by_clause(spark, index, files, monkeypatch, lookups):
    """Whatever number of lookups is allowed, and however the clauses divide."""
    texts = ["x y", "y x", "alpha beta", "gamma x", "alpine beta x", "y gamma", "bet été", "x x", "x gamma x"]
    phrases = [Clause(q, 0, kind="phrase", terms=[t]) for q, t in enumerate(texts)]
    phrases.append(Clause(99, 0, kind="phrase", terms=["x beta"], slop=2))
    read_whole = []
    join = M._join_words
    monkeypatch.setattr(M, "_join_words", lambda p, w, small: read_whole.append(w.select("qid").distinct().count()) or join(p, w, small))
    monkeypatch.setattr(M, "BROADCAST_BYTES", lookups * (index.longest_path + 200))
    assert index.longest_path == max(len(p) for p in files)
    plain = Plain(files)
    want = {c.qid: plain.query([c]) for c in phrases}
    same(collected(matches(index, phrases)), {q: hits for q, hits in want.items() if hits})
    few, most = {1: (10, 10), 40: (1, 9), 100: (1, 9), 10_000: (0, 0)}[lookups]
    assert few <= sum(read_whole) <= most


@pytest.mark.parametrize("steps", [-1, 3, 1 << 18])
def test_loose_phrases_in_a_row_and_by_windows(spark, index, files, monkeypatch, steps):
    """The same matches however long a document may be to be matched inside its row."""
    monkeypatch.setattr(M, "LOOSE_STEPS", steps)
    texts = [("x y", 1), ("y x", 3), ("x x", 2), ("alpha x beta", 4), ("x y", 0)]
    phrases = [Clause(q, 0, kind="phrase", terms=[t], slop=n) for q, (t, n) in enumerate(texts)]
    plain = Plain(files)
    want = {c.qid: plain.query([c]) for c in phrases}
    same(collected(matches(index, phrases)), {q: hits for q, hits in want.items() if hits})


@pytest.mark.parametrize("filter_bytes", [64 << 20, 0])
def test_many_lookups_do_not_read_the_lists_of_frequent_words(spark, monkeypatch, filter_bytes):
    """Beyond the broadcast too, only pairs of a candidate and a word reach the matching."""
    texts = {f"/{i}.txt": "in the end of it all" + (f" rare{i}" if i < 3 else "") for i in range(60)}
    texts["/x.txt"] = "all rare1 it of"
    index = MemoryIndex.build(spark.createDataFrame(list(texts.items()), "path string, content string"))
    phrases = [Clause(q, 0, kind="phrase", terms=[f"of it all rare{q}"]) for q in range(3)]
    phrases.append(Clause(7, 0, kind="phrase", terms=["the end"]))  # frequent words only
    phrases.append(Clause(8, 0, kind="phrase", terms=["the nowhere"]))
    received, plainly = [], M._phrase_frequency
    monkeypatch.setattr(M, "_phrase_frequency", lambda found, *a: received.append(found) or plainly(found, *a))
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    monkeypatch.setattr("termloom.operators.joins.BROADCAST_BYTES", filter_bytes)
    got = collected(matches(index, phrases))
    assert {q: set(hits) for q, hits in got.items()} == {
        0: {"/0.txt"}, 1: {"/1.txt"}, 2: {"/2.txt"}, 7: {f"/{i}.txt" for i in range(60)},
    }
    counts = {r.qid: r["count"] for r in received[0].groupBy("qid").count().collect()}
    assert counts == {0: 4, 1: 8, 2: 4, 7: 120}


def test_a_stored_index_with_changes_gives_the_same(spark, files, tmp_path):
    """Two segments and tombstones: some documents came late, some changed, some went."""
    order = sorted(files)
    late, edited, gone = order[:9], order[9:15], ["/gone/1.txt", "/gone/2.txt"]
    first = {p: t for p, t in files.items() if p not in late} | {p: "x alpha beta y" for p in [*edited, *gone]}
    frame = lambda docs: spark.createDataFrame(list(docs.items()), "path string, content string")
    stored = StoredIndex.open(spark, str(tmp_path / "index")).build(frame(first), buckets=3)
    rows = [(n, None, op, p, None) for n, (op, p) in enumerate(
        [("create", p) for p in late] + [("modify", p) for p in edited] + [("delete", p) for p in gone]
    )]
    changes = spark.createDataFrame(rows, "seq long, ts timestamp, op string, path string, old_path string")
    now = stored.apply(changes, frame(files), ["txt"]).index
    assert len(now.snapshot.segments) == 2 and now.snapshot.segments[1].tombstones > 0
    assert now.longest_path == max(len(p) for p in [*files, *gone])
    same(collected(matches(now, CLAUSES)), expected(files))


def test_exclusions_only_match_nothing(index, files, monkeypatch):
    only = [Clause(0, 0, terms=["x"]), Clause(1, 0, "must_not", terms=["x"])]
    for limit in (M.LITERAL_CLAUSES, 0):
        monkeypatch.setattr(M, "LITERAL_CLAUSES", limit)
        assert collected(matches(index, only)) == collected(matches(index, only[:1]))
        assert matches(index, only[1:]).isEmpty()


def test_match_all_ranks_once_for_all_queries(index, files):
    every = [Clause(q, 0, "must" if q % 2 else "should", kind="match_all", boost=1.0 + q) for q in range(4)]
    mixed = [Clause(9, 0, kind="match_all"), Clause(9, 1, "must_not", terms=["x"])]
    got = search(index, every + mixed, k=3).collect()
    paths = sorted(files)[:3]
    for q in range(4):
        assert [(r.path, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] == [(p, 1.0 + q) for p in paths]
    alone = search(index, mixed, k=3).collect()
    assert [r for r in got if r.qid == 9] == alone or {tuple(r) for r in got if r.qid == 9} == {tuple(r) for r in alone}


def test_wrong_clauses_are_refused(index):
    with pytest.raises(ValueError):
        combine(must_not=[index.docs])
    with pytest.raises(ValueError):
        Clause(0, 0, "perhaps")
    with pytest.raises(ValueError):
        K.Clause(0, 0, kind="fuzzy")


def test_top_k_order_and_long_lists(spark, index, files):
    all_x = Plain(files).query([Clause(0, 0, terms=["x"])])
    order = sorted(all_x, key=lambda p: (-round(all_x[p], 6), p))
    for k in (3, 10):
        got = search(index, [Clause(0, 0, terms=["x"])], k).orderBy("rank").collect()
        assert [r.path for r in got] == order[:k] and [r["rank"] for r in got] == list(range(1, k + 1))
    many = spark.range(5000).selectExpr("0L AS qid", "cast(id AS string) AS path", "id / 7 AS score")
    assert top_k(many, 2000).count() == 2000
    assert top_k(many, 2000).filter("rank = 2000").first().path == "3000"


def test_keywords_status_and_json(spark, index, files):
    queries = spark.createDataFrame([(1, " x  Alpha "), (2, "nowhere"), (3, ""), (4, "x-beta")], "qid long, keyword string")
    rows = {r.qid: r for r in with_status(queries, search_keywords(index, queries)).collect()}
    assert {q: r.status for q, r in rows.items()} == {1: "ok", 2: NO_RESULTS, 3: NO_RESULTS, 4: "ok"}
    plain = Plain(files).query([Clause(0, 0, terms=["x"]), Clause(0, 1, terms=["alpha"])])
    best = sorted(plain, key=lambda p: (-round(plain[p], 6), p))[:10]
    assert rows[1].result == "[" + ", ".join(f'{{"file_path":["{p}"]}}' for p in best) + "]"
    assert keyword_clauses(queries).filter("qid = 1").count() == 2


def test_nested_groups(spark, index, files):
    either = matches(index, [Clause(0, 0, terms=["alpine"]), Clause(0, 1, terms=["été"])])
    common = matches(index, [Clause(0, 0, terms=["beta"])])
    gamma = matches(index, [Clause(0, 0, terms=["gamma"])])
    plain = Plain(files)
    a = plain.query([Clause(0, 0, terms=["alpine"]), Clause(0, 1, terms=["été"])])
    b, g = plain.query([Clause(0, 0, terms=["beta"])]), plain.query([Clause(0, 0, terms=["gamma"])])
    want = {p: round(a[p] + b[p], 6) for p in a if p in b and p not in g}
    assert collected(combine(must=[either, common], must_not=[gamma])).get(0, {}) == pytest.approx(want, abs=2e-6)


def test_clause_table_round_trip(spark):
    row = clause_table(spark, [Clause(5, 1, "must", "term_range", ["a", None], 2, 1.5, "{}")]).first()
    assert row.asDict() == {
        "qid": 5, "clause_id": 1, "occur": "must", "kind": "term_range", "terms": ["a", None], "slop": 2,
        "boost": 1.5, "bounds": "{}",
    }


def test_open_words_of_very_many_terms_are_not_shuffled(spark, files, corpus_of, monkeypatch):
    """Postings meet prefixes and ranges themselves; a salted join would move every one of them."""
    index = MemoryIndex.build(corpus_of(files))
    asked = [
        Clause(0, 0, kind="phrase_prefix", terms=["x al"]), Clause(1, 0, kind="phrase_prefix", terms=["be"]),
        Clause(1, 1, kind="phrase_prefix", terms=["al"], boost=2.0), Clause(2, 0, kind="term_range", terms=["beta", None]),
        Clause(3, 0, "must", kind="phrase_prefix", terms=["y x b"]), Clause(3, 1, "must_not", kind="term_set", terms=["gamma", "été"]),
        Clause(4, 0, kind="term_range", terms=["al", "bet"], bounds="{]"), Clause(4, 1, kind="phrase_prefix", terms=["none al"]),
    ]
    few = {tuple(row) for row in search(index, asked, 100).collect()}
    monkeypatch.setattr(M, "_counted", lambda words: False)
    found = search(index, asked, 100)
    assert "_salt" not in found._jdf.queryExecution().toString()
    rows = [tuple(row) for row in found.collect()]
    assert {row[0] for row in rows} == {0, 1, 2, 3, 4} and len(rows) == len(few) and set(rows) == few
