r"""SQL that computes each registered query straight from the given tables.

Nothing here shares code with the library: tokens, postings, scores and
change folding are worked out again from the raw text and events.
"""

from __future__ import annotations

EXT = "CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'rs' END"
DOCS = f"""docs AS (
  SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || '.' || {EXT} AS path,
         '/' || source || '/' || lang AS folder, {EXT} AS ext, text AS content, source, lang
  FROM documents)"""
PAGES = "page_docs AS (SELECT '/pages/' || page_id || '.html' AS path, html AS content FROM pages)"
TURNS = """turn_docs AS (
  SELECT '/conversations/' || conv_id || '/' || turn || '.md' AS path, text AS content
  FROM conversations)"""
# Documents present when changes are applied.
TREE = """tree AS (
  SELECT path, content FROM docs
  UNION ALL
  SELECT '/moved' || path, content FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))"""


def tokens(source: str, name: str = "tok") -> str:
    return rf"""{name} AS (
  SELECT path, pos, lower(w) AS term FROM (
    SELECT path, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM (
      SELECT path, regexp_extract_all(content, '[\p{{L}}\p{{N}}]+') AS ws FROM {source}))
  WHERE strlen(w) < 40)"""


def lengths(source: str, tok: str = "tok", name: str = "dl") -> str:
    return f"""{name} AS (
  SELECT s.path, count(t.pos) AS dl FROM {source} s LEFT JOIN {tok} t ON s.path = t.path
  GROUP BY s.path)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


INDEXED = [DOCS, tokens("docs"), lengths("docs")]

# Clauses come in as words: clause_words(qid, clause_id, occur, boost, slop, off, term).
SCORED = """stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(DISTINCT path) AS df FROM tok GROUP BY term),
clause AS (
  SELECT qid, clause_id, any_value(occur) AS occur, any_value(boost) AS boost, count(*) AS n_words,
         sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS weight
  FROM clause_words LEFT JOIN df USING (term), stats GROUP BY qid, clause_id),
placed AS (
  SELECT qid, clause_id, path, pos - off AS start, count(*) AS c
  FROM clause_words JOIN tok USING (term) GROUP BY ALL),
freq AS (
  SELECT qid, clause_id, path, count(*) AS tf
  FROM placed JOIN clause USING (qid, clause_id) WHERE c = n_words GROUP BY ALL),
scored AS (
  SELECT qid, clause_id, occur, path,
         boost * weight * tf * 2.2::DOUBLE
         / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS score
  FROM freq JOIN clause USING (qid, clause_id) JOIN dl USING (path), stats)"""

# Expects hits(qid, occur, path, score) and needed(qid, n_must).
MATCHED = """matched AS (
  SELECT h.qid, h.path, sum(h.score) FILTER (WHERE h.occur <> 'must_not') AS score
  FROM hits h LEFT JOIN needed m ON h.qid = m.qid
  GROUP BY h.qid, h.path
  HAVING count(*) FILTER (WHERE h.occur = 'must') = any_value(coalesce(m.n_must, 0))
     AND count(*) FILTER (WHERE h.occur = 'must_not') = 0)"""


def ranked(k: int = 10, source: str = "matched") -> str:
    return f"""ranked AS (
  SELECT qid, rank, path, score FROM (
    SELECT qid, path, round(score, 6) AS score,
           row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, path) AS rank
    FROM {source}) WHERE rank <= {k})"""


RESULT = "SELECT qid::BIGINT AS qid, rank::INT AS rank, path, score FROM ranked"
PLAIN_HITS = "hits AS (SELECT qid, occur, path, score FROM scored)"
NONE_NEEDED = "needed AS (SELECT 0 AS qid, 0 AS n_must WHERE false)"


def word_list(rows: list[tuple]) -> str:
    """``clause_words`` from (qid, clause_id, occur, boost, off, term) rows."""
    values = ", ".join(
        f"({q}, {c}, '{occur}', {boost}::DOUBLE, {off}, '{term}')" for q, c, occur, boost, off, term in rows
    )
    return f"clause_words AS (SELECT * FROM (VALUES {values}) v(qid, clause_id, occur, boost, off, term))"


def needed(counts: dict[int, int]) -> str:
    values = ", ".join(f"({q}, {n})" for q, n in counts.items())
    return f"needed AS (SELECT * FROM (VALUES {values}) v(qid, n_must))"


def keyword_words(source: str) -> str:
    """``clause_words`` from (qid, keyword): each blank-separated chunk is a clause."""
    return rf"""clause_words AS (
  SELECT qid, clause_id, 'should' AS occur, 1.0::DOUBLE AS boost, off, lower(w) AS term FROM (
    SELECT qid, clause_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS off FROM (
      SELECT qid, clause_id, regexp_extract_all(chunk, '[\p{{L}}\p{{N}}]+') AS ws FROM (
        SELECT qid, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS clause_id
        FROM (SELECT qid, regexp_split_to_array(keyword, '\s+') AS cs FROM {source}))))
  WHERE strlen(w) < 40)"""


def search_sql(words: str, n_must: str = NONE_NEEDED, k: int = 10, base: list[str] = INDEXED) -> str:
    return ctes(*base, words, SCORED, PLAIN_HITS, n_must, MATCHED, ranked(k)) + RESULT


BENCH_QUERIES = "queries AS (SELECT item_id AS qid, text AS keyword FROM benchmark)"
WORDS = ["trash", "bleble", "aié", "thrend", "oror", "lynt", "the", "of"]
SINGLE = word_list([(i, 0, "should", 1, 0, w) for i, w in enumerate(WORDS)])


def phrase(q: int, c: int, text: str, occur: str = "should", boost: float = 1) -> list[tuple]:
    return [(q, c, occur, boost, i, w) for i, w in enumerate(text.split())]


def one(q: int, c: int, word: str, occur: str = "should", boost: float = 1) -> tuple:
    return (q, c, occur, boost, 0, word)


# -- changes --------------------------------------------------------------------

RAW = """raw AS (
  SELECT event_id AS seq, ts,
         CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'modify_data'
              WHEN 'signup' THEN 'rename_both'
              WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'remove_folder' ELSE 'remove_file' END
              ELSE 'access' END AS kind,
         event_id % 5 = 0 AS is_dir,
         CASE WHEN event_id % 5 = 0 AND event_type <> 'click' THEN folder ELSE path END AS here,
         doc_id, folder
  FROM events JOIN docs ON user_id = doc_id)"""
RAW_PATHS = """raw_paths AS (
  SELECT *, CASE
    WHEN kind = 'rename_both' AND seq % 11 = 0 THEN [here]
    WHEN kind = 'rename_both' AND NOT is_dir AND seq % 4 = 0 THEN [here, folder || '/' || doc_id || '.bin']
    WHEN kind = 'rename_both' THEN [here, '/moved' || here]
    WHEN kind = 'create' AND NOT is_dir AND seq % 3 = 0 THEN [here, '/moved' || here]
    ELSE ['/.' || here] END AS paths
  FROM raw)"""
CHANGES = """changes AS (
  SELECT seq, ts, CASE WHEN is_dir THEN 'rename_dir' ELSE 'rename' END AS op,
         paths[2] AS path, paths[1] AS old_path
  FROM raw_paths WHERE kind = 'rename_both'
  UNION ALL
  SELECT seq, ts, CASE kind WHEN 'create' THEN CASE WHEN is_dir THEN 'create_dir' ELSE 'create' END
                            WHEN 'modify_data' THEN 'modify' WHEN 'remove_file' THEN 'delete'
                            ELSE 'delete_dir' END,
         replace(unnest(paths), '/./', '/'), NULL
  FROM raw_paths WHERE kind IN ('create', 'modify_data', 'remove_file', 'remove_folder'))"""
FEED = [DOCS, TREE, RAW, RAW_PATHS, CHANGES]


def is_target(path: str, *extensions: str) -> str:
    tests = " OR ".join(f"{path} LIKE '%.{e}'" for e in extensions)
    return f"coalesce({tests}, false)"


ALL = ("txt", "md", "rs")
CHECKED = f"""checked AS (
  SELECT *, CASE
    WHEN path IS NULL OR (op IN ('rename', 'rename_dir') AND old_path IS NULL) THEN 'missing path'
    WHEN op IN ('create', 'modify', 'rename') AND {is_target('path', *ALL)}
         AND path NOT IN (SELECT path FROM tree) THEN 'not in corpus' END AS reason
  FROM changes)"""


def folded(ops: tuple[str, ...] | None = None) -> list[str]:
    """``final(path, content)``: documents after the changes of these kinds."""
    kinds = "" if ops is None else " AND op IN (" + ", ".join(f"'{o}'" for o in ops) + ")"
    return [CHECKED, f"good AS (SELECT * FROM checked WHERE reason IS NULL{kinds})", f"""puts AS (
  SELECT path, max(seq) AS seq FROM (
    SELECT path, seq FROM good WHERE op IN ('create', 'modify', 'rename') AND {is_target('path', *ALL)}
    UNION ALL
    SELECT t.path, g.seq FROM tree t JOIN (
      SELECT path AS dir, max(seq) AS seq FROM good WHERE op IN ('rename_dir', 'create_dir') GROUP BY 1) g
      ON starts_with(t.path, g.dir || '/')
    WHERE {is_target('t.path', *ALL)})
  GROUP BY path)""", f"""deletes AS (
  SELECT path, max(seq) AS seq FROM (
    SELECT path, seq FROM good WHERE op = 'delete'
    UNION ALL
    SELECT old_path, seq FROM good WHERE op = 'rename' AND {is_target('old_path', *ALL)})
  GROUP BY path)""", """prefixes AS (
  SELECT prefix, max(seq) AS seq FROM (
    SELECT path AS prefix, seq FROM good WHERE op = 'delete_dir'
    UNION ALL
    SELECT old_path, seq FROM good WHERE op = 'rename_dir')
  GROUP BY prefix)""", """alive AS (
  SELECT * FROM puts p
  WHERE NOT EXISTS (SELECT 1 FROM deletes d WHERE d.path = p.path AND d.seq > p.seq)
    AND NOT EXISTS (SELECT 1 FROM prefixes x WHERE starts_with(p.path, x.prefix) AND x.seq > p.seq))""",
        """final AS (
  SELECT path, content FROM docs d
  WHERE path NOT IN (SELECT path FROM alive) AND path NOT IN (SELECT path FROM deletes)
    AND NOT EXISTS (SELECT 1 FROM prefixes x WHERE starts_with(d.path, x.prefix))
  UNION ALL
  SELECT t.path, t.content FROM tree t JOIN alive USING (path))"""]


def final_lengths(*ops: str) -> str:
    parts = folded(ops or None)
    return ctes(*FEED, *parts, tokens("final"), lengths("final")) + "SELECT path, dl::INT AS dl FROM dl"


SLOP_SQL = ctes(*INDEXED, """stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(DISTINCT path) AS df FROM tok GROUP BY term),
asked AS (SELECT * FROM (VALUES (0, ['of','the'], 2), (1, ['the','of','and'], 5), (2, ['the','the'], 3),
                                (3, ['of','the'], 0)) v(qid, ws, slop)),
first AS (SELECT qid, path, pos AS start, pos AS spot FROM asked JOIN tok ON term = ws[1]),
second AS (
  SELECT f.qid, f.path, f.start, min(t.pos) AS spot
  FROM first f JOIN asked a USING (qid) JOIN tok t ON t.path = f.path AND t.term = a.ws[2] AND t.pos > f.spot
  GROUP BY ALL),
third AS (
  SELECT f.qid, f.path, f.start, min(t.pos) AS spot
  FROM second f JOIN asked a USING (qid) JOIN tok t ON t.path = f.path AND t.term = a.ws[3] AND t.pos > f.spot
  WHERE len(a.ws) = 3 GROUP BY ALL),
chains AS (
  SELECT * FROM third UNION ALL SELECT s.* FROM second s JOIN asked a USING (qid) WHERE len(a.ws) = 2),
freq AS (
  SELECT qid, path, count(*) AS tf FROM chains JOIN asked USING (qid)
  WHERE spot - start <= len(ws) - 1 + slop GROUP BY ALL),
weights AS (
  SELECT qid, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS weight
  FROM (SELECT qid, unnest(ws) AS term FROM asked) JOIN df USING (term), stats GROUP BY qid),
matched AS (
  SELECT qid, path, weight * tf * 2.2::DOUBLE
         / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS score
  FROM freq JOIN weights USING (qid) JOIN dl USING (path), stats)""", ranked()) + RESULT

PREFIX_SQL = ctes(*INDEXED, """stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(DISTINCT path) AS df FROM tok GROUP BY term),
starts AS (
  SELECT 0 AS qid, a.path, a.pos FROM tok a JOIN tok b ON a.path = b.path AND b.pos = a.pos + 1
  WHERE a.term = 'of' AND starts_with(b.term, 'th')
  UNION ALL
  SELECT 1, a.path, a.pos FROM tok a JOIN tok b ON a.path = b.path AND b.pos = a.pos + 1
  JOIN tok c ON a.path = c.path AND c.pos = a.pos + 2
  WHERE a.term = 'in' AND b.term = 'the' AND starts_with(c.term, 'a')),
weights AS (
  SELECT qid, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS weight
  FROM (VALUES (0, 'of'), (1, 'in'), (1, 'the')) v(qid, term) JOIN df USING (term), stats GROUP BY qid),
freq AS (SELECT qid, path, count(*) AS tf FROM starts GROUP BY ALL),
matched AS (
  SELECT qid, path, weight * tf * 2.2::DOUBLE
         / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS score
  FROM freq JOIN weights USING (qid) JOIN dl USING (path), stats
  UNION ALL
  SELECT DISTINCT 2, path, 1.0::DOUBLE FROM tok WHERE starts_with(term, 'tras'))""", ranked()) + RESULT


def mixed_sql(words: str, extra: str, n_must: str, k: int = 10) -> str:
    """Scored clauses together with constant-score hits given as SQL."""
    hits = f"hits AS (SELECT qid, occur, path, score FROM scored UNION ALL {extra})"
    return ctes(*INDEXED, words, SCORED, hits, n_must, MATCHED, ranked(k)) + RESULT


def holding(qid: int, condition: str, score: str = "1.0", occur: str = "should") -> str:
    return f"SELECT DISTINCT {qid}, '{occur}', path, {score}::DOUBLE FROM tok WHERE {condition}"


NESTED_SQL = ctes(
    *INDEXED,
    word_list([
        one(0, 0, "trash"), one(0, 1, "lynt"), one(1, 0, "trash", "must"), one(1, 1, "lynt", "must"),
        one(2, 0, "the"), *phrase(3, 0, "of the"), one(3, 1, "in", "must_not"),
    ]), SCORED, PLAIN_HITS, needed({1: 2}), MATCHED,
    """whole AS (
  SELECT 0 AS qid, a.path, a.score + b.score AS score
  FROM matched a JOIN matched b ON a.path = b.path AND a.qid = 0 AND b.qid = 2
  UNION ALL
  SELECT 1, path, sum(score) FROM matched WHERE qid IN (1, 3) GROUP BY path)""",
    ranked(source="whole")) + RESULT

NESTED_TABLE_SQL = ctes(
    *INDEXED, """clause_words AS (
  SELECT qid, clause_id, 'should' AS occur, 1.0::DOUBLE AS boost, 0 AS off, lower(word) AS term FROM (
    SELECT qid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS clause_id FROM (
      SELECT item_id AS qid, regexp_split_to_array(text, '[^a-zA-Z]+')[1:4] AS ws FROM benchmark))
  WHERE word <> '' AND strlen(word) < 40)""", SCORED, """both_needed AS (
  SELECT qid, count(*) AS n FROM clause_words WHERE clause_id >= 2 GROUP BY qid),
whole AS (
  SELECT qid, path, score FROM (
    SELECT qid, path, sum(score) FILTER (WHERE clause_id < 2) AS score,
           count(*) FILTER (WHERE clause_id >= 2) AS later
    FROM scored GROUP BY qid, path) LEFT JOIN both_needed USING (qid)
  WHERE score IS NOT NULL AND (later = 0 OR later < n))""", ranked(source="whole")) + RESULT

JSON_ROWS = """answers AS (
  SELECT qid, '[' || string_agg('{"file_path":["' || path || '"]}', ', ' ORDER BY rank) || ']' AS result
  FROM ranked GROUP BY qid)"""

STATUS_QUERIES = """queries AS (
  SELECT item_id AS qid, text AS keyword FROM benchmark
  UNION ALL SELECT -1 - item_id, reverse(text) FROM benchmark
  UNION ALL SELECT -1000, 'qqqqxxxx')"""


def keyword_search(queries: str, k: int, *tail: str) -> str:
    return ctes(*INDEXED, queries, keyword_words("queries"), SCORED, PLAIN_HITS, NONE_NEEDED, MATCHED,
                ranked(k), *tail)


UPDATED = [*FEED, *folded(), tokens("final"), lengths("final")]
AFTER_DF = "SELECT 'after' AS reader, term, count(DISTINCT path) AS df FROM tok GROUP BY term"

LISTINGS = """before AS (SELECT path, md5(content) AS hash FROM docs),
after AS (
  SELECT CASE WHEN quality = 1 THEN '/moved' || path ELSE path END AS path,
         md5(CASE WHEN lang = 'fr' THEN content || ' fin' ELSE content END) AS hash
  FROM docs LEFT JOIN labels USING (doc_id)
  WHERE NOT coalesce(toxic = 1 AND quality = 0, false)
  UNION ALL SELECT path, md5(content) FROM page_docs),
both_sides AS (
  SELECT coalesce(b.path, a.path) AS path, b.hash AS old_hash, a.hash AS new_hash
  FROM before b FULL OUTER JOIN after a ON b.path = a.path),
gone AS (
  SELECT path, old_hash AS hash, row_number() OVER (PARTITION BY old_hash ORDER BY path) AS n
  FROM both_sides WHERE new_hash IS NULL),
fresh AS (
  SELECT path, new_hash AS hash, row_number() OVER (PARTITION BY new_hash ORDER BY path) AS n
  FROM both_sides WHERE old_hash IS NULL)"""

PATH_SEARCH = """SELECT doc_id AS qid, 1 AS rank, path,
       round(ln(1 + (n - 1 + 0.5::DOUBLE) / 1.5::DOUBLE), 6) AS score
FROM docs, (SELECT count(*) AS n FROM docs) WHERE doc_id IN (SELECT doc_id FROM labels)"""

ORACLE_SQL: dict[str, str] = {
    "corpus_scan": ctes(*INDEXED) + """SELECT source, lang, sum(dl)::BIGINT AS n_tokens
FROM dl JOIN docs USING (path) GROUP BY ALL""",
    "corpus_rejects": """SELECT doc_id, n_bytes, CASE WHEN n_bytes > 20000 THEN 'too long' ELSE 'invalid UTF-8' END AS reason
FROM (SELECT doc_id, strlen(text) + 1 + CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 0 END AS n_bytes FROM documents)
WHERE n_bytes > 20000 OR doc_id % 3 = 2""",
    "load_by_path": ctes(*FEED) + """SELECT c.path, t.content, t.path IS NOT NULL AS found
FROM (SELECT DISTINCT path FROM changes WHERE path IS NOT NULL) c LEFT JOIN tree t ON c.path = t.path""",
    "index_roundtrip": ctes(*INDEXED) + """SELECT term, count(DISTINCT path) AS df, count(*) AS n_tokens
FROM tok GROUP BY term""",
    "index_in_memory": search_sql(SINGLE),
    "hits_as_json": keyword_search(BENCH_QUERIES, 10, JSON_ROWS) + "SELECT qid, result FROM answers",
    "search_status": keyword_search(STATUS_QUERIES, 10, JSON_ROWS)
    + """SELECT qid, keyword, result,
CASE WHEN result IS NULL THEN 'No results found.' ELSE 'ok' END AS status
FROM queries LEFT JOIN answers USING (qid)""",
    "filter_extension": ctes(DOCS, PAGES, TURNS) + r"""SELECT path, regexp_extract(path, '\.([^./]*)$', 1) AS extension,
regexp_extract(path, '\.([^./]*)$', 1) IN ('txt', 'md') AS is_target
FROM (SELECT path FROM docs UNION ALL SELECT path FROM page_docs UNION ALL SELECT path FROM turn_docs)""",
    "normalize_path": ctes(*FEED) + """SELECT seq, n, replace(p, '/./', '/') AS path,
substr(replace(p, '/./', '/'), 2) AS dotted
FROM (SELECT seq, unnest(paths) AS p, (generate_subscripts(paths, 1) - 1)::INT AS n FROM raw_paths)""",
    "filter_path_prefix": ctes(DOCS) + "SELECT path FROM docs WHERE starts_with(path, '/src1')",
    "delete_prefix_count": ctes(*FEED) + """SELECT prefix, count(d.path) AS n_docs
FROM (SELECT DISTINCT path AS prefix FROM changes WHERE op = 'delete_dir') p
LEFT JOIN docs d ON starts_with(d.path, p.prefix) GROUP BY prefix""",
    "expand_renames": ctes(*FEED) + f"""SELECT seq, 'delete' AS action, old_path AS path FROM changes
WHERE op = 'rename' AND {is_target('old_path', 'txt', 'md')}
UNION ALL
SELECT seq, 'put', path FROM changes WHERE op = 'rename' AND {is_target('path', 'txt', 'md')}""",
    "tokenize": ctes(DOCS, tokens("docs")) + "SELECT path, pos::INT AS pos, term FROM tok",
    "tokenize_pages": ctes(PAGES, tokens("page_docs")) + "SELECT path, pos::INT AS pos, term FROM tok",
    "build_postings": ctes(*INDEXED) + """SELECT term, path, count(*)::INT AS tf,
string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions, any_value(dl)::INT AS dl
FROM tok JOIN dl USING (path) GROUP BY term, path""",
    "doc_lengths": ctes(TURNS, tokens("turn_docs"), lengths("turn_docs")) + "SELECT path, dl::INT AS dl FROM dl",
    "term_stats": ctes(*INDEXED) + "SELECT term, count(DISTINCT path) AS df FROM tok GROUP BY term",
    "corpus_stats": ctes(*INDEXED) + "SELECT count(*) AS n_docs, round(avg(dl), 6) AS avg_dl FROM dl",
    "build_index": ctes(*INDEXED) + """SELECT path, dl::INT AS dl FROM dl JOIN docs USING (path)
WHERE ext IN ('txt', 'md')""",
    "apply_create": final_lengths("create", "create_dir"),
    "apply_modify": final_lengths("modify"),
    "apply_delete": final_lengths("delete"),
    "apply_delete_prefix": final_lengths("delete_dir"),
    "apply_rename": final_lengths("rename"),
    "apply_rename_dir": final_lengths("rename_dir"),
    "fold_change_log": ctes(*FEED, *folded()) + "SELECT path, md5(content) AS hash FROM final",
    "commit_visibility": ctes(*FEED, *folded(), tokens("docs", "old_tok"), tokens("final"))
    + f"""SELECT 'before' AS reader, term, count(DISTINCT path) AS df FROM old_tok GROUP BY term
UNION ALL {AFTER_DF}""",
    "compacted_index": ctes(*FEED, *folded(), tokens("final"))
    + """SELECT path, count(DISTINCT term) AS n_terms, count(*)::INT AS dl FROM tok GROUP BY path""",
    "pending_changes": ctes(*FEED) + "SELECT op, count(*) AS n FROM changes WHERE seq > (SELECT max(seq) // 2 FROM changes) GROUP BY op",
    "search_term": search_sql(SINGLE),
    "search_any": keyword_search(BENCH_QUERIES, 10) + RESULT,
    "search_topk": keyword_search(BENCH_QUERIES, 100) + RESULT,
    "search_all": search_sql(word_list([
        one(0, 0, "the", "must"), one(0, 1, "of", "must"),
        one(1, 0, "trash", "must"), one(1, 1, "the", "must"),
        one(2, 0, "the", "must"), one(2, 1, "lynt", "must"), one(2, 2, "of", "must"), one(2, 9, "thrend"),
        one(3, 0, "trash", "must"), one(3, 1, "aié", "must"),
    ]), needed({0: 2, 1: 2, 2: 3, 3: 2})),
    "search_exclude": search_sql(word_list([
        one(0, 0, "the"), one(0, 1, "of", "must_not"),
        one(1, 0, "trash"), one(1, 1, "lynt"), *phrase(1, 2, "of the", "must_not"),
    ])),
    "search_phrase": ctes(*INDEXED, r"""asked AS (
  SELECT item_id AS qid, text FROM benchmark
  UNION ALL SELECT * FROM (VALUES (-1, 'of the'), (-2, 'the of'), (-3, 'in the and'),
                                  (-4, 'BY-NC'), (-5, 'the the')) v(qid, text)),
clause_words AS (
  SELECT qid, 0 AS clause_id, 'should' AS occur, 1.0::DOUBLE AS boost, off, lower(w) AS term FROM (
    SELECT qid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS off
    FROM (SELECT qid, regexp_extract_all(text, '[\p{L}\p{N}]+') AS ws FROM asked))
  WHERE strlen(w) < 40)""", SCORED, PLAIN_HITS, NONE_NEEDED, MATCHED, ranked()) + RESULT,
    "search_phrase_slop": SLOP_SQL,
    "search_phrase_prefix": PREFIX_SQL,
    "search_term_set": mixed_sql(
        word_list([one(1, 1, "bleble", "must")]),
        holding(0, "term IN ('trash', 'oror')") + " UNION ALL "
        + holding(1, "term IN ('the', 'lynt', 'aié')", "2.0"), needed({1: 1})),
    "search_term_range": mixed_sql(
        word_list([one(3, 1, "thrend", "must")]),
        " UNION ALL ".join([
            holding(0, "term >= 'tra' AND term < 'tre'"), holding(1, "term >= 'w'"),
            holding(2, "term = 'trash'"), holding(3, "term > 'aié' AND term < 'b'"),
        ]), needed({3: 1})),
    "search_boost": search_sql(word_list([
        one(0, 0, "the"), one(0, 1, "trash", boost=2.5),
        one(1, 0, "lynt", boost=0.5), *phrase(1, 1, "of the", boost=3.0),
    ])),
    "search_match_all": mixed_sql(
        word_list([one(1, 1, "the", "must_not"), one(2, 1, "trash")]),
        """SELECT 0, 'should', path, 1.0::DOUBLE FROM docs
UNION ALL SELECT 1, 'should', path, 1.0::DOUBLE FROM docs
UNION ALL SELECT 2, 'must', path, 2.0::DOUBLE FROM docs""", needed({2: 1}), k=200),
    "search_by_path": ctes(DOCS) + PATH_SEARCH,
    "search_nested": NESTED_SQL,
    "search_nested_table": NESTED_TABLE_SQL,
    "search_updated_index": ctes(*UPDATED, BENCH_QUERIES, keyword_words("queries"), SCORED, PLAIN_HITS,
                                 NONE_NEEDED, MATCHED, ranked()) + RESULT,
    "stream_changes": ctes(*FEED) + "SELECT seq, op, path, old_path FROM changes",
    "stream_apply": final_lengths(),
    "watch_tree": ctes(DOCS, "files AS (SELECT DISTINCT path, doc_id % 7 AS part FROM docs WHERE path IS NOT NULL)")
    + """SELECT 0::BIGINT AS seq, 'put' AS action, path FROM files WHERE part <> 3
UNION ALL SELECT 1, 'put', path FROM files WHERE part IN (0, 3)
UNION ALL SELECT 1, 'delete', path FROM files WHERE part IN (1, 2)
UNION ALL SELECT 1, 'put', '/moved' || path FROM files WHERE part = 2""",
    "snapshot_diff": ctes(DOCS, PAGES, LISTINGS) + """SELECT 'modify' AS op, path, NULL AS old_path FROM both_sides
WHERE old_hash <> new_hash
UNION ALL
SELECT CASE WHEN g.path IS NULL THEN 'create' WHEN f.path IS NULL THEN 'delete' ELSE 'rename' END,
       coalesce(f.path, g.path), CASE WHEN f.path IS NOT NULL THEN g.path END
FROM gone g FULL OUTER JOIN fresh f ON g.hash = f.hash AND g.n = f.n""",
    "classify_events": ctes(*FEED) + "SELECT seq, epoch_us(ts) AS ts, op, path, old_path FROM changes",
    "debounce": ctes(*FEED, """timed AS (
  SELECT *, epoch_us(ts) AS us FROM changes WHERE path IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 7200000000 THEN 0 ELSE 1 END AS opens FROM timed
  WINDOW w AS (PARTITION BY path ORDER BY us, seq)),
bursts AS (
  SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS burst FROM marked)""") + """SELECT path, min(us) AS first_us, max(us) AS last_us, count(*) AS n, max(seq) AS seq,
       arg_max(op, (seq, op)) AS op
FROM bursts GROUP BY path, burst""",
    "batch_changes": """WITH marked AS (
  SELECT event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) <= 300000000
                       THEN 0 ELSE 1 END AS opens FROM events),
groups AS (
  SELECT *, sum(opens) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS group_no FROM marked)
SELECT event_id AS seq, group_no::BIGINT AS group_no,
       (row_number() OVER (PARTITION BY group_no ORDER BY ts, event_id) - 1) // 10 AS batch_no
FROM groups""",
    "quarantine": ctes(*FEED, CHECKED)
    + "SELECT seq, op, path, old_path, reason FROM checked WHERE reason IS NOT NULL",
}
