"""The registered queries of this subpackage and their SQL.

Each query applies one operator to its whole table and derives the digest
columns from what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import (
    hard_negatives, language, near_dedup, packing, piece_bpe, prefix_trie, quality, secrets, substring_dedup, topk, warc,
)
from termloom.llm.common import table
from termloom.llm.exact_dedup import decide
from termloom.llm.line_dedup import dedup_lines


BASE_KINDS = ("assign", "access", "hex")


def _listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _sha256(text: F.Column) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def number(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, BASE_KINDS),
        _sha256(_listed(F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS)))).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_bpe.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        _sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(pages)
    index = warc.write_archives(pages, folder)
    return warc.read_records(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), hard_negatives.changed_label())


def trie_rows(conversations: DataFrame, **options) -> DataFrame:
    """The nodes with the digest of their end lists."""
    trie = prefix_trie.prefix_trie(conversations, **options)
    listed = {k: v for k, v in options.items() if k == "listed"}
    digests = prefix_trie.end_digests(trie, **listed)
    return trie.nodes.join(digests, prefix_trie.NAME, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_rows(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_topk": op7_topk,
    "op8_near_dedup": op8_near_dedup,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op7_topk": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op10_warc": """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> keeper THEN keeper END AS refers_to
FROM first
""",
    "op6_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered),
frequent AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.last_id AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_substring_dedup": r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS owner,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, owner, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM split),
windows AS (
  SELECT *, CASE WHEN pos <= n - 12 THEN string_agg(word, ' ') OVER (
    PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS text FROM words),
least AS (SELECT text, min(owner) AS first FROM windows WHERE text IS NOT NULL GROUP BY text),
started AS (
  SELECT x.*, coalesce(x.owner > l.first, false) AS again FROM windows x LEFT JOIN least l ON x.text = l.text),
covered AS (
  SELECT r, pos, word, bool_or(again) OVER (
    PARTITION BY r ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM started),
per_row AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM covered GROUP BY r)
SELECT s.doc_id, len(s.w) AS n_words, coalesce(p.n_removed, 0) AS n_removed, sha256(coalesce(p.kept, '')) AS kept_sha256
FROM split s LEFT JOIN per_row p ON s.r = p.r
""",
    "op12_hard_negatives": """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         list_dot_product(a.v, c.v)::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) AS n FROM pairs WHERE same)
  WHERE n <= 5),
ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, c.other_id AS negative_id, p.score AS positive_score,
         c.score AS negative_score,
         row_number() OVER (PARTITION BY p.r, p.n ORDER BY c.score DESC, c.other_id)::INTEGER AS rank
  FROM positives p JOIN pairs c ON p.r = c.r AND NOT c.same
    AND 30 * p.score <= 100 * c.score AND 100 * c.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""",
    "op13_prefix_trie": r"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS opener, max(pos) AS n,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
           4294967295::BIGINT) % 4 AS h
  FROM placed GROUP BY conv_id),
given AS (
  SELECT c.conv_id, c.opener, c.h, least(c.h, coalesce(o.n, 0)) AS k
  FROM convs c LEFT JOIN convs o ON o.conv_id = c.opener),
turns AS (
  SELECT g.conv_id, p.pos AS depth, p.role, p.text FROM given g JOIN placed p ON p.conv_id = g.opener AND p.pos <= g.k
  UNION ALL
  SELECT g.conv_id, p.pos - g.h + g.k, p.role, p.text FROM given g JOIN placed p ON p.conv_id = g.conv_id AND p.pos > g.h),
paths AS (
  SELECT conv_id, depth, text, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (
    PARTITION BY conv_id ORDER BY depth)) AS name,
    CASE WHEN depth = 1 THEN '' ELSE sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (
      PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS parent
  FROM turns
  UNION ALL
  SELECT conv_id, 0, '', '', NULL FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
  SELECT depth, name, any_value(parent) AS parent, min(p.conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(len(regexp_extract_all(text, '[^ 	-
]+'))) AS own,
         coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.length = p.depth), '') AS ends
  FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY depth, name),
children AS (SELECT depth - 1 AS depth, parent AS name, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT p.depth, p.name, sum(v.own)::BIGINT AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes v LEFT JOIN children c ON c.depth = v.depth AND c.name = v.name
  JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.depth, p.name)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       b.leaves AS n_leaves, b.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.name = n.name
LEFT JOIN children c ON c.depth = n.depth AND c.name = n.name
LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.name = n.parent
""",
}
