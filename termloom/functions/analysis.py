"""Text analysis as column expressions, shared by documents and queries.

A token is a run of alphabetic or numeric characters. Tokens are numbered,
then tokens of 40 UTF-8 bytes or more are left out (the others keep their
numbers), then the rest is lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the analysis rule.
TOKEN_PATTERN = r"([\p{IsAlphabetic}\p{N}]+)"
GAP_PATTERN = r"[^\p{IsAlphabetic}\p{N}]+"
TOKEN_BYTE_LIMIT = 40


def tokens(text: Column) -> Column:
    """``array<struct<term, pos>>`` in text order; null text has no tokens."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(1))
    numbered = F.transform(words, lambda word, i: F.struct(word.alias("word"), i.alias("pos")))
    kept = F.filter(numbered, lambda t: F.octet_length(t["word"]) < TOKEN_BYTE_LIMIT)
    return F.transform(
        kept, lambda t: F.struct(F.lower(t["word"]).alias("term"), t["pos"].alias("pos"))
    )


def spaced(text: Column) -> Column:
    """A text with one blank for every gap between words; so also before the first, if one is there.

    It may be lower-cased as a whole: no rule of case looks past a blank.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP_PATTERN, " ")
