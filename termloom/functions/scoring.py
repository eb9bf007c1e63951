"""BM25 (Robertson and Zaragoza, 2009) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
K1 = 1.2
B = 0.75

SCORE_DIGITS = 6


def idf(n_docs: int, df: Column) -> Column:
    """Inverse document frequency of a term found in ``df`` of ``n_docs``."""
    return F.log(1 + (F.lit(float(n_docs)) - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avg_dl: float) -> Column:
    """Term-frequency part; grows with ``tf`` and shrinks with length."""
    # An empty corpus has no postings, so the divisor only has to be legal.
    norm = (1 - B) + B * dl / F.lit(avg_dl or 1.0)
    return tf * (K1 + 1) / (tf + K1 * norm)
