import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, here as foreign columns of the input.
CLASHING = ("digest", "keep_id", "row_key", "kept", "spans", "ids", "region", "component", "pos", "h1", "text_a", "own_0", "OWN_1", "__digest")


@pytest.fixture
def docs_of(spark):
    """Documents from ``(doc_id, text[, lang, source])`` tuples."""

    def make(rows, clashing=False):
        full = [(r[0], r[1], *(r[2:] + ("en", "src")[len(r) - 2:]), len(r[1]) if r[1] is not None else None) for r in rows]
        docs = spark.createDataFrame(full, DOCS)
        if clashing:
            from pyspark.sql import functions as F

            docs = docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])
        return docs

    return make


@pytest.fixture
def edge_rows():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    words = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \n\t\n "), (4, words), (5, words), (6, "one two three four five six seven"),
        (6, "one two three four five six seven"), (None, "one two three four five six seven"), (7, "x"),
        (8, "a line that is long enough to count\nshort\n" * 3), (9, "A LINE that is long enough to count \nother"),
        (10, "a line that is long enough to count"), (None, None), (11, "snow ☃ and é \U0001f642 password: hunter2222"),
    ]
