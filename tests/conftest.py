import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus_of(spark):
    """A corpus from ``{path: content}``."""

    def make(files: dict):
        return spark.createDataFrame(list(files.items()), "path string, content string")

    return make


@pytest.fixture
def changes_of(spark):
    """Changes from ``(seq, op, path[, old_path])`` tuples."""

    def make(rows: list[tuple]):
        full = [(r[0], None, r[1], r[2], r[3] if len(r) > 3 else None) for r in rows]
        return spark.createDataFrame(
            full, "seq long, ts timestamp, op string, path string, old_path string"
        )

    return make
