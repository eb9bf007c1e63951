"""Registered queries against their SQL, at the smallest scale.

The quick ones run here; ``python tests/check_oracle.py sf0.01`` runs all.
"""

import os
import sys
from pathlib import Path

import check_oracle
import pytest

import __spark_entry__ as entry
from termloom.plans.oracle import ORACLE_SQL
from termloom.plans.registered import registered

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "filter_extension", "normalize_path", "filter_path_prefix", "expand_renames", "tokenize", "build_postings",
    "doc_lengths", "term_stats", "corpus_stats", "index_in_memory", "search_any", "search_all", "search_exclude",
    "search_phrase", "search_phrase_slop", "search_phrase_prefix", "search_term_set", "search_term_range",
    "search_match_all", "search_by_path", "search_nested", "search_nested_table", "search_status", "hits_as_json", "classify_events",
    "debounce", "batch_changes", "watch_tree", "snapshot_diff", "fold_change_log", "quarantine", "stream_changes",
]
KEYS = list(registered()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def db():
    return check_oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(registered()) == set(ORACLE_SQL) <= set(entry.queries())


def test_entry_does_without_the_optional_parts(monkeypatch):
    """Only the absence of the optional modules themselves is accepted."""
    source = Path(entry.__file__).read_text()
    for gone in ("termloom.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)
        scope = {"__name__": "entry_copy"}
        exec(compile(source, entry.__file__, "exec"), scope)
        assert set(scope["queries"]()) == set(registered())
        monkeypatch.undo()


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, db, key):
    assert check_oracle.compare(spark, db, SF_DIR, key) is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["qid", "rank", "path", "score"] and result.count() > 0
