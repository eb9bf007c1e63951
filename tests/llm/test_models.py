"""Secrets, language, quality: brute force and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from termloom.llm import language, quality, secrets

SF_DIR = "/root/testdata/sf0.001"


def brute_windows(text, window=20):
    limit = secrets.THRESHOLDS[secrets.char_class(text)]
    spans = []
    for i in range(len(text) - window + 1):
        part = text[i:i + window]
        entropy = -sum(n / window * math.log2(n / window) for n in Counter(part).values())
        digits = sum(c.isdigit() for c in part)
        if entropy >= limit - 1e-9 and digits >= 2 and window - digits >= 2:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + window
            else:
                spans.append([i, i + window])
    return [tuple(s) for s in spans]


def test_incremental_entropy_equals_brute_force():
    rng = random.Random(5)
    for alphabet in ("0123456789abcdef", "abcXYZ0189", "aB3+/=_-9zQ", "aaaab1"):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 70)))
            assert secrets.hot_windows(text) == brute_windows(text)


def test_spans_of_each_kind():
    key = "AKIA" + "Q7" * 8
    text = f"é password = \"hunter2222\" x {key} y 0123456789abcdef01234567 TOKEN: abc api_key='Zx81kLm+/9Qw'"
    spans = secrets.find_spans(text)
    kinds = {(k, text[a:b]) for k, a, b in spans}
    assert ("assign", 'password = "hunter2222') in kinds and ("access", key) in kinds
    assert ("hex", "0123456789abcdef01234567") in kinds and ("assign", "api_key='Zx81kLm+/9Qw") in kinds
    assert not any("abc api" in s for _, s in kinds)
    assert spans == sorted(spans, key=lambda s: (s[1], secrets.RANK[s[0]]))
    # The Kelvin sign and the long s are no ASCII letters.
    assert secrets.find_spans("toKen=abcdefg paſsword=abcdefg") == []


def test_a_short_match_uses_up_its_text():
    assert secrets.find_spans("password = token: abcdefgh") == []


def test_entropy_finds_and_suppresses():
    found = secrets.find_spans("blob q8Zt3vK1xW9pL5nB7cR2 end")
    assert [k for k, *_ in found] == ["entropy"]
    for harmless in (
        "id 123e4567-e89b-12d3-a456-426614174000 end", "see http://host/q8Zt3vK1xW9pL5nB7cR2 end",
        "word internationalisationconference end", "key EXAMPLEq8Zt3vK1xW9pL5nB7 end", "digits 11111111112222222222 end",
    ):
        assert secrets.find_spans(harmless) == [], harmless


@pytest.mark.parametrize("before", ["sig=", "client_key=", "/srv/keys/", "name-", "x_", "https://host/a?sig=", "https://host/hooks/"])
def test_entropy_of_glued_keys(before):
    rng = random.Random(6)
    covered = found = 0
    for _ in range(200):
        key = "".join(rng.choice("0123456789ABCDEF") for _ in range(40))
        text = f"see {before}{key} end"
        at = text.index(key)
        spans = [s for s in secrets.find_spans(text) if s[0] == "entropy"]
        found += bool(spans)
        covered += sum(max(0, min(b, at + 40) - max(a, at)) for _, a, b in spans)
    assert found >= 198 and covered >= 0.9 * 200 * 40


def test_allow_list_is_limited_to_its_part():
    key, digest = "q8Zt3vK1xW9pL5nB7cR2", "Ab3dE6gH9jK2mN5pQ8sT"
    for text in (
        f"https://user:{key}@host/a", f"https://host/{digest}?sig={key}", f"https://host/{digest}#{key}",
        f"https://host/services/hook/{key}", f"id=123e4567-e89b-12d3-a456-426614174000/{key}", f"example/{key}",
    ):
        assert any(key in text[a:b] for _, a, b in secrets.find_spans(text)), text
    for text in (f"https://host/a/{digest}/b", "ref=123e4567-e89b-12d3-a456-426614174000"):
        assert secrets.find_spans(text) == [], text


def test_scan_and_redact(spark, docs_of, edge_rows):
    docs = docs_of(edge_rows, clashing=True)
    rows = secrets.scan(docs).collect()
    assert len(rows) == len(edge_rows) and [len(r.spans) for r in rows if r.doc_id == 11] == [1]
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[11] == "snow ☃ and é \U0001f642 [SECRET]" and texts[1] is None and texts[4] == edge_rows[3][1]
    assert secrets.scan(docs.limit(0)).count() == 0
    assert secrets.redacted("ab cd ef", [("a", 0, 4), ("b", 2, 5), ("c", 6, 8)], "*") == "* *"


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 5, 9, 30):
        code = language.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {1, -1}
        distances = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert not distances or min(distances) >= max(1, code.shape[1] // 4)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs_of, edge_rows):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(40)] + [(50 + i, "der hund und die katze " * 3, "de") for i in range(40)]
    rows += [(200, "12 34 .", "en"), (201, None, "en"), (202, "", None), (None, "the dog", "en"), (203, "der hund " * 100_000, None)]
    found = language.identify(docs_of(rows, clashing=True)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (200, 201, 202))
    assert by_id[203].lang_pred == "de" and by_id[None].lang_pred == "en" and not by_id[None].held_out
    unknown = language.identify(docs_of([(1, "abc", None)]))
    assert unknown.first().lang_pred == "und" and language.identify(docs_of(rows).limit(0)).count() == 0


def test_language_does_not_see_held_out_labels(spark, docs_of):
    rows = [(i, "the cat and the dog", "en") for i in range(60)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    assert {r.lang_pred for r in language.identify(docs_of(wrong)).collect()} == {"en"}


def test_every_language_is_learned(spark, docs_of):
    rng = random.Random(4)
    rows = []
    for k in range(150):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        # The languages after the first hundred are the rare ones.
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=30)), f"l{k:03}") for i in range(16 if k < 100 else 12)]
    found = {r.doc_id: r for r in language.identify(docs_of(rows)).collect()}
    held = [(lang, found[i].lang_pred) for i, _, lang in rows if found[i].held_out]
    assert len({lang for lang, _ in held if lang >= "l100"}) > 40
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert sum(a == b for a, b in held if a >= "l100") >= 0.95 * sum(a >= "l100" for a, _ in held)


def test_quality_separates_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert not bad or sum(not r.kept for r in bad) >= 0.7 * len(bad)


def good_text(i):
    rng = random.Random(i)
    return ". ".join(" ".join(rng.choice(["river", "stone", "cloud", "lamp", "and", "the", "of"]) for _ in range(9)).capitalize() for _ in range(6)) + "."


def test_quality_on_unseen_rows(spark, docs_of):
    rows = [(i, good_text(i) if i % 3 else f"BUY!! NOW {i}!! $$$ ### " * 20) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(100)] + [(5, None), (None, 1)], "doc_id long, quality int")
    found = quality.classify(docs_of(rows, clashing=True), labels).collect()
    wrong = [r.doc_id for r in found if r.kept != (r.doc_id % 3 != 0)]
    assert len(found) == 300 and len(wrong) <= 3
    assert all(0 <= s <= 1 for r in found for s in (r.content_score, r.metadata_score, r.score))


def test_quality_keeps_a_rare_class_of_labels(spark, docs_of):
    rows = [(i, f"BUY!! NOW {i}!! $$$ ### " * 20 if i % 200 == 0 else good_text(i)) for i in range(2_000)]
    labels = spark.createDataFrame([(i, int(i % 200 != 0)) for i in range(1_600)], "doc_id long, quality int")
    docs = docs_of(rows)
    model = quality.train(docs, labels, labelled=100)
    assert model is not None
    found = {r.doc_id: r.kept for r in quality.score(docs, model).collect()}
    assert not any(found[i] for i in range(0, 2_000, 200))
    assert sum(found.values()) >= 0.97 * 1_990


def test_pseudo_labels_come_from_all_rows(spark, docs_of):
    rows = [(i, good_text(i) if i % 3 else f"BUY!! NOW {i}!! $$$ ### " * 20) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(100)], "doc_id long, quality int")
    seen = {}

    class Recorded(quality.Pool):
        def pick(self, *args):
            out = super().pick(*args)
            seen.update(size=self.rows.count(), picked=len(self.gone))
            return out

    plain, quality.Pool = quality.Pool, Recorded
    try:
        assert quality.train(docs_of(rows), labels, unlabelled=50) is not None
    finally:
        quality.Pool = plain
    # Candidates are all 500, a round takes its share of 50.
    assert seen["size"] == 500 and 0 < seen["picked"] <= 2 * 5 * 4


def test_the_surest_rows_of_many_tasks_are_few(spark):
    found = spark.range(0, 60_000, 1, 200).selectExpr(
        "id % 2 as view", "id div 2 % 2 as label", "pmod(hash(id), 1000) / 1000 as p", "id % 7 as lot", "id as row"
    )
    rows = quality.first_rows(found, 50).collect()
    assert len(rows) == 200
    best = sorted((-(r.p if r.label else -r.p), r.lot, r.row) for r in found.collect() if (r.view, r.label) == (1, 1))[:50]
    assert {r.row for r in rows if (r.view, r.label) == (1, 1)} == {b[2] for b in best}


def test_quality_edges(spark, docs_of, edge_rows):
    docs = docs_of(edge_rows, clashing=True)
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept and r.score == 1 for r in quality.classify(docs, nothing).collect())
    assert quality.keep_good(docs, nothing).count() == len(edge_rows)
    few = spark.createDataFrame([(4, 1), (2, 0), (5, 1), (3, 0), (6, 1), (6, 0)], "doc_id long, quality int")
    assert quality.classify(docs, few).count() == len(edge_rows)
    kept = quality.keep_good(docs, few)
    assert kept.columns == docs.columns and kept.count() <= len(edge_rows)
    assert quality.classify(docs.limit(0), few).count() == 0


def test_logistic_recovers_a_boundary():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] - 2 * x[:, 1] > 0.3).astype(float)
    assert (((quality.Logistic(x, y).logit(x) > 0) == (y > 0)).mean()) > 0.97


@pytest.mark.parametrize("text", ["", None, "x", "\n\n", "é" * 50])
def test_features_are_finite(text):
    assert np.isfinite(quality.content_features(text)).all()
    assert np.isfinite(quality.metadata_features(None, None, None, text)).all()
    assert re.match(r"\d+", str(len(quality.content_features(text))))
