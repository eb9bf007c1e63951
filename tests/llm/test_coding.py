"""Tokenising, packing and archives: libraries, round trips, brute force."""

import gzip
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termloom.llm import packing, piece_bpe, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", "ing", "é", "▁", "中", "\n", "\x00", "12", "er", "²", ".", "\U0001f642", "a", "T", "—"]), max_size=25).map("".join))
def test_pieces_equal_the_library(text):
    codec = piece_bpe.encoder(MODEL)
    assert codec.encode(text) == codec.library.encode(text)


def test_every_prefix_has_one_last_piece():
    codec = piece_bpe.encoder(MODEL)
    word = "▁internationalisation"
    for n in range(1, len(word) + 1):
        fitting = []
        for size in range(1, n + 1):
            ids = codec.encode_word(word[:n - size]) if n > size else ()
            last = codec.number.get(word[n - size:n])
            if last is not None and codec.merge(word[n - size:n]) == [word[n - size:n]] and (not ids or codec.compatible(ids[-1], last)):
                fitting.append(last)
        assert fitting == [codec.encode_word(word[:n])[-1]]


def test_encode_documents(spark, docs_of, edge_rows, library):
    rows = piece_bpe.encode_documents(docs_of(edge_rows, clashing=True), MODEL).collect()
    want = Counter()
    for doc_id, text in edge_rows:
        ids = library.encode(text or "")
        want[(doc_id, tuple(ids), library.decode(ids))] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == want
    assert piece_bpe.encode_documents(docs_of([(1, "")]).limit(0), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(MODEL, "rb") as source:
        model.ParseFromString(source.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.PieceEncoder(str(tmp_path / "other.model"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_packing_fits_and_loses_nothing(sizes):
    windows = packing.pack(sizes, 64)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 64 for w in windows)


def test_differencing_balances():
    rng = random.Random(3)
    sizes = [rng.randint(1, 256) for _ in range(400)]
    loads = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 50)]
    assert len(loads) == 50 and max(loads) - min(loads) <= 8
    best = min(
        max(sum(s for s, w in zip((8, 7, 6, 5, 4), deal, strict=True) if w == k) for k in (0, 1))
        for deal in itertools.product((0, 1), repeat=5)
    )
    assert max(sum((8, 7, 6, 5, 4)[i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) <= best + 1


def test_packed_documents(spark, docs_of, edge_rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = edge_rows + [(100 + i, f"document number {i} " * (i % 60)) for i in range(300)]
    unique = {i: r for i, r in enumerate(rows)}
    docs = docs_of([(i, r[1]) for i, r in unique.items()], clashing=True)
    pieces = packing.pack_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    found, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        found[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    for i, (_, text) in unique.items():
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(found[i], key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts])
        assert ids.tolist() == want and all(p.doc_tokens == len(want) for p in parts)
        assert [p.start for p in parts] == [0, *itertools.accumulate(p.length for p in parts)][:-1]
    padding = 0
    for parts in windows.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [0, *itertools.accumulate(p.length for p in parts)][:-1]
        total = sum(p.length for p in parts)
        assert total <= 1024
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    tasks = docs.rdd.getNumPartitions()
    assert padding <= 0.02 * sum(p.length for p in pieces) + 2 * 1024 * tasks
    crc = spark.createDataFrame([(pieces[0].ids,)], "b binary").select(F.crc32("b")).first()[0]
    assert crc == zlib.crc32(pieces[0].ids)
    missing = packing.pack_documents(docs_of([(None, "x"), (5, "y"), (5, "y")]), RANKS, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or -1) for r in missing.collect()) == [-1, 5, 5]
    assert packing.pack_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n", "\t \u2003"])
def test_packing_encodes_long_blank_runs(spark, docs_of, blank):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    run = blank * (1_200_000 // len(blank))
    texts = [f"x{run}y", f"{run}\x1c.", f"a {run}", f"it's{run}\n9{run[1:]} end"]
    pieces = packing.pack_documents(docs_of(list(enumerate(texts))), RANKS, public_tokenizers.PATTERN).collect()
    for i, text in enumerate(texts):
        parts = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts])
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids + [0]


def test_blank_runs_are_cut_as_the_pattern_cuts(monkeypatch):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    codec = packing.tokenizer(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(packing, "BLANKS", 2)
    monkeypatch.setattr(packing, "BLANK_RUN", re.compile(packing.BLANK_RUN.pattern.replace("{65536,}", "{2,}")))
    rng = random.Random(8)
    for _ in range(3_000):
        text = "".join(rng.choice([" ", " ", "\n", "\x1c", "\x1f", "\x85", "\u200b", "\u3000", "a", "'s", "7", ".", "é"]) for _ in range(12))
        assert packing.encode(text, codec) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_many_shorter_blank_runs_take_linear_time():
    codec = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    begun = time.process_time()
    ids = packing.encode(("word" + " " * 60_000) * 30, codec)
    assert time.process_time() - begun < 2 and len(ids) > 30
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for n in (packing.BLANKS - 1, packing.BLANKS, packing.BLANKS + 1):
        text = f"a{' ' * n}b\n{' ' * n}"
        assert packing.encode(text, codec) == library.encode(text, add_special_tokens=False).ids


def test_packing_emits_added_tokens(spark, docs_of):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {t.content: i for i, t in plain.get_added_tokens_decoder().items()} == packing.SPECIALS
    end = "<|endoftext|>"
    texts = [f"one {end} two", end, end * 3, f"a{end}b \n {end}\n", f"<|{end}|>", "<|endoftext|", f"  {end}  's", f"x {end}" + " " * 70_000 + end]
    pieces = packing.pack_documents(docs_of(list(enumerate(texts))), RANKS, public_tokenizers.PATTERN).collect()
    for i, text in enumerate(texts):
        parts = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts])
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids + [0], text[:40]


PAGES = "page_id long, url string, html string, digest string, keeper string, archive string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "d", "k", "a") for r in rows], PAGES)


def test_archives(spark):
    same = "same payload " * 20
    rows = [
        (3, "http://a/3", same), (1, "http://a/1", same), (2, None, same), (4, "http://a/\r\nX: y", "short"), (5, "u", "short"),
        (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\n" * 40), (9, "u", "é☃" * 60_000), (None, "u", same), (1, "http://a/1", same),
        (10, "u", "x" * 100), (11, "u", "x" * 100), (12, "u", "x" * 99), (13, "u", "x" * 99), (None, "u", "only without id " * 20),
    ]
    pages = pages_of(spark, rows)
    folder = warc.archive_folder(pages)
    index = warc.write_archives(pages, folder, archive_bytes=2_000)
    assert index.columns == ["archive", "offset", "length", "url", "digest", "page_id"]
    got = warc.read_records(index, folder, task_bytes=1_000).collect()
    keeper = {same: 1, "x" * 100: 10}
    want = Counter()
    for page_id, _, html in rows:
        payload = (html or "").encode()
        first = keeper.get(html)
        revisit = first is not None and page_id is not None and page_id != first
        want[(page_id, len(payload), "revisit" if revisit else "response", first if revisit else None, None if revisit else payload)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    some = warc.read_records(index.filter("page_id in (4, 9)"), folder, gap=0).collect()
    assert {r.page_id for r in some} == {4, 9}
    none = warc.write_archives(pages.limit(0), folder)
    assert none.count() == 0 and warc.read_records(none, folder).count() == 0


def test_many_archives_are_read_by_a_bounded_number_of_tasks():
    assert [warc.reading_tasks(n, warc.TASK_BYTES) for n in (0, 1, 20 << 20, 20 << 40)] == [1, 1, 2, 20_000]


def test_keepers_without_room_for_all_groups(spark, monkeypatch):
    html = [f"<p>{'x' * 120}{i % 9}</p>" if i % 4 else None for i in range(90)]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    want = {r.page_id: r.keeper for r in warc.deduplicated(pages).collect()}
    monkeypatch.setattr("termloom.llm.common.BROADCAST_BYTES", 112 * 3)
    assert {r.page_id: r.keeper for r in warc.deduplicated(pages).collect()} == want
    assert sum(k is not None for k in want.values()) == sum(h is not None and h in html[:i] for i, h in enumerate(html))


def test_a_wrong_payload_is_refused():
    digest = hashlib.sha256(b"right payload").hexdigest()
    right = warc.record(5, "u", b"right payload", digest, None)
    got = warc.parse(gzip.compress(right))
    assert (got["payload"], got["payload_bytes"], got["payload_digest"]) == (b"right payload", 13, digest)
    for wrong in (b"wrong payload", b"right payloa\n"):
        with pytest.raises(ValueError, match="payload"):
            warc.parse(gzip.compress(right.replace(b"right payload", wrong)))


def test_ranges_are_joined():
    entries = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 500, 5), ("b", 505, 5)]
    assert [len(g) for g in warc.ranges(entries, gap=30, longest=1000)] == [3, 1, 1]
    assert [len(g) for g in warc.ranges(entries, gap=1000, longest=15)] == [2, 1, 1, 1]
    assert list(warc.ranges([], 1, 1)) == []
