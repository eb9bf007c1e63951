"""Postings, document lengths and term statistics.

Everything about one document comes from its own row, so building postings needs
no shuffle and the document length travels with each posting. Words are found and
lower-cased by native expressions; the positions of equal words are then brought
together for many documents at a time, as Arrow columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.analysis import TOKEN_BYTE_LIMIT, spaced, tokens

ENTRIES = "term string, path string, tf int, positions array<int>, dl int"
PACKED = "bucket int, size int, packed binary"
DOCUMENT_BUCKET = -1
TEXT_AT_ONCE = 4 << 20  # bytes of text taken together, unless one document has more
ROWS_AT_ONCE = 1 << 16  # postings handed back together
PACKED_AT_ONCE = 1 << 18  # postings packed together

_texts: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()  # what entries are cut from


def is_document() -> Column:
    """Tells document rows from postings; no token is empty."""
    return F.col("term") == ""


def tokenize(corpus: DataFrame) -> DataFrame:
    """``(path, pos, term)``, one row per token."""
    return corpus.select("path", F.inline(tokens(F.col("content")))).select("path", "pos", "term")


def build_entries(corpus: DataFrame, buckets: int = 1) -> DataFrame:
    """Postings plus one document row (empty term) per document.

    The postings of documents taken together come by bucket of the term (see
    ``bucket_of``), term and path: runs that a later sort only has to merge.
    """
    texts = corpus.select("path", spaced(F.col("content")).alias("written"))
    texts = texts.select("path", "written", F.lower("written").alias("lowered"))
    entries = texts.mapInArrow(_entries(buckets), ENTRIES)
    _texts[entries] = texts
    return entries


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def _entries(buckets: int, limit: int = TEXT_AT_ONCE, size: int = ROWS_AT_ONCE):
    """Spaced texts ``(path, written, lowered)`` to entries; self-contained."""
    longest = TOKEN_BYTE_LIMIT
    schema = pa.schema([
        ("term", pa.string()), ("path", pa.string()), ("tf", pa.int32()),
        ("positions", pa.list_(pa.int32())), ("dl", pa.int32()),
    ])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same rows, dealt anew: about ``limit`` bytes of text in each batch."""
        held, n_bytes = [], 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            done = 0
            while done < batch.num_rows:
                before = int(ends[done - 1]) if done else 0
                upto = max(int(np.searchsorted(ends, before + limit - n_bytes, "right")), done + (not held))
                if upto > done:
                    held.append(batch.slice(done, upto - done))
                    n_bytes, done = n_bytes + int(ends[upto - 1]) - before, upto
                if done < batch.num_rows:
                    yield pa.concat_batches(held)
                    held, n_bytes = [], 0
        if held:
            yield pa.concat_batches(held)

    def rank(order: np.ndarray) -> np.ndarray:
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        return ranks

    def by_bucket(terms: pa.Array) -> np.ndarray:
        order = pc.sort_indices(terms).to_numpy()
        if buckets == 1:
            return order
        ends, data = np.frombuffer(terms.buffers()[1], np.int32)[: len(terms) + 1].tolist(), memoryview(terms.buffers()[2])
        homes = np.array([zlib.crc32(data[a:b]) % buckets for a, b in zip(ends, ends[1:])], np.int64)
        return order[np.argsort(homes[order], kind="stable")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            paths, docs = batch.column(0).cast(pa.string()), batch.num_rows
            written, lowered = (pc.split_pattern(text, " ") for text in batch.columns[1:])
            n = pc.list_value_length(written).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(n) - n
            n_bytes = pc.binary_length(written.flatten()).to_numpy(zero_copy_only=False)
            # Numbered before long words are left out; an empty first piece is no word.
            place = np.arange(len(n_bytes)) - np.repeat(first + (n_bytes[first] == 0), n)
            kept = (n_bytes > 0) & (n_bytes < longest)
            doc, place = np.repeat(np.arange(docs), n)[kept], place[kept].astype(np.int32)
            dl = np.bincount(doc, minlength=docs).astype(np.int32)
            by_path = pc.sort_indices(paths, null_placement="at_start").to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array([""] * docs, pa.string()), paths.take(pa.array(by_path)), pa.array(np.zeros(docs, np.int32)),
                pa.ListArray.from_arrays(pa.array(np.zeros(docs + 1, np.int32)), pa.array([], pa.int32())),
                pa.array(dl[by_path]),
            ], schema=schema)
            if not len(doc):
                continue
            coded = lowered.flatten().filter(pa.array(kept)).cast(pa.string()).dictionary_encode()
            terms, term = coded.dictionary, coded.indices.to_numpy()
            key = rank(by_bucket(terms))[term] * docs + rank(by_path)[doc]
            order = np.argsort(key, kind="stable")  # so that places stay in order
            key = key[order]
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            offsets = np.append(begins, len(key)).astype(np.int32)
            mine = doc[order[begins]]
            entries = pa.RecordBatch.from_arrays([
                terms.take(pa.array(term[order[begins]])), paths.take(pa.array(mine)), pa.array(np.diff(offsets)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order])), pa.array(dl[mine]),
            ], schema=schema)
            for at in range(0, entries.num_rows, size):
                yield entries.slice(at, size)

    return run


def pack(entries: DataFrame, buckets: int) -> DataFrame:
    """Entries to be shuffled, as a few compressed rows: those of one bucket, out of many at a time.

    What ``build_entries`` gave is cut and packed in one go.
    """
    if entries in _texts:
        return _texts[entries].mapInArrow(_packer(buckets, cut=_entries(buckets)), PACKED)
    return entries.select("term", "path", "tf", "positions", "dl").mapInArrow(_packer(buckets), PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """The entries that ``pack`` took, with their ``bucket`` (see ``bucket_of``); document rows have their own."""
    return packed.select("bucket", "size", "packed").mapInArrow(_unpacker(), f"{ENTRIES}, bucket int")


def _packer(buckets: int, limit: int = PACKED_AT_ONCE, cut: Callable = iter):
    """Entries, or what ``cut`` makes entries of, to packed rows; self-contained.

    A row has the terms, with the number of their postings, the documents, and the
    postings by term and path. Numbers lie byte by byte, so that high bytes vanish.
    """
    documents = DOCUMENT_BUCKET
    schema = pa.schema([("bucket", pa.int32()), ("size", pa.int32()), ("packed", pa.binary())])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                yield pa.concat_batches(held)
                held, rows = [], 0
        if rows:
            yield pa.concat_batches(held)

    def numbers(values: np.ndarray) -> bytes:
        return values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()

    def strings(values: pa.Array) -> tuple[np.ndarray, bytes]:
        """Lengths, -1 for null, and the bytes."""
        lengths = pc.fill_null(pc.binary_length(values), -1).to_numpy(zero_copy_only=False)
        _, ends, data = pc.fill_null(values, "").buffers()
        return lengths, data.to_pybytes()[: int(np.frombuffer(ends, np.int32)[len(values)])] if data else b""

    def ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Distinct values in order, null first, and the place of each value among them."""
        coded = values.cast(pa.string()).dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        return coded.dictionary.take(pa.array(order)), ranks[coded.indices.to_numpy()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in together(cut(batches)):
            terms, term = ranked(batch.column(0))
            home = np.array([zlib.crc32(w.encode()) % buckets if w else documents for w in terms.to_pylist()], np.int64)
            by_home = np.argsort(home, kind="stable")
            place = np.empty(len(by_home), np.int64)
            place[by_home] = np.arange(len(by_home))
            paths, path = ranked(batch.column(1))
            dl = batch.column(4).to_numpy().astype(np.int64)
            path_of, dl_of, doc = np.arange(len(paths)), np.zeros(len(paths), np.int64), path
            dl_of[path] = dl
            if (dl_of[path] != dl).any():  # a path that comes with several lengths
                docs, doc = np.unique(path * (int(dl.max()) + 1) + dl, return_inverse=True)
                path_of, dl_of = docs // (int(dl.max()) + 1), docs % (int(dl.max()) + 1)
            slot = np.zeros(len(path_of), np.int64)
            key = place[term] * len(path_of) + doc
            order = np.argsort(key, kind="stable")
            term, doc = place[term][order], doc[order]
            tf = batch.column(2).to_numpy()[order]
            lists = batch.column(3).take(pa.array(order))
            held = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            positions = lists.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            homes = home[by_home][term[first]]
            cuts = np.flatnonzero(np.concatenate([[True], homes[1:] != homes[:-1], [True]]))
            first = np.append(first, len(term))
            rows = []
            for r, s in zip(cuts, cuts[1:]):
                a, b = int(first[r]), int(first[s])
                slot[doc[a:b]] = -1
                mine = np.flatnonzero(slot == -1) if b - a > len(slot) >> 4 else np.unique(doc[a:b])
                slot[mine] = np.arange(len(mine))
                of = slot[doc[a:b]]
                sizes, words = strings(terms.take(pa.array(by_home[term[first[r:s]]])))
                lengths, names = strings(paths.take(pa.array(path_of[mine])))
                raw = b"".join([
                    np.array([s - r, b - a, len(mine), ends[b] - ends[a]], "<i4").tobytes(),
                    numbers(sizes), numbers(np.diff(first[r : s + 1])), numbers(lengths), numbers(dl_of[mine]),
                    numbers(of), numbers(tf[a:b]), numbers(held[a:b]), numbers(positions[ends[a] : ends[b]]), words, names,
                ])
                rows.append((int(homes[r]), len(raw), codec.compress(raw, asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _unpacker(size: int = ROWS_AT_ONCE):
    """Packed rows to entries; self-contained."""
    schema = pa.schema([
        ("term", pa.string()), ("path", pa.string()), ("tf", pa.int32()),
        ("positions", pa.list_(pa.int32())), ("dl", pa.int32()), ("bucket", pa.int32()),
    ])

    def offsets(lengths: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))]).astype(np.int32)

    def strings(lengths: np.ndarray, data: bytes) -> pa.Array:
        values = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets(lengths)), pa.py_buffer(data))
        return pc.if_else(pa.array(lengths >= 0), values, None) if (lengths < 0).any() else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for bucket, n_bytes, packed in zip(*(column.to_pylist() for column in batch.columns)):
                raw, at = codec.decompress(packed, n_bytes, asbytes=True), 16

                def numbers(n: int) -> np.ndarray:
                    nonlocal at
                    at += 4 * n
                    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at - 4 * n).reshape(4, n).T).view("<i4").reshape(n)

                n_terms, n_rows, n_docs, n_positions = np.frombuffer(raw, "<i4", 4).tolist()
                sizes, runs, lengths, dl, of, tf, held, positions = map(
                    numbers, (n_terms, n_terms, n_docs, n_docs, n_rows, n_rows, n_rows, n_positions)
                )
                names = at + int(sizes.sum())
                term = np.repeat(np.arange(n_terms), runs)
                entries = pa.RecordBatch.from_arrays([
                    strings(sizes, raw[at:names]).take(pa.array(term)), strings(lengths, raw[names:]).take(pa.array(of)),
                    pa.array(tf), pa.ListArray.from_arrays(pa.array(offsets(held)), pa.array(positions)),
                    pa.array(dl[of]), pa.array(np.full(n_rows, bucket, np.int32)),
                ], schema=schema)
                for begin in range(0, n_rows, size):
                    yield entries.slice(begin, size)

    return run


def build_postings(corpus: DataFrame) -> DataFrame:
    """``(term, path, tf, positions, dl)``, one row per term and document."""
    return build_entries(corpus).filter(~is_document())


def doc_lengths(corpus: DataFrame) -> DataFrame:
    """``(path, dl)``; a document without tokens has length 0."""
    return corpus.select("path", F.size(tokens(F.col("content"))).alias("dl"))


def term_stats(postings: DataFrame) -> DataFrame:
    """``(term, df)``; the count is combined before the shuffle."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
