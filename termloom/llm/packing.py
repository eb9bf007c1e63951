"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document is its token ids and one end id. What fills whole windows is cut off
and stands alone, without padding; the rest, under one window, is cut into parts
of at most ``part`` ids. The parts of every ``group`` documents of a task are
dealt to windows: partial partitions, one per part at first, are merged by pairs
of the largest spread, the fullest set of one meeting the emptiest of the other,
until one partition with nearly equal windows is left. The window count starts
at the least possible and rises while any window exceeds the capacity. There is
no shuffle: a task packs what it reads, in bounded memory, and a task that runs
again gives the same windows for the same rows.

Defined results: a null or empty text is its end id alone. Rows that repeat an id
are packed one by one. A null ``doc_id`` is packed and stays null. The literal of an
added token (``SPECIALS``) is its id, wherever it stands. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ready_workers, text_of

CAPACITY = 1024
GROUP = 256
PART = 256
END = 0
# Added tokens of the vocabulary, as its JSON form lists them: no neighbouring blanks, no word borders.
SPECIALS = {"<|endoftext|>": 50256}
# The engine's stack ends at about a million blanks in a row; shorter texts need no look.
BLANKS = 1 << 16
# White space as the pattern's \s has it; Python's own also takes U+001C to U+001F.
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Only the first blank of a run is tried, or many shorter runs would cost their squares.
BLANK_RUN = re.compile("(?<!%s)%s{%d,}" % (BLANK, BLANK, BLANKS))
# Windows of one task are numbered below this; the task's number stands above.
TASK_BITS = 40
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)
PIECES_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


@lru_cache(maxsize=2)
def tokenizer(ranks_file: str, pattern: str) -> tiktoken.Encoding:
    """One tokenizer per Python worker; the same ids as the JSON form of the vocabulary."""
    with open(ranks_file, "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ordinary(text: str, codec: tiktoken.Encoding) -> list[int]:
    """Ids of a text without added tokens. Of a run of blanks all but the last one are a piece
    of the pattern, at the end of the text all of them: long runs are cut out as that."""
    if len(text) < BLANKS:
        return codec.encode_ordinary(text)
    ids, done = [], 0
    for run in BLANK_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += codec.encode_ordinary(text[done:run.start()])
        ids += codec._encode_single_piece(text[run.start():end])
        done = end
    return ids + codec.encode_ordinary(text[done:])


def encode(text: str, codec: tiktoken.Encoding) -> list[int]:
    """Ids of the whole text; the texts around an added token are encoded apart."""
    for literal, number in SPECIALS.items():
        if literal in text:
            first, *others = text.split(literal)
            ids = encode(first, codec)
            for other in others:
                ids.append(number)
                ids += encode(other, codec)
            return ids
    return ordinary(text, codec)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Item numbers per window: Karmarkar-Karp for ``windows`` sets."""
    ticket = count()
    heap = []
    for i, size in enumerate(sizes):
        # Sets as (load, items), fullest first; sets not listed are empty.
        heap.append((-size, next(ticket), [(size, [i])]))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        clash = len(a) + len(b) - windows
        if clash <= 0:
            merged = a + b
        else:
            # The last sets of each are the ones that meet: emptiest with fullest.
            low_a, low_b = len(a) - clash, len(b) - clash
            merged = a[:low_a] + b[:low_b] + [
                (x[0] + y[0], x[1] + y[1]) for x, y in zip(a[low_a:], reversed(b[low_b:]), strict=True)
            ]
        merged.sort(key=lambda s: -s[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, next(ticket), merged))
    return [items for _, items in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Item numbers per window, no window over ``capacity``, loads nearly equal."""
    windows = -(-sum(sizes) // capacity)
    while True:
        packed = differencing(sizes, windows)
        if all(sum(sizes[i] for i in items) <= capacity for items in packed):
            return packed
        windows += 1


def parts(tokens: int, capacity: int, part: int) -> tuple[int, list[tuple[int, int]]]:
    """Number of whole windows, and ``(start, length)`` of the parts after them."""
    whole, rest = divmod(tokens, capacity)
    begin = whole * capacity
    return whole, [(begin + i, min(part, rest - i)) for i in range(0, rest, part)]


class TaskPacker:
    """Packs the documents of one task as they come; a piece is a row of ``PIECES``."""

    def __init__(self, task: int, capacity: int, group: int, part: int):
        self.numbers = count(task << TASK_BITS)
        self.capacity, self.group, self.part = capacity, group, part
        self.waiting: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int | None, np.ndarray]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        whole, rest = parts(len(ids), self.capacity, self.part)
        self.documents.append((doc_id, ids))
        place = len(self.documents) - 1
        ready = [self.piece(place, i * self.capacity, self.capacity, next(self.numbers), 0) for i in range(whole)]
        self.waiting += [(place, start, length) for start, length in rest]
        return ready + self.flush() if len(self.documents) >= self.group else ready

    def piece(self, place: int, start: int, length: int, number: int, offset: int) -> tuple:
        doc_id, ids = self.documents[place]
        return doc_id, start, length, ids[start:start + length].tobytes(), len(ids), number, offset

    def flush(self) -> list[tuple]:
        out = []
        for items in pack([length for *_, length in self.waiting], self.capacity) if self.waiting else []:
            number, offset = next(self.numbers), 0
            joined: list[tuple[int, int, int]] = []
            for place, start, length in (self.waiting[i] for i in sorted(items)):
                # Parts of one document that follow each other are one piece again.
                if joined and joined[-1][0] == place and joined[-1][1] + joined[-1][2] == start:
                    start, length = joined[-1][1], joined.pop()[2] + length
                joined.append((place, start, length))
            for place, start, length in joined:
                out.append(self.piece(place, start, length, number, offset))
                offset += length
        self.waiting, self.documents = [], []
        return out


def pack_documents(
    docs: DataFrame, ranks_file: str, pattern: str, capacity: int = CAPACITY, group: int = GROUP, part: int = PART
) -> DataFrame:
    """One row per piece; ``ids`` are little-endian unsigned 32-bit numbers."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizer(ranks_file, pattern)
        packer = TaskPacker(TaskContext.get().partitionId(), capacity, group, part)

        def arrow(pieces: list[tuple]) -> pa.RecordBatch:
            columns = zip(*pieces, strict=True) if pieces else [[]] * len(PIECES_ARROW)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, PIECES_ARROW, strict=True)], schema=PIECES_ARROW
            )

        for batch in batches:
            pieces: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                pieces += packer.add(doc_id, np.array([*encode(text, codec), END], dtype="<u4"))
            yield arrow(pieces)
        yield arrow(packer.flush())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, PIECES)
