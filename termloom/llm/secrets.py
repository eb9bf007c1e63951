"""Secrets in texts: fixed patterns, and high-entropy windows.

The fixed kinds are ``assign``, ``access`` and ``hex``. The fourth, ``entropy``,
slides a window over every candidate string (a run of token characters), keeps
the counts of its characters and their sum of ``n log n`` up to date by one
removal and one addition per step, and reports the union of the windows whose
Shannon entropy reaches the threshold of their character class. The class is that of
each stretch: a key of hex digits is judged as one, whatever name or path it is glued
to. Windows of dictionary-like text have no digits or no change of class and never
qualify. Allow-listed parts are cut out of a candidate, the rest is still searched:
UUIDs, words with a placeholder or a counting or repeating run, and whole segments of
letters and digits in the path of a URL (digests), unless the URL names a credential
before (hook, token, key and the like). Query values, fragments and user:token@host
are never allow-listed. Suppression never removes a fixed kind.

Defined results: a null text is empty and has no span. Offsets are code points,
ends are exclusive. Spans of one kind do not overlap; spans of different kinds
may, and stand in order of start, then kind. An empty table gives an empty
result. Other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ready_workers, text_of

KINDS = ("assign", "access", "hex", "entropy")
RANK = {kind: i for i, kind in enumerate(KINDS)}
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_CANDIDATE = 6, 20, 24, 20
WINDOW = 20
# Bits per character that a window of each class must reach.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
SPANS = "array<struct<kind:string,start:int,end:int>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]|xxxx|1234567890|abcdefgh|0{8}", re.IGNORECASE)
WORD = re.compile(r"[A-Za-z0-9_-]+")
# Stretches of one class; the lower the class, the lower its threshold.
STRETCHES = [re.compile(p % WINDOW) for p in (r"[A-Za-z0-9]{%d,}", r"[0-9a-f]{%d,}", r"[0-9A-F]{%d,}")]
URL = re.compile(r"https?://([^\s\"'<>/?#]*)([^\s\"'<>?#]*)")
SEGMENT = re.compile(r"(?<=/)[A-Za-z0-9]{%d,}(?=/|$)" % WINDOW)
CREDENTIAL = re.compile(r"hook|token|secret|passw|api_?key|[/.]keys?[/.]|[/.]o?auth|signed|/bot", re.IGNORECASE)
N_LOG_N = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def char_class(text: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    return "alnum" if text.isalnum() else "base64"


def mixed(digits: int, others: int) -> bool:
    """Whether a window holds digits among other characters, as words do not."""
    return digits >= 2 and others >= 2


def hot_windows(text: str, window: int = WINDOW, thresholds: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """Unions of the windows of ``text`` that reach the entropy of their class."""
    if len(text) < window:
        return []
    limit = (thresholds or THRESHOLDS)[char_class(text)]
    log_window = math.log2(window)
    counts: dict[str, int] = {}
    digits = 0
    total, found = 0.0, []
    table = N_LOG_N if window <= WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    for i, char in enumerate(text):
        n = counts.get(char, 0)
        total += table[n + 1] - table[n]
        counts[char] = n + 1
        digits += char.isdigit()
        if i >= window:
            old = text[i - window]
            n = counts[old]
            total += table[n - 1] - table[n]
            counts[old] = n - 1
            digits -= old.isdigit()
        if i >= window - 1 and log_window - total / window >= limit and mixed(digits, window - digits):
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of spans that overlap or touch."""
    found: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


def hot_stretches(text: str) -> list[tuple[int, int]]:
    """Hot windows of the whole text and of its stretches of one class."""
    spans = hot_windows(text)
    for pattern in STRETCHES:
        for m in pattern.finditer(text):
            if m.end() - m.start() < len(text):
                spans += [(m.start() + a, m.start() + b) for a, b in hot_windows(m[0])]
    return joined(spans)


def digests(text: str) -> list[tuple[int, int]]:
    """Whole segments of URL paths that are harmless."""
    spans = []
    for url in URL.finditer(text):
        named = CREDENTIAL.search(url[0])
        limit = url.start() + named.start() if named else url.end()
        spans += [(url.start(2) + x.start(), url.start(2) + x.end()) for x in SEGMENT.finditer(url[2]) if url.start(2) + x.end() <= limit]
    return spans


def unknown_parts(run: str, base: int, harmless: list[tuple[int, int]]) -> Iterator[tuple[int, str]]:
    """What is left of a candidate at ``base`` between its harmless parts."""
    cut = [m.span() for m in WORD.finditer(run) if UUID.fullmatch(m[0]) or PLACEHOLDER.search(m[0])]
    first = bisect_left(harmless, (base, 0))
    for start, end in harmless[first:]:
        if start >= base + len(run):
            break
        cut.append((start - base, end - base))
    done = 0
    for start, end in [*joined(cut), (len(run), len(run))]:
        if start > done:
            yield base + done, run[done:start]
        done = end


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of ``text``, by start, then kind."""
    spans = []
    if ":" in text or "=" in text:
        lowered = text.lower()
        if any(word in lowered for word in KEYWORDS):
            for m in ASSIGN.finditer(text):
                if len(m[2]) >= MIN_VALUE:
                    spans.append(("assign", m.start(), m.end()))
    harmless: list[tuple[int, int]] | None = None
    # Runs of 20 characters of either fixed alphabet lie within one candidate.
    for m in CANDIDATE.finditer(text):
        run, base = m[0], m.start()
        for kind, pattern, least in (("access", ACCESS, MIN_ACCESS), ("hex", HEX, MIN_HEX)):
            spans += [(kind, base + x.start(), base + x.end()) for x in pattern.finditer(run) if x.end() - x.start() >= least]
        if any(map(str.isdigit, run)) and hot_stretches(run):
            if harmless is None:
                harmless = digests(text)
            for at, part in unknown_parts(run, base, harmless):
                spans += [("entropy", at + a, at + b) for a, b in hot_stretches(part)]
    spans.sort(key=lambda s: (s[1], RANK[s[0]]))
    return spans


def redacted(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    parts, done = [], 0
    for _, start, end in spans:
        if start >= done:
            parts += [text[done:start], mask]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``spans`` of every row."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(text)]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, SPANS_ARROW)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a text replaced by ``mask``; null texts stay null."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = [
                None if text is None else redacted(text, spans, mask) if (spans := find_spans(text)) else text
                for text in batch.column(place).to_pylist()
            ]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
