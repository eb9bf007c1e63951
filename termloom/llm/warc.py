"""WARC archives read through their index.

``write_archives`` writes one gzip member per record and returns the index: per
record the archive, offset, length, URL and payload digest. An archive counts
only through its index, so the file of a task that failed or ran twice is never
read. ``read_records`` takes any selection of index rows, sorts them by archive
and offset, joins neighbouring byte ranges into one read each, and parses the
records it finds there. Equal payloads are stored once: the record of the
smallest ``page_id`` is the response, the others revisit it.

Defined results: a null ``html`` is an empty payload, a null ``url`` an empty
target. A page without an id is a response of its own and nobody's target. Rows
that repeat the id and payload of a response are responses as well. Payloads
under ``MIN_REVISIT`` bytes are always stored. An empty table gives an empty
index. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import common
from termloom.llm.common import fits, ready_workers, scratch, stored, text_of

MIN_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
RANGE_BYTES = 4 << 20
TASK_BYTES = 16 << 20
MOST_TASKS = 20_000
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, url string, digest string, page_id long"
INDEX_ARROW = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
    ("digest", pa.string()), ("page_id", pa.int64()),
])
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)
RECORDS_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
ID = "urn:x-page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def deduplicated(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html, digest, keeper``: the page that stores this payload, null for its own."""
    html = text_of("html")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), text_of("url").alias("url"), html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"), (F.octet_length(html) >= min_bytes).alias("shared"),
    )
    groups = rows.filter("shared").groupBy("digest").agg(
        F.min("page_id").alias("keeper"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")
    )
    # The count also takes groups in which some page has no id.
    groups = stored(groups.filter("n > 1 and keeper is not null").select("digest", "keeper", "n"), "same-payload")
    joined = with_keepers(rows, groups)
    return joined.select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("keeper"), F.col("keeper")).alias("keeper")
    )


def with_keepers(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the ``keeper`` of their payload, null without one.

    Too many groups for a broadcast are split: the most frequent payloads still go
    to the pages, so that only rare ones are shuffled with their html.
    """
    if fits(groups, 112):
        return rows.join(F.broadcast(groups.drop("n")), "digest", "left")
    frequent = stored(groups.orderBy(F.desc("n"), "digest").limit(common.BROADCAST_BYTES // 112).drop("n"), "frequent-payloads")
    rare = groups.drop("n").join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    looked = rows.join(F.broadcast(frequent), "digest", "left")
    rest = looked.filter("keeper is null").drop("keeper").join(rare, "digest", "left")
    return looked.filter("keeper is not null").unionByName(rest)


def reading_tasks(total: int, task_bytes: int) -> int:
    """Tasks that read ``total`` bytes; beyond ``MOST_TASKS`` each reads several shares."""
    return min(max(1, -(-total // task_bytes)), MOST_TASKS)


def record(page_id: int | None, url: str, payload: bytes, digest: str, keeper: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if keeper is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if keeper is not None:
        lines += [f"WARC-Refers-To: <{ID}{keeper}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                entries = []
                for row in batch.to_pylist():
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip.compress(
                        record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["keeper"]),
                        LEVEL, mtime=0,
                    )
                    out.write(member)
                    entries.append((name, offset, len(member), row["url"], row["digest"], row["page_id"]))
                    offset += len(member)
                columns = zip(*entries, strict=True) if entries else [[]] * len(INDEX_ARROW)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, INDEX_ARROW, strict=True)], schema=INDEX_ARROW
                )
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` below ``folder``; the index, a stored table."""
    ready_workers(pages.sparkSession)
    return stored(deduplicated(pages).mapInArrow(_writer(folder, archive_bytes), INDEX), "warc-index")


def parse(member: bytes) -> dict:
    """One record; the payload of a response is hashed and measured, and must be what its headers say."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [line[15:] for line in http.split(b"\r\n") if line.startswith(b"Content-Length:")]
    revisit = fields["WARC-Type"] == "revisit"

    size, digest = int(sizes[0]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit:
        read = len(payload), hashlib.sha256(payload).hexdigest()
        if read != (size, digest):
            raise ValueError(f"{fields['WARC-Record-ID']}: payload {read} is not {(size, digest)} of its headers")
        size, digest = read

    def page(value: str | None) -> int | None:
        number = value[len(ID) + 1:-1] if value else ""
        return int(number) if number else None

    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI", ""),
        "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")),
        "payload_bytes": size, "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def ranges(entries: list[tuple[str, int, int]], gap: int, longest: int) -> Iterator[list[tuple[str, int, int]]]:
    """Neighbouring entries of one archive, as long as one read may cover them."""
    group: list[tuple[str, int, int]] = []
    for entry in entries:
        name, offset, length = entry
        if group and (
            name != group[-1][0] or offset - group[-1][1] - group[-1][2] > gap or offset + length - group[0][1] > longest
        ):
            yield group
            group = []
        group.append(entry)
    if group:
        yield group


def _reader(folder: str, gap: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            entries = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            for group in ranges(entries, gap, longest):
                if group[0][0] != name:
                    if source is not None:
                        source.close()
                    name = group[0][0]
                    source = store.open_input_file(f"{base}/{name}")
                begin = group[0][1]
                data = source.read_at(group[-1][1] + group[-1][2] - begin, begin)
                found = [parse(data[o - begin:o - begin + n]) for _, o, n in group]
                yield pa.RecordBatch.from_pylist(found, schema=RECORDS_ARROW)
        if source is not None:
            source.close()

    return run


def read_records(
    index: DataFrame, folder: str, gap: int = GAP_BYTES, longest: int = RANGE_BYTES, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """The records of the selected ``index`` rows, read in order of their place."""
    ready_workers(index.sparkSession)
    total = index.agg(F.sum("length")).first()[0] or 0
    # By bytes to read, not by bytes of the index rows.
    tasks = reading_tasks(total, task_bytes)
    places = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset")
    return places.sortWithinPartitions("archive", "offset").mapInArrow(_reader(folder, gap, longest), RECORDS)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives in the cluster's shared folder, as a URI."""
    folder = scratch(pages.sparkSession, "warc")
    return folder if "://" in folder else f"file://{folder}"
