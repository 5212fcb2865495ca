"""WARC archives in seekable Zstandard bundles.

Each page becomes a WARC record; records of equal payload revisit the one with the smallest page_id. Records are grouped
into independent Zstandard frames, and a bundle ends with the seekable format's skippable frame: a table of every frame's
compressed and decompressed size. The index maps a record to its bundle, frame and place in the decompressed frame, so a
record is read by decompressing one frame.

Bundles are written by tasks into the shared folder, whole or not at all and under names that a repeated task takes again;
Spark's binary file source reads them back.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, new_path
from .wavelet import _put

#: Bounds of what a task holds: a frame closes at FRAME and a bundle at BUNDLE bytes of records.
FRAME, BUNDLE = 1 << 18, 1 << 23
#: Numbers of the seekable format, fixed values: the skippable frame's magic and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of the format: the profile of a revisit by equal payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, response: bool, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has no payload block: it names the record that has it, and the payload's size."""
    block = payload if response else b""
    name = lambda i: f"<urn:kinetiq:page:{'' if i is None else i}>"
    clean = (url or "").replace("\r", " ").replace("\n", " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        *([] if response else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _END + block + _END


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record that ``raw`` starts with."""
    head, _, rest = raw.partition(_END)
    fields = _fields(head)
    size = int(fields["Content-Length"])
    if rest[size : size + 4] != _END:
        raise ValueError("a WARC record is cut short")
    return fields, rest[:size]


def page_of(name: str) -> int | None:
    number = name.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


class Bundle:
    """Builds one bundle: ``add`` gives a record's frame and place in it."""

    def __init__(self, frame_bytes: int = FRAME):
        self.pack, self.limit = zstandard.ZstdCompressor(level=3).compress, frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = self.total = 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        place = (len(self.frames), self.held, len(raw))
        self.open.append(raw)
        self.held += len(raw)
        self.total += len(raw)
        if self.held >= self.limit:
            self._close()
        return place

    def _close(self):
        if self.open:
            frame = self.pack(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.open, self.held = [], 0

    def content(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table)), table])


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    sizes = list(struct.iter_unpack("<II", content[-9 - 8 * count : -9]))
    starts = np.cumsum([0, *(s[0] for s in sizes)]).tolist()
    return [(at, *s) for at, s in zip(starts, sizes)]


def frame(content: bytes, table: list, k: int) -> bytes:
    at, packed, size = table[k]
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=size)


INDEX = "page_id long, bundle string, frame int, at long, size long"
_INDEX = pa.schema(
    [("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("size", pa.int64())]
)


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def write(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, number, bundle, rows = TaskContext.get().partitionId(), 0, Bundle(frame_bytes), []

        def close():
            nonlocal number, bundle, rows
            name = f"bundle-{part:06d}-{number:06d}.warc.zst"
            _put(fs, f"{base}/{name}", bundle.content())
            cols = zip(*((page, name, *place) for page, place in rows))
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _INDEX)], schema=_INDEX)
            number, bundle, rows = number + 1, Bundle(frame_bytes), []
            return out

        for batch in batches:
            pages, urls, first = (batch.column(n).to_pylist() for n in ("page_id", "url", "first_id"))
            for page, url, refers, html in zip(pages, urls, first, batch.column("html")):
                response = page is None or refers is None or page == refers
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                rows.append((page, bundle.add(record(page, url, payload, response, refers))))
                if bundle.total >= bundle_bytes:
                    yield close()
        if rows:
            yield close()

    return write


def write_bundles(pages: DataFrame, least: int = 0, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE):
    """Write all pages as bundles; returns the folder and the index (page_id, bundle, frame, at, size)."""
    have = set(pages.columns)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        (F.col("url").cast("string") if "url" in have else F.lit(None).cast("string")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    named = rows.withColumn("sha", F.sha1("html")).withColumn("n", F.octet_length("html"))
    same = named.filter(F.col("n") >= least).select("page_id", "sha", "n")
    first = same.groupBy("sha", "n").agg(F.min("page_id").alias("first_id"), F.count("*").alias("_c")).filter("_c > 1")
    # a page and payload pair is looked up once, then joined with the page's content
    later = same.distinct().join(first.select("sha", "n", "first_id"), ["sha", "n"]).select(
        F.col("page_id").alias("_p"), F.col("sha").alias("_s"), "first_id"
    )
    # merged, not broadcast, at every size: the looked-up side grows with the pages
    known = named.join(later.hint("merge"), F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("sha") == F.col("_s")), "left")
    ordered = known.select("page_id", "url", "html", "first_id").sortWithinPartitions("page_id")
    folder = new_path(pages.sparkSession, "warc")
    return folder, cut(ordered.mapInArrow(_writer(folder, frame_bytes, bundle_bytes), INDEX), "warc-index")


_ROWS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("intact", pa.bool_())]
)
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PLACED = FOUND + ", bundle string, frame int, at long, size long, intact boolean"


def records(content: bytes):
    """(frame, place, size, headers, block) of every record of a bundle, a frame in memory at a time."""
    table = seek_table(content)
    for k in range(len(table)):
        raw, at = frame(content, table, k), 0
        while at < len(raw):
            head = raw.index(_END, at) + 4
            fields = _fields(raw[at : head - 4])
            end = head + int(fields["Content-Length"])
            if raw[end : end + 4] != _END:
                raise ValueError("a WARC record is cut short")
            yield k, at, end + 4 - at, fields, raw[head:end]
            at = end + 4


def _reader(batches):
    for batch in batches:
        out = []
        for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content")):
            for k, at, size, fields, block in records(content.as_py()):
                kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                n = len(block) if kind == "response" else int(fields["X-Payload-Length"])
                intact = kind == "revisit" or digest(block) == sha
                out.append((page_of(fields["WARC-Record-ID"]), n, sha, kind, refers, name, k, at, size, intact))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)


def read_bundles(spark, folder: str, index: DataFrame) -> DataFrame:
    """What the archives say of each record. A record that isn't where the index has it, or is damaged, is an error."""
    if index.isEmpty():
        return spark.createDataFrame([], FOUND)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")
    rows = named.mapInArrow(_reader, PLACED)
    place = index.select(*(F.col(c).alias(f"i_{c}") for c in index.columns))
    at = [F.col(c) == F.col(f"i_{c}") for c in ("bundle", "frame", "at")]
    met = rows.join(place, at, "full")
    right = F.col("intact") & (F.col("size") == F.col("i_size")) & F.col("page_id").eqNullSafe(F.col("i_page_id"))
    error = F.raise_error(F.lit("a record is damaged or not where the index has it")).cast("string")
    checked = met.withColumn("payload_digest", F.when(F.coalesce(right, F.lit(False)), F.col("payload_digest")).otherwise(error))
    return checked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_page(content: bytes, frame_number: int, at: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: only its frame is decompressed."""
    return parse(frame(content, seek_table(content), frame_number)[at : at + size])


def round_trip(pages: DataFrame, least: int = 0, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE) -> DataFrame:
    """Write bundles of ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Of records with equal payloads of at least ``least`` bytes those with the smallest
    page_id are responses (all of its rows, if it is repeated) and the others revisit it; smaller payloads, and records
    without a page_id, are responses. Other columns are ignored; an empty table gives no rows.
    """
    return read_bundles(pages.sparkSession, *write_bundles(pages, least, frame_bytes, bundle_bytes))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS sha,
                  min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
     x AS (SELECT *, [('0x' || substr(sha, 5 * i + 1, 5))::BIGINT FOR i IN range(8)] AS part FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INTEGER + 1, 1)
                                FOR s IN [15, 10, 5, 0]] FOR v IN part]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM x
"""
