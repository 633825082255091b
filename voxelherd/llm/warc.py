"""WARC archives as seekable Zstandard bundles.

A bundle is a row of bytes in a table, so that Spark reads and writes it wherever the
table lies; it is also a valid ``.warc.zst`` file: records are grouped into independent
frames, and a skippable frame at the end holds the seek table (compressed and plain size
of every frame, in the public seekable format). A second table maps each record to its
bundle, frame and place within the unpacked frame, which is all it takes to read one
record.

Of records with equal payloads, the one with the smallest page id is a response, the
others are revisits that name it and have no body.

Defined results: a null payload is empty; a null page id is kept, sorts after all others
and its record has the id ``null``; rows that repeat the smallest page id of their payload
are all responses; a null URL is empty, line breaks in one become blanks; an empty table
gives no bundles; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.llm.common import text_bytes
from voxelherd.session import materialize

# Plain bytes in a frame, packed bytes in a bundle.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 8 << 20
# Fixed values of the seekable format: magic numbers of the skippable frame and its footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
# A fixed date: archives of the same pages are the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLE_SCHEMA = "bundle string, content binary"


@dataclass
class Entry:
    """Place of a record: frame number and byte range in the unpacked frame."""

    page_id: int | None
    frame: int
    start: int
    size: int


def digest_of(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit without."""
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


class BundleWriter:
    """Packs records into frames and frames into one bundle."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames: list[bytes] = []
        self.plain: list[int] = []
        self.open: list[bytes] = []
        self.open_size = 0
        self.size = 0
        self.entries: list[Entry] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        self.entries.append(Entry(page_id, len(self.frames), self.open_size, len(record)))
        self.open.append(record)
        self.open_size += len(record)
        if self.open_size >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            self.frames.append(self.packer.compress(b"".join(self.open)))
            self.plain.append(self.open_size)
            self.size += len(self.frames[-1])
            self.open, self.open_size = [], 0

    def close(self) -> bytes:
        """All frames and the seek table."""
        self._close_frame()
        rows = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.plain, strict=True))
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        table = struct.pack("<II", SKIPPABLE_MAGIC, len(rows) + len(footer)) + rows + footer
        return b"".join(self.frames) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """Offset, packed size and plain size of every frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    at, offset, out = len(content) - 9 - n * width, 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", content, at + i * width)
        out.append((offset, packed, plain))
        offset += packed
    return out


def unpack_frame(content: bytes, offset: int, packed: int, plain: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(content[offset : offset + packed], max_output_size=plain)


def read_record(content: bytes, frame: int, start: int, size: int) -> bytes:
    """One record, unpacking nothing but its frame."""
    return unpack_frame(content, *seek_table(content)[frame])[start : start + size]



def parse_records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of a frame."""
    at = 0
    while at < len(plain):
        head_end = plain.index(b"\r\n\r\n", at) + 4
        lines = plain[at : head_end - 4].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        stop = head_end + int(headers["Content-Length"])
        yield headers, plain[head_end:stop]
        at = stop + 4


def _page_of(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``revisit``, ``refers_to`` for rows of ``page_id``, ``url``, ``html``.

    The smallest page id per digest is a partial aggregation; it is joined back as a
    table, so that Spark may split a digest that many pages share.
    """
    raw = pages.select("page_id", "url", text_bytes("html").alias("payload"))
    known = raw.withColumn("digest", F.sha1("payload"))
    first = materialize(
        known.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    )
    joined = known.join(first, "digest", "left")
    revisit = F.coalesce((F.length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return joined.select(
        "page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def write_archives(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write bundles to the shared folder; returns the bundles and the map of records.

    The map is one row per record: page id, bundle, frame, place and size in the frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer = TaskContext.get().partitionId(), 0, BundleWriter()

        def rows(name: str, done: BundleWriter) -> pa.RecordBatch:
            entries = [{"page_id": e.page_id, "frame": e.frame, "start": e.start, "size": e.size} for e in done.entries]
            kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("start", pa.int64()), ("size", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([done.close()], pa.binary()), pa.array([entries], kind)],
                names=["bundle", "content", "entries"],
            )

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                page_id, url, payload, revisit, refers_to = row
                writer.add(page_id, make_record(page_id, url, payload, refers_to, revisit))
                if writer.size >= BUNDLE_BYTES:
                    yield rows(f"{part:06d}-{number:06d}", writer)
                    number, writer = number + 1, BundleWriter()
        if writer.entries:
            yield rows(f"{part:06d}-{number:06d}", writer)

    entry = "array<struct<page_id: bigint, frame: int, start: bigint, size: bigint>>"
    marked = mark_revisits(pages, least_bytes)
    written = materialize(marked.mapInArrow(run, f"{BUNDLE_SCHEMA}, entries {entry}"))
    entries = written.select("bundle", F.explode("entries").alias("e"))
    return written.select("bundle", "content"), entries.select("e.page_id", "bundle", "e.frame", "e.start", "e.size")


def read_archives(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, frame by frame by their seek tables.

    ``payload`` is the body of responses and null for revisits.
    """
    schema = (
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "url string, payload binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                for frame in seek_table(raw):
                    found = []
                    for headers, body in parse_records(unpack_frame(raw, *frame)):
                        own = headers["WARC-Type"] == "response"
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if own and digest != digest_of(body):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not fit its digest")
                        found.append((
                            _page_of(headers["WARC-Record-ID"]), int(headers["WARC-Payload-Length"]), digest,
                            headers["WARC-Type"], None if own else _page_of(headers["WARC-Refers-To"]),
                            headers["WARC-Target-URI"], body if own else None,
                        ))
                    columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                    )

    return bundles.select("content").mapInArrow(run, schema)


def fetch_records(bundles: DataFrame, places: DataFrame) -> DataFrame:
    """Headers and bodies of chosen records: rows of the record map, joined by bundle."""
    schema = "page_id bigint, record binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, want in zip(batch.column("content").to_pylist(), batch.column("wants").to_pylist(), strict=True):
                records = [read_record(content, w["frame"], w["start"], w["size"]) for w in want]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["page_id"] for w in want], pa.int64()), pa.array(records, pa.binary())],
                    names=["page_id", "record"],
                )

    wanted = places.groupBy("bundle").agg(F.collect_list(F.struct("page_id", "frame", "start", "size")).alias("wants"))
    joined = bundles.join(wanted, "bundle").select("content", "wants")
    return joined.mapInArrow(run, schema)
