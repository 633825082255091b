import base64
import hashlib

import zstandard

from voxelherd.llm import warc
from voxelherd.llm.warc import fetch_records, parse_records, read_archives, seek_table, write_archives


def rows():
    out = [(None, "http://a/\r\nX: y", "lost", 1), (5, None, None, 1), (3, "u", "", 1), (9, "u", "same", 1), (4, "u", "same", 1),
           (4, "u", "same", 1), (11, "u", "\r\n\r\nWARC/1.1\r\n", 1), (12, "u", "é" * 300_000, 1)]
    return out + [(i, "hot", "copy", 1) for i in range(100, 400)] + [(i, "own", f"page {i}", 1) for i in range(400, 500)]


def expected(data, least=0):
    first = {}
    for page, _, html, _ in data:
        if page is not None:
            raw = (html or "").encode()
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html, _ in data:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        revisit = len(raw) >= least and page != first.get(raw)
        out.append((page, len(raw), digest, "revisit" if revisit else "response", first[raw] if revisit else None))
    return sorted(out, key=str)


def frame(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, bundle long").repartition(3)


def read(bundles):
    got = read_archives(bundles).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)


def test_round_trip(spark):
    bundles, _ = write_archives(frame(spark, rows()))
    assert read(bundles) == expected(rows())
    bundles, _ = write_archives(frame(spark, rows()), least_bytes=5)
    assert read(bundles) == expected(rows(), 5)


def test_many_frames_and_bundles(spark, monkeypatch):
    data = [(i, "u", f"{i} " * 4000, 1) for i in range(200)]
    bundles, places = write_archives(frame(spark, data))
    assert read(bundles) == expected(data)
    for row in bundles.collect():
        content = bytes(row.content)
        assert len(seek_table(content)) >= 2
        # A plain decompressor reads the frames one after the other and skips the table.
        reader = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
        assert sum(1 for _ in parse_records(reader.read())) == places.where(places.bundle == row.bundle).count()
    some = places.where("page_id % 50 = 7")
    got = {r.page_id: bytes(r.record) for r in fetch_records(bundles, some).collect()}
    assert sorted(got) == [7, 57, 107, 157]
    for page, record in got.items():
        (headers, body), = parse_records(record)
        assert headers["WARC-Record-ID"] == warc.record_id(page) and body.decode() == f"{page} " * 4000


def test_small_bundles(monkeypatch):
    writer = warc.BundleWriter()
    monkeypatch.setattr(warc, "FRAME_BYTES", 10)
    for i in range(5):
        writer.add(i, warc.make_record(i, "u", b"abc", None, False))
    content = writer.close()
    assert len(seek_table(content)) == 5
    e = writer.entries[3]
    (headers, body), = parse_records(warc.read_record(content, e.frame, e.start, e.size))
    assert headers["WARC-Record-ID"] == "<urn:page:3>" and body == b"abc"


def test_empty(spark):
    bundles, places = write_archives(frame(spark, []))
    assert (bundles.count(), places.count(), read(bundles)) == (0, 0, [])
