import gzip
import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import datasource as api
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from voxelherd.sources.images import (
    HeadReader, content_md5, decode_headers, incremental_index, index_images, list_images, parse_bids_path, read_files, read_headers,
)
from voxelherd.sources import image_source
from voxelherd.streaming.image_index import read_image_index, start_image_index


def header(shape=(4, 5, 6), zooms=(1.0, 0.5, 2.0), code=4, qform=0, sform=0, quatern=(0.0, 0.0, 0.0), srow=None, qfac=1.0, order="<"):
    raw = bytearray(348)
    struct.pack_into(order + "i", raw, 0, 348)
    struct.pack_into(order + "8h", raw, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into(order + "h", raw, 70, code)
    struct.pack_into(order + "8f", raw, 76, qfac, *zooms, *[0.0] * (7 - len(zooms)))
    struct.pack_into("3s", raw, 148, b"abc")
    struct.pack_into(order + "2h", raw, 252, qform, sform)
    struct.pack_into(order + "3f", raw, 256, *quatern)
    struct.pack_into(order + "12f", raw, 280, *(np.zeros(12) if srow is None else np.ravel(srow)))
    return bytes(raw)


def decode_header(content):
    return decode_headers([content]).iloc[0].to_dict()


def test_header_fields():
    got = decode_header(header() + b"\x00" * 100)
    assert got["shape"] == [4, 5, 6] and got["pixdim"] == [1.0, 0.5, 2.0] and got["dtype"] == "int16"
    assert got["orient"] == "LAS" and got["descrip"] == "abc"
    assert decode_header(gzip.compress(header(order=">")))["shape"] == [4, 5, 6]
    four = decode_header(header((2, 3, 4, 7), (0.333, 1, 1, 2.5), 16))
    assert four["shape"] == [2, 3, 4, 7] and four["pixdim"] == [0.33, 1.0, 1.0, 2.5] and four["dtype"] == "float32"


@pytest.mark.parametrize("matrix, letters", [
    ([[1, 0, 0, 0], [0, 2, 0, 0], [0, 0, 3, 0]], "RAS"),
    ([[-1, 0, 0, 0], [0, -2, 0, 0], [0, 0, 3, 0]], "LPS"),
    ([[0, 0, -1, 9], [-1, 0, 0, 9], [0, 1, 0, 9]], "PSL"),
    ([[0.9, 0.1, 0, 0], [-0.1, 0.9, 0.2, 0], [0, -0.2, -0.9, 0]], "RAI"),
])
def test_orientation_from_matrix(matrix, letters):
    assert decode_header(header(sform=1, srow=matrix))["orient"] == letters


def test_orientation_from_rotation():
    assert decode_header(header(qform=1))["orient"] == "RAS"
    assert decode_header(header(qform=1, qfac=-1.0))["orient"] == "RAI"
    half = float(np.sqrt(0.5))
    assert decode_header(header(qform=1, quatern=(0.0, 0.0, half)))["orient"] == "ALS"
    assert decode_header(header(qform=1, quatern=(0.0, 0.0, 1.0)))["orient"] == "LPS"


def test_bad_headers():
    bad = [b"", None, b"\x00" * 348, header()[:100], gzip.compress(header()[:100]), b"\x1f\x8bxx", header(code=3), header(shape=()),
           header(sform=1, srow=np.full(12, np.nan))]
    got = decode_headers([*bad, header()])
    assert got["reason"].notna().tolist() == [True] * len(bad) + [False]
    assert got["shape"].isna().tolist() == [True] * len(bad) + [False]
    assert got["reason"].iloc[0] == "truncated header" and got["orient"].iloc[-1] == "LAS"


@pytest.fixture()
def tree(tmp_path):
    def put(path, data):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)

    put("ds1/sub-1/anat/sub-1_T1w.nii.gz", gzip.compress(header()))
    put("ds1/sub-2/ses-a/anat/sub-2_ses-a_run-1_T2w.nii", header((7, 8, 9)) + b"x" * 9000)
    put("ds1/sub-3/anat/sub-3_T1w.nii.gz", b"broken")
    put("ds1/sub-3/func/sub-3_bold.nii.gz", gzip.compress(header()))
    put("ds1/bidsignore/anat/sub-9_T1w.nii", header())
    put("ds1/sub-1/anat/.sub-1_T1w.nii.gz", header())
    put("ds1/sub-1/anat/notes.txt", b"no")
    return tmp_path


def test_listing(spark, tree):
    got = list_images(spark, str(tree))
    assert sorted(r["path"] for r in got.collect()) == [
        "ds1/sub-1/anat/sub-1_T1w.nii.gz", "ds1/sub-2/ses-a/anat/sub-2_ses-a_run-1_T2w.nii",
        "ds1/sub-3/anat/sub-3_T1w.nii.gz", "ds1/sub-3/func/sub-3_bold.nii.gz",
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_index_job(spark, tree):
    index, rejects = index_images(spark, str(tree))
    rows = sorted(index.collect(), key=lambda r: r["path"].split("/"))
    assert [r["path"] for r in rows] == ["ds1/sub-1/anat/sub-1_T1w.nii.gz", "ds1/sub-2/ses-a/anat/sub-2_ses-a_run-1_T2w.nii"]
    second = rows[1]
    data = (tree / second["path"]).read_bytes()
    assert second["md5"] == hashlib.md5(data).hexdigest() and second["size"] == len(data) and second["shape"] == [7, 8, 9]
    assert second["entities"] == {"sub": "2", "ses": "a", "run": "1"} and second["suffix"] == "T2w"
    assert {(r["stage"], r["path"].rsplit("/", 1)[1]) for r in rejects.collect()} == {
        ("path", "sub-3_bold.nii.gz"), ("header", "sub-3_T1w.nii.gz"),
    }
    rest, _ = index_images(spark, str(tree), existing=index.where(F.col("path") == rows[0]["path"]))
    assert [r["path"] for r in rest.collect()] == [second["path"]]
    none, _ = index_images(spark, str(tree), existing=list_images(spark, str(tree)))
    assert none.count() == 0


def test_only_new_files_are_opened(spark, tree):
    todo, _ = parse_bids_path(list_images(spark, str(tree)))
    # Files that are indexed already may have become unreadable.
    for path in [r["path"] for r in todo.collect()]:
        (tree / path).write_bytes(b"changed since")
    odd = tree / "ds{2}" / "sub-1" / "anat"
    odd.mkdir(parents=True)
    (odd / "sub-1_T1w.nii").write_bytes(header())
    new, _ = index_images(spark, str(tree), existing=todo)
    assert [r["dataset"] for r in new.collect()] == ["ds{2}"]
    gone = spark.createDataFrame([("ds1/none_T1w.nii", 1)], "path string, size bigint")
    assert read_files(gone, str(tree)).first()["reason"].startswith("cannot be read")


def test_md5_of_missing_content(spark):
    df = spark.createDataFrame([("a", b"x"), ("b", None)], "path string, content binary")
    assert {r["path"]: r["md5"] for r in content_md5(df).collect()} == {"a": hashlib.md5(b"x").hexdigest(), "b": None}
    assert [r["path"] for r in incremental_index(df, df.where("path = 'a'")).collect()] == ["b"]


def with_extra_field(data, size):
    """A gzip file whose header has an extra field."""
    packed = gzip.compress(data)
    return packed[:3] + bytes([packed[3] | 4]) + packed[4:10] + struct.pack("<H", size) + b"x" * size + packed[10:]


def long_header(order="<"):
    raw = bytearray(540)
    struct.pack_into(order + "i", raw, 0, 540)
    struct.pack_into(order + "h", raw, 12, 16)
    struct.pack_into(order + "8q", raw, 16, 3, 40, 50, 60, 1, 1, 1, 1)
    struct.pack_into(order + "8d", raw, 104, 1.0, 1.5, 0.5, 2.0, 0, 0, 0, 0)
    struct.pack_into("4s", raw, 240, b"long")
    return bytes(raw)


def test_headers_are_decoded_wherever_they_lie(spark):
    raw = header() + b"\x00" * 100_000
    files = {
        "plain": raw, "extra": with_extra_field(raw, 5000), "members": gzip.compress(raw[:10]) + gzip.compress(raw[10:]),
        "three": gzip.compress(b"") + gzip.compress(raw[:300]) + with_extra_field(raw[300:], 60_000),
        "only": header(), "long": long_header(), "long_gz": gzip.compress(long_header(">") + b"x" * 999), "cut": long_header()[:500],
    }
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = {r["path"]: r for r in read_headers(df).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {k: "truncated header" if k == "cut" else None for k in files}
    assert all(got[k]["shape"] == [4, 5, 6] for k in ("plain", "extra", "members", "three", "only"))
    for k in ("long", "long_gz"):
        assert (got[k]["shape"], got[k]["pixdim"], got[k]["dtype"], got[k]["descrip"]) == ([40, 50, 60], [1.5, 0.5, 2.0], "float32", "long")


def test_pieces_of_any_size_give_the_same_header():
    content = gzip.compress(b"") + with_extra_field(header() + b"y" * 900, 777)
    for size in (1, 2, 3, 100, 5000):
        reader = HeadReader()
        for at in range(0, len(content), size):
            reader.feed(content[at : at + size])
        assert reader.result() == (header() + b"y" * 900)[:540]


def test_stream_picks_up_only_new_files(spark, tree):
    out, state = str(tree.parent / f"{tree.name}-out"), str(tree.parent / f"{tree.name}-state")
    run = lambda: start_image_index(spark, str(tree), out, state, max_files=2).awaitTermination()
    run()
    before = read_image_index(spark, out).count()
    run()
    assert read_image_index(spark, out).count() == before
    (tree / "ds1" / "copy_T1w.nii.gz").write_bytes((tree / "ds1/sub-1/anat/sub-1_T1w.nii.gz").read_bytes())
    run()
    index = read_image_index(spark, out)
    assert index.count() == before + 1
    copies = index.where(F.col("path").endswith("copy_T1w.nii.gz")).first()
    assert copies["duplicate"] and copies["reason"] is not None
    batch, _ = index_images(spark, str(tree))
    assert set(batch.columns) <= set(index.columns)
    first = index.where(F.col("path").endswith("sub-1_T1w.nii.gz")).first()
    assert first["shape"] == [4, 5, 6] and first["entities"]["sub"] == "1" and first["reason"] is None


# --- the image source ----------------------------------------------------------------

def reader_of(root, columns=("path", "size", "dataset", "suffix"), partition_bytes=1000):
    every = _parse_datatype_string(image_source.SCHEMA)
    return image_source.ImageReader(str(root), StructType([every[c] for c in columns]), partition_bytes)


def test_scan_gives_the_rows_of_the_index(spark, tree):
    index, rejects = index_images(spark, str(tree))
    found = image_source.scan_images(spark, str(tree), ["path", "size", "dataset", "suffix", "md5", "shape", "pixdim", "dtype", "orient", "reason"])
    got = {r["path"]: r for r in found.collect()}
    for row in index.collect():
        own = got[row["path"]]
        assert all(own[c] == row[c] for c in ("size", "dataset", "suffix", "md5", "shape", "pixdim", "dtype", "orient")) and own["reason"] is None
    for row in rejects.where("stage = 'header'").collect():
        assert got[row["path"]]["reason"] == row["reason"]
    listed = image_source.scan_images(spark, str(tree))
    assert {(r["path"], r["size"]) for r in listed.collect()} == {(r["path"], r["size"]) for r in list_images(spark, str(tree)).collect()}
    modified = {r["path"]: r["modified"] for r in listed.collect()}
    assert {r["path"]: r["modificationTime"] for r in list_images(spark, str(tree)).collect()}.keys() == modified.keys()


def test_filters_reach_the_listing(spark, tree):
    found = image_source.scan_images(spark, str(tree), ["path", "size", "dataset", "suffix"])
    kept = found.where("dataset IN ('ds1', 'none') AND suffix = 'T1w' AND size > 10 AND path LIKE 'ds1/sub%' AND path LIKE '%gz'")
    plan = kept._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed, rest = plan.split("PushedFilters: ")[1].split("\n", 1)
    for one in ("In(dataset", "EqualTo(suffix,T1w)", "GreaterThan(size,10)", "StringStartsWith(path,ds1/sub)"):
        assert one in pushed
    assert "EndsWith(path" in rest and "suffix" not in rest.split("Condition")[1].split("\n")[0]
    want = {r["path"] for r in found.collect() if r["dataset"] == "ds1" and r["suffix"] == "T1w" and r["size"] > 10 and r["path"].endswith("gz")}
    assert {r["path"] for r in kept.collect()} == want and want


def test_only_listed_datasets_are_visited_and_small_columns_open_nothing(tree):
    reader = reader_of(tree)
    left = list(reader.pushFilters([api.EqualTo(("dataset",), "ds1"), api.In(("dataset",), ("ds1", "ds2")), api.StringEndsWith(("path",), "z")]))
    assert [type(f) for f in left] == [api.StringEndsWith] and reader.datasets == {"ds1"}
    assert {p.split("/")[0] for p, *_ in reader.listing()} == {"ds1"}
    parts = reader.partitions()
    for _, path in [(0, p) for part in parts for p, *_ in part.files]:
        (tree / path).chmod(0)
        (tree / path).unlink()
    rows = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    assert rows and all(r["dataset"] == "ds1" and r["size"] > 0 for r in rows)


def test_partitions_follow_bytes_when_files_are_opened(tmp_path):
    for i in range(30):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"sub-{i}_T1w.nii").write_bytes(header() + b"x" * (100 * i))
    opened = reader_of(tmp_path, ("path", "md5"), 5000).partitions()
    assert len(opened) > 5 and sum(len(p.files) for p in opened) == 30
    assert all(sum(f[1] for f in p.files) <= 5000 or len(p.files) == 1 for p in opened)
    assert len(reader_of(tmp_path, ("path", "size"), 5000).partitions()) == 1
    assert [p.files for p in reader_of(tmp_path / "d0", ("path",), 1).partitions()] and reader_of(tmp_path, ("path",)).partitions()[0].files
    (tmp_path / "none").mkdir()
    assert [p.files for p in reader_of(tmp_path / "none").partitions()] == [[]]
    # Without the hash a file is read as far as its header.
    whole = next(iter(reader_of(tmp_path, ("path", "shape", "reason")).read(opened[0])))
    assert whole.column("shape").to_pylist() == [[4, 5, 6]] * whole.num_rows and set(whole.column("reason").to_pylist()) == {None}
