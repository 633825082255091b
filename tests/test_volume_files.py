import gzip
import io
import json
import struct
import tarfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_images import header, with_extra_field
from voxelherd.sources import sinks
from voxelherd.sources.volumes import build_samples, decode_volume, read_volumes


def volume(values, slope=0.0, shift=0.0, srow=None, start=352):
    raw = bytearray(header(values.shape, (2.0, 3.0, 4.0)[: values.ndim], {"int16": 4, "float32": 16}[values.dtype.name], sform=int(srow is not None), srow=srow))
    struct.pack_into("<f", raw, 108, start)
    struct.pack_into("<2f", raw, 112, slope, shift)
    raw[123] = 2 | 8
    return bytes(raw) + b"\0" * (start - 348) + values.tobytes(order="F")


def test_values_affine_and_summary():
    data = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    image, affine, summary = decode_volume(gzip.compress(volume(data, 0.5, 10.0)))
    assert image.dtype == np.float32 and np.array_equal(image, data * 0.5 + 10)
    assert np.allclose(affine @ [0.5, 1.0, 1.5, 1], [0, 0, 0, 1]) and affine[0, 0] == -2
    assert summary["zooms"] == [2.0, 3.0, 4.0] and summary["units"] == ["mm", "sec"] and summary["datatype"] == "int16"
    rows = np.array([[1, 0, 0, 5], [0, 1, 0, 6], [0, 0, 1, 7]], dtype=float)
    assert np.array_equal(decode_volume(with_extra_field(volume(data, srow=rows, start=400), 6000))[1][:3], rows)
    for bad in (b"", b"\x1f\x8bxx", volume(data)[:-1], header()[:100]):
        with pytest.raises(ValueError):
            decode_volume(bad)


@pytest.fixture()
def tree(tmp_path):
    rng = np.random.default_rng(0)
    scans = {}
    for i, shape in enumerate([(2, 3, 4), (4, 4, 4), (1, 5, 2), (3, 3, 3)]):
        image = rng.normal(size=shape).astype(np.float32)
        label = rng.integers(0, 3, size=shape).astype(np.int16)
        (tmp_path / f"s{i}.nii.gz").write_bytes(gzip.compress(volume(image)))
        (tmp_path / f"m{i}.nii").write_bytes(volume(label))
        scans[f"s{i}"] = (image, label)
    return tmp_path, scans


def plan(spark, rows):
    return spark.createDataFrame(rows, "shard long, key string, image_path string, mask_path string, meta string")


def test_files_to_archives_and_back(spark, tree):
    root, scans = tree
    rows = [(i // 3, f"s{i}", f"s{i}.nii.gz", f"m{i}.nii", ['{"site": "x"}', "{}", None, ""][i]) for i in range(4)]
    out = str(root / "shards")
    written = sinks.write_file_shards(plan(spark, rows), str(root), out).collect()
    assert sorted(r["n_samples"] for r in written) == [1, 3]
    found = {}
    for r in written:
        with tarfile.open(r["path"]) as tar:
            for member in tar:
                found[member.name] = tar.extractfile(member).read()
    for key, (image, label) in scans.items():
        assert np.array_equal(np.load(io.BytesIO(found[f"{key}.image.npy"])), image)
        assert np.array_equal(np.load(io.BytesIO(found[f"{key}.mask.npy"])), (label > 0).astype(np.uint8))
        assert json.loads(found[f"{key}.meta.json"])["header"]["shape"] == list(image.shape)
    assert json.loads(found["s0.meta.json"])["site"] == "x"
    with pytest.raises(FileExistsError):
        sinks.write_file_shards(plan(spark, rows), str(root), out)
    again = sinks.write_file_shards(plan(spark, rows[:1]), str(root), out, overwrite=True).collect()
    assert [p.name for p in (root / "shards").iterdir() if p.suffix == ".tar"] == [again[0]["path"].rsplit("/", 1)[1]]


def test_rejects_tell_why(spark, tree):
    root, _ = tree
    rows = [(0, "a", "s0.nii.gz", "m1.nii", "{}"), (0, "b", "none.nii", "m1.nii", "{}"), (0, "c", "s1.nii.gz", "m1.nii", "{}")]
    samples, bad = build_samples(plan(spark, rows), str(root))
    assert [r["key"] for r in samples.collect()] == ["c"]
    got = {r["path"]: r["reason"] for r in bad.collect()}
    assert got["a"] == "image and mask differ in shape" and got["b"].startswith("cannot be read")
    with pytest.raises(PySparkException, match="differ in shape"):
        sinks.write_file_shards(plan(spark, rows[:1]), str(root), str(root / "none"))
    assert read_volumes(spark.createDataFrame([("s3.nii.gz",)], "path string"), str(root)).first()["shape"] == [3, 3, 3]
    assert "Exchange" not in samples.select(F.col("image"))._jdf.queryExecution().executedPlan().toString()
