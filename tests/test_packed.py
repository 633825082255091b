"""Volumes as bytes give what volumes as lists give, and what numpy gives."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxelherd.operators import masks, packed, volumes

SHAPE, PATCH = (4, 6, 8), (2, 3, 4)


def table(spark, n=5):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(10, 3, 192).astype("f4").tolist(), (rng.random(192) > (0.4 if i else 2)).tolist(), "keep") for i in range(n)]
    return spark.createDataFrame(rows, "scan_id long, image array<float>, mask array<boolean>, other string")


def values(raw, kind="<f4"):
    return np.frombuffer(raw, kind)


def test_packing_round_trip(spark):
    df = table(spark)
    packed_rows = packed.pack_volumes(df, SHAPE)
    first = packed_rows.orderBy("scan_id").first()
    assert len(first["image"]) == 4 * 192 and len(first["mask"]) == 192 and first["shape"] == list(SHAPE) and first["other"] == "keep"
    back = packed_rows.select("scan_id", packed.unpack_values("float")(F.col("image")).alias("image"), packed.unpack_values("boolean")(F.col("mask")).alias("mask"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select("scan_id", "image", "mask").collect()))
    nulls = spark.createDataFrame([(1, None)], "scan_id long, image array<float>")
    assert packed.pack_volumes(nulls, SHAPE, mask=None).first()["image"] is None


@pytest.mark.parametrize("stride", [1, 2])
def test_patches_equal_those_of_lists(spark, stride):
    df = table(spark)
    want = {(r.scan_id, r.patch_id): (r.vals, r.observed) for r in volumes.patchify(df, SHAPE, PATCH, stride=stride, mask="mask").collect()}
    made = packed.patchify(packed.pack_volumes(df, SHAPE), PATCH, stride=stride, mask="mask")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.scan_id, r.patch_id): (values(r.vals).tolist(), values(r.observed, "bool").tolist()) for r in made.collect()}
    assert got == want


def test_only_kept_patches_become_rows(spark):
    df = packed.add_valid(packed.pack_volumes(table(spark), SHAPE), PATCH)
    lists = masks.add_valid(table(spark), SHAPE, PATCH)
    valid = {r.scan_id: r.valid for r in df.collect()}
    assert valid == {r.scan_id: r.valid for r in lists.collect()} and not any(valid[0])
    got = {(r.scan_id, r.patch_id) for r in packed.patchify(df, PATCH, keep="valid").collect()}
    assert got == {(scan, i) for scan, flags in valid.items() for i, flag in enumerate(flags) if flag}


def test_back_to_volumes(spark):
    df = packed.pack_volumes(table(spark), SHAPE)
    cut = packed.patchify(df, PATCH)
    whole = {r.scan_id: r.image for r in packed.unpatchify(cut.repartition(3), SHAPE, PATCH).collect()}
    assert whole == {r.scan_id: r.image for r in df.collect()}
    part = packed.unpatchify(cut.where("patch_id <> 0"), SHAPE, PATCH, fill=-1.0).first()
    assert (values(part.image).reshape(SHAPE)[:2, :3, :4] == -1).all()
    for bad, why in ((cut.where("patch_id <> 0"), "lacks"), (cut.union(cut.limit(1)), "repeats")):
        with pytest.raises(PySparkException, match=why):
            packed.unpatchify(bad, SHAPE, PATCH).collect()


@pytest.mark.parametrize("level", ["global", "slice", "patch"])
@pytest.mark.parametrize("mask", ["mask", None])
def test_normalization_equals_that_of_lists(spark, level, mask):
    df = table(spark)
    want = {r.scan_id: r.norm for r in volumes.masked_normalize(df, SHAPE, PATCH, level, mask=mask).select("scan_id", "norm").collect()}
    for element, kind, close in (("double", "<f8", 1e-9), ("float", "<f4", 1e-4)):
        got = packed.masked_normalize(packed.pack_volumes(df, SHAPE), PATCH, level, mask=mask, element=element).collect()
        assert len(got) == len(want)
        for r in got:
            assert r.element == element and r.shape == list(SHAPE)
            assert np.allclose(values(r.image, kind), want[r.scan_id].image, atol=close)
            assert np.allclose(r["mean"], want[r.scan_id].mean, atol=1e-5) and np.allclose(r["std"], want[r.scan_id].std, atol=1e-5)


def test_shapes_may_differ_and_wrong_sizes_are_told(spark):
    rows = [(1, np.arange(8, dtype="<f4").tobytes(), "float", [2, 2, 2]), (2, np.arange(16, dtype="<f8").tobytes(), "double", [2, 2, 4])]
    df = spark.createDataFrame(rows, "scan_id long, image binary, element string, shape array<int>")
    got = packed.patchify(df, (2, 2, 2)).groupBy("scan_id").count().collect()
    assert {r.scan_id: r["count"] for r in got} == {1: 1, 2: 2}
    with pytest.raises(PySparkException, match="bytes, not"):
        packed.patchify(df.withColumn("element", F.lit("double")), (2, 2, 2)).collect()
    with pytest.raises(PySparkException, match="null in some rows"):
        packed.patchify(df.withColumn("image", F.lit(None).cast("binary")), (2, 2, 2)).collect()
    with pytest.raises(ValueError, match="unknown level"):
        packed.masked_normalize(df, (2, 2, 2), "voxel")
    assert packed.patchify(df.limit(0), (2, 2, 2)).count() == 0
