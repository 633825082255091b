import time

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxelherd.functions import kernels
from voxelherd.operators import masks, volumes as v
from voxelherd.session import materialize

SHAPE, PATCH = (2, 4, 6), (1, 2, 3)


def frame(spark, n=5, shape=SHAPE, seed=0, chans=1):
    rng = np.random.default_rng(seed)
    images = rng.normal(size=(n, chans * int(np.prod(shape)))).astype("float32")
    mask = rng.random((n, int(np.prod(shape)))) < 0.6
    rows = [(i, images[i].tolist(), mask[i].tolist(), i // 2) for i in range(n)]
    df = spark.createDataFrame(rows, "scan_id long, image array<float>, mask array<boolean>, batch long")
    return df, images, mask


def column(df, name):
    rows = {r["scan_id"]: r[name] for r in df.select("scan_id", name).collect()}
    return np.array([rows[k] for k in sorted(rows)])


def test_two_channel_patches(spark):
    df, images, _ = frame(spark, chans=2)
    patches = v.patchify(df, SHAPE, PATCH, chans=2).toPandas().set_index(["scan_id", "patch_id"])["vals"]
    cube = images.reshape(5, 2, *SHAPE)
    got = np.array(patches.loc[(3, 5)]).reshape(2, *PATCH)
    # Patch 5 of the (2, 2, 2) grid sits at (1, 0, 1).
    assert np.array_equal(got, cube[3, :, 1:2, 0:2, 3:6])
    back = v.unpatchify(v.patchify(df, SHAPE, PATCH, chans=2), SHAPE, PATCH, chans=2)
    assert np.array_equal(column(back, "image"), images)


def test_incomplete_and_missing_patches(spark):
    df, images, _ = frame(spark, n=2)
    patches = v.patchify(df, SHAPE, PATCH).where("NOT (scan_id = 1 AND patch_id = 0)")
    filled = column(v.unpatchify(patches, SHAPE, PATCH, fill=0.0), "image").reshape(2, *SHAPE)
    assert (filled[1, :1, :2, :3] == 0).all() and np.array_equal(filled[0].ravel(), images[0])
    with pytest.raises(PySparkException, match="lacks patches"):
        v.unpatchify(patches, SHAPE, PATCH).collect()
    with pytest.raises(PySparkException, match="repeats a patch"):
        v.unpatchify(patches.unionByName(patches), SHAPE, PATCH, fill=0.0).collect()


def test_sizes_must_divide(spark):
    with pytest.raises(ValueError, match="not divisible"):
        kernels.patch_arrays((4, 4, 4), (3, 2, 2))
    with pytest.raises(ValueError, match="stride"):
        kernels.patch_arrays((4, 4, 4), (1, 2, 2), stride=2)
    df, _, _ = frame(spark)
    with pytest.raises(PySparkException, match="expected 64 values"):
        v.patchify(df, (4, 4, 4), (2, 2, 2)).collect()


def test_selected_patches_only(spark):
    df, _, mask = frame(spark)
    flagged = masks.add_valid(df, SHAPE, PATCH)
    rows = v.patchify(flagged, SHAPE, PATCH, mask="mask", keep="valid").toPandas()
    assert len(rows) == column(flagged, "valid").sum()
    assert sum(sum(o) for o in rows["observed"]) == mask.sum()
    joined = v.gather_patches(v.patchify(df, SHAPE, PATCH), flagged.select("scan_id", "valid"))
    assert joined.count() == len(rows)


def test_empty_patch_is_normalized_to_zero(spark):
    df, images, _ = frame(spark, n=1, shape=(2, 2, 2))
    holes = df.withColumn("mask", F.array(*[F.lit(i >= 4) for i in range(8)]))
    row = v.masked_normalize(holes, (2, 2, 2), (1, 2, 2), "patch").first()["norm"]
    assert row["image"][:4] == [0.0] * 4 and row["mean"][0] == 0.0 and row["std"][0] == pytest.approx(1e-3)
    values = images[0, 4:].astype(float)
    assert np.allclose(row["image"][4:], (values - values.mean()) / np.sqrt(values.var() + 1e-6))
    with pytest.raises(ValueError):
        v.masked_normalize(df, (2, 2, 2), (1, 2, 2), "voxel")


def test_dilation_matches_brute_force(spark):
    df, _, _ = frame(spark, n=2, shape=(4, 5, 6))
    sparse = df.withColumn("mask", F.transform("image", lambda x: x > 1.6))
    cube = column(sparse, "mask").reshape(2, 4, 5, 6)
    want = np.zeros_like(cube)
    for i, x, y, z in zip(*np.nonzero(cube)):
        want[i, max(x - 2, 0) : x + 3, max(y - 2, 0) : y + 3, max(z - 2, 0) : z + 3] = True
    got = column(sparse.withColumn("m", kernels.dilate((4, 5, 6), 2)(F.col("mask"))), "m")
    assert np.array_equal(got, want.reshape(2, -1))
    none = column(sparse.withColumn("m", kernels.dilate((4, 5, 6), 0)(F.col("mask"))), "m")
    assert np.array_equal(none, cube.reshape(2, -1))


def test_packed_bits(spark):
    df = spark.createDataFrame([(0, [True, False, True] + [False] * 6 + [True])], "scan_id long, mask array<boolean>")
    packed = df.withColumn("b", kernels.pack_bits(10)(F.col("mask")))
    assert bytes(packed.first()["b"]) == bytes([0b10100000, 0b01000000])
    assert packed.select(kernels.unpack_bits(10)(F.col("b"))).first()[0] == df.first()["mask"]
    with pytest.raises(PySparkException, match="expected 3 bytes"):
        packed.select(kernels.unpack_bits(20)(F.col("b"))).collect()


def test_blur_keeps_constants_and_zeroes_outside(spark):
    df, _, mask = frame(spark, n=3)
    flat = df.withColumn("image", F.transform("image", lambda _: F.lit(5.0).cast("float")))
    got = column(v.masked_blur(flat, SHAPE, 0, sigma=(0.4, 0.6)), "image")
    assert np.allclose(got, np.where(mask, 5.0, 0.0))
    same = column(v.masked_blur(df, SHAPE, 0, p=0.0), "image")
    assert np.allclose(same, column(df, "image"))


def test_noise_is_seeded_per_scan(spark):
    df, _, mask = frame(spark, n=4)
    noisy = lambda d: column(v.intensity_augment(d, SHAPE, 3, noise_std=(0.5, 0.5)), "image")
    first = noisy(df)
    assert np.array_equal(first, noisy(df.repartition(3))) and (first[~mask] == 0).all()
    added = first[mask] - column(df, "image")[mask]
    assert 0.35 < added.std() < 0.65
    with pytest.raises(ValueError):
        v.intensity_augment(df, SHAPE, 3, scale=(2.0, 1.0))


def test_augment_shifts_image_and_mask_alike(spark):
    df, images, mask = frame(spark, n=6, shape=(6, 6, 6))
    ones = df.withColumn("image", F.transform("mask", lambda m: m.cast("float")))
    out = v.augment(ones, (6, 6, 6), 1, pad_range=(1, 3))
    assert np.array_equal(column(out, "image") > 0, column(out, "mask"))
    shifts = column(df.withColumn("s", v.jitter_shift(F.col("scan_id"), (1, 3), 1)), "s")
    assert np.abs(shifts).max() <= 3
    with pytest.raises(ValueError):
        v.jitter_shift(F.col("scan_id"), (3, 1), 1)


def test_shift_past_the_border_is_empty(spark):
    df, _, _ = frame(spark, n=1)
    moved = df.withColumn("m", kernels.shift_volume(SHAPE)(F.col("image"), F.array(F.lit(2), F.lit(0), F.lit(0))))
    assert not column(moved, "m").any()


def test_window_pads_and_crop(spark):
    assert kernels.window_pads((64, 64, 21), (64, 64, 64)) == [(0, 0), (0, 0), (21, 22)]
    assert kernels.window_pads((80, 70, 64), (64, 64, 64)) == [(0, 0)] * 3
    df, images, _ = frame(spark, n=2)
    padded, shape = v.pad_to_window(df, SHAPE, (4, 4, 7))
    assert shape == (4, 4, 7)
    assert np.array_equal(column(v.crop_back(padded, SHAPE, (4, 4, 7)), "image"), images)


@pytest.mark.parametrize("mode", ["mean", "gaussian"])
def test_stitched_windows_restore_the_volume(spark, mode):
    df, images, _ = frame(spark, n=3, shape=(5, 5, 5))
    tiles = v.window_tiles(df, (5, 5, 5), (4, 4, 4), 0.5)
    assert tiles.count() == 3 * 8
    got = column(v.stitch(tiles, (5, 5, 5), (4, 4, 4), 0.5, mode), "image")
    assert got.shape == (3, 125) and np.allclose(got, images, atol=1e-6)
    with pytest.raises(ValueError):
        v.stitch(tiles, (5, 5, 5), (4, 4, 4), mode="max")


def test_window_starts_reach_the_border():
    assert kernels.window_starts(80, 64, 0.5) == [0, 16]
    assert kernels.window_starts(64, 64, 0.5) == [0]
    with pytest.raises(ValueError):
        kernels.window_starts(10, 64, 0.5)


def test_views(spark):
    df, images, _ = frame(spark, n=2)
    cube = images.reshape(2, *SHAPE)
    for view, plane in (("sagittal", cube[1, 1]), ("axial", cube[1, :, :, 3]), ("coronal", cube[1, :, 2])):
        assert np.array_equal(column(v.extract_view(df, SHAPE, view), "plane")[1], plane.T[::-1])
    assert np.array_equal(column(v.extract_view(df, SHAPE, "axial", -1), "plane")[0], cube[0, :, :, 5].T[::-1])
    with pytest.raises(IndexError):
        v.extract_view(df, SHAPE, "axial", 6)
    assert [v.view_patch(x, (1, 2, 3)) for x in ("sagittal", "axial", "coronal")] == [(3, 2), (2, 1), (3, 1)]


def test_display_limits(spark):
    def limits(values, flags):
        df = spark.createDataFrame([(0, values, flags)], "scan_id long, image array<float>, mask array<boolean>")
        row = v.intensity_limits(df).first()
        return row["vmin"], row["vmax"]

    many = np.random.default_rng(0).normal(size=40).astype("float32")
    assert limits(many.tolist(), [True] * 40) == pytest.approx(tuple(np.quantile(many.astype(float), (0.005, 0.995))))
    assert limits([1.0, 5.0, 3.0, float("nan")], [True, False, True, True]) == (1.0, 3.0)
    assert limits([2.0, 2.0], [True, True]) == (1.0, 3.0)
    assert limits([100.0, 100.0], [True, True]) == (95.0, 105.0)
    assert limits([1.0, 4.0], [False, False]) == (1.0, 4.0)
    assert limits([float("nan"), float("inf")], [True, True]) == (0.0, 1.0)


def test_crop_boxes(spark):
    plane = np.zeros((9, 8), bool)
    plane[5, 3] = True
    df = spark.createDataFrame([(0, plane.tolist()), (1, np.zeros((9, 8), bool).tolist())], "scan_id long, plane array<array<boolean>>")
    boxes = {r["scan_id"]: (r["row0"], r["row1"], r["col0"], r["col1"]) for r in v.content_crop(df, (2, 3)).collect()}
    assert boxes == {0: (2, 8, 0, 8), 1: (0, 9, 0, 8)}


# --- masks ---------------------------------------------------------------------------

def valid_frame(spark, counts, n=10):
    rows = [(i, [k < c for k in range(n)], b) for i, (c, b) in enumerate(counts)]
    return spark.createDataFrame(rows, "scan_id long, valid array<boolean>, batch long")


def test_loss_on_the_scan_row(spark):
    rows = [(i, p, [float(i), 2.0], [1.0, float(p)], [True, p == 0]) for i in range(3) for p in range(4)]
    df = spark.createDataFrame(rows, "scan_id long, patch_id int, pred array<double>, target array<double>, mask array<boolean>")
    apart = v.masked_mse(df.select("scan_id", "patch_id", "pred"), df.select("scan_id", "patch_id", "target", "mask")).first()
    packed = df.groupBy("scan_id").agg(*[F.sort_array(F.collect_list(F.struct("patch_id", c))).alias(c) for c in ("pred", "target", "mask")])
    scans = materialize(packed.select("scan_id", *[F.col(f"{c}.{c}").alias(c) for c in ("pred", "target", "mask")]))
    together = v.masked_mse_of_scans(scans)
    assert tuple(together.first()) == pytest.approx(tuple(apart))
    assert together._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_scans_of_different_sizes(spark):
    shapes = [[2, 3, 4], [5, 1, 2], [7, 8, 6]]
    rng = np.random.default_rng(0)
    scans = [rng.integers(-2, 3, size=s).astype(np.float32) for s in shapes]
    rows = [(i, s, scan.ravel().tolist(), (scan.ravel() > 0).tolist()) for i, (s, scan) in enumerate(zip(shapes, scans))]
    df = spark.createDataFrame(rows, "scan_id long, shape array<int>, image array<float>, mask array<boolean>").coalesce(1)
    made = v.mask_from_segmentation(df.withColumn("seg", F.col("image").cast("array<int>"))).orderBy("scan_id").collect()
    assert [r["mask"] for r in made] == [(s.ravel() > 0).astype(int).tolist() for s in scans]
    limits = v.intensity_limits(df).orderBy("scan_id").collect()
    assert [len(s[s > 0]) < 32 or r["vmin"] >= 1 for s, r in zip(scans, limits)] == [True] * 3
    wide = v.pad_each_to_window(df, (4, 4, 4))
    assert wide.schema["image"].dataType == df.schema["image"].dataType
    for row, s in zip(wide.orderBy("scan_id").collect(), scans):
        pads = kernels.window_pads(s.shape, (4, 4, 4))
        assert np.array_equal(np.pad(s, pads).ravel(), row["image"])
    back = v.crop_each_back(wide, (4, 4, 4)).orderBy("scan_id").collect()
    assert [r["image"] for r in back] == [s.ravel().tolist() for s in scans]


def test_augmentation_keeps_the_type(spark):
    rows = [(1, [1.5] * 48, [True] * 48)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"scan_id long, image array<{kind}>, mask array<boolean>")
        moved = v.augment(df, SHAPE, 1, (0, 0), blur_p=1.0, scale=(2.0, 2.0)) if kind == "float" else v.masked_blur(df, SHAPE, 1)
        assert moved.schema["image"].dataType == df.schema["image"].dataType and moved.first()["image"][0] is not None


def test_dense_masks_pass(spark):
    df = spark.createDataFrame([(1, [True, False], bytearray(b"\x80"))], "scan_id long, mask array<boolean>, packed binary")
    assert v.unpack_mask(df, 2).first()["mask"] == [True, False] == v.unpack_mask(df, 2, "packed").first()["packed"]


def test_scans_without_a_batch_stay(spark):
    df = valid_frame(spark, [(6, 0), (4, 1)]).withColumn("batch", F.nullif("batch", F.lit(1)))
    got = masks.random_mask(df, 0.5, 1).collect()
    assert sorted(sum(r["visible"]) for r in got) == [2, 3]


def test_quota_time_follows_the_number_of_patches(spark):
    def seconds(n):
        df = spark.range(8, numPartitions=1).select(
            F.col("id").alias("scan_id"), F.lit(0).alias("batch"), F.array_repeat(F.lit(True), n).alias("valid")
        )
        start = time.perf_counter()
        kept = masks.random_mask(df, 0.8, 1).select(masks.count_set(F.col("visible")).alias("n")).distinct().collect()
        assert [r["n"] for r in kept] == [int((1 - 0.8) * n)]
        return time.perf_counter() - start

    seconds(500)
    half, whole = seconds(10_140), seconds(20_280)
    # Eight scans in one task: about a second each at most, and no square growth.
    assert whole < 16 and whole < 3.5 * half + 1


def test_quota_rounds_down_in_double(spark):
    got = masks.random_mask(valid_frame(spark, [(10, 0)]), 0.8, 1).first()
    assert got["num_keep"] == int((1 - 0.8) * 10) == 1 and sum(got["visible"]) == 1


def test_batch_minimum(spark):
    df = valid_frame(spark, [(5, 0), (8, 0), (3, 0), (9, 1)])
    got = {r["scan_id"]: r for r in masks.random_mask(df, 0.0, 1).collect()}
    assert [sum(got[i]["visible"]) for i in range(4)] == [3, 3, 3, 9]
    assert all(not (a and not b) for r in got.values() for a, b in zip(r["visible"], r["valid"]))
    first = {r["scan_id"]: r["visible"] for r in masks.random_mask(df, 0.0, 1, shuffle=False).collect()}
    assert first[1] == [True] * 3 + [False] * 7
    none = masks.random_mask(valid_frame(spark, [(5, 0), (0, 0)]), 0.0, 1)
    assert all(not any(r["visible"]) for r in none.collect())
    stats = {r["batch"]: (r["valid_mean"], r["valid_min"], r["visible"]) for r in masks.mask_stats(df, 0.5).collect()}
    assert stats == {0: (pytest.approx(16 / 3), 3, 1), 1: (9.0, 9, 4)}


def test_share_as_written(spark):
    """A fifth of five patches is one, though 1 - 0.8 in doubles is below 0.2."""
    df = valid_frame(spark, [(5, 0), (8, 0)])
    assert [r["visible"] for r in masks.mask_stats(df, 0.8).collect()] == [1]
    assert [sum(r["visible"]) for r in masks.random_mask(df, 0.8, 1).collect()] == [1, 1]


@pytest.mark.parametrize("name, options", [
    ("block", {}), ("block", {"block": (9, 2, 2)}), ("hybrid", {"random_fraction": 0.25, "block_fraction": 0.5}), ("random", {}),
])
def test_masking_invariants(spark, name, options):
    df, _, _ = frame(spark, n=8, shape=(4, 4, 4))
    ready = masks.add_valid(df, (4, 4, 4), (1, 1, 1))
    made = masks.apply_masking(name, ready, 0.7, 11, (4, 4, 4), **options).toPandas().set_index("scan_id")
    again = masks.apply_masking(name, ready.repartition(5), 0.7, 11, (4, 4, 4), **options).toPandas().set_index("scan_id")
    for scan, row in made.iterrows():
        visible, valid = np.array(row["visible"]), np.array(row["valid"])
        assert visible.sum() == row["num_keep"] and not (visible & ~valid).any()
        assert list(again.loc[scan, "visible"]) == list(visible)
    other = masks.apply_masking(name, ready, 0.7, 12, (4, 4, 4), **options).toPandas().set_index("scan_id")
    assert any(list(other.loc[s, "visible"]) != list(made.loc[s, "visible"]) for s in made.index)


def test_blocks_are_contiguous(spark):
    df = spark.createDataFrame([(0, [True] * 64, 0)], "scan_id long, valid array<boolean>, batch long")
    masked = ~np.array(masks.block_mask(df, 0.125, 2, (4, 4, 4)).first()["visible"]).reshape(4, 4, 4)
    corners = np.argwhere(masked)
    assert masked.sum() == 8 and (corners.max(0) - corners.min(0) == 1).all()


def test_masking_registry(spark):
    df = valid_frame(spark, [(5, 0)])
    with pytest.raises(ValueError, match="unknown masking"):
        masks.apply_masking("other", df, 0.5, 1, (1, 1, 10))
    with pytest.raises(ValueError):
        masks.block_mask(df, 0.5, 1, (1, 1, 10), random_fraction=0.0, block_fraction=0.0)
    with pytest.raises(ValueError):
        masks.block_mask(df, 0.5, 1, (1, 1, 10), block=(0, 1, 1))


def test_scatter_of_a_scan_without_predictions(spark):
    df, _, mask = frame(spark, n=2)
    preds = v.patchify(df, SHAPE, PATCH).where("scan_id = 0 AND patch_id < 2").select("scan_id", "patch_id", F.col("vals").cast("array<double>").alias("pred"))
    out = column(v.scatter_predictions(preds, df, SHAPE, PATCH), "image")
    assert not out[1].any() and not out[0][~mask[0]].any() and out[0].any()
    assert isinstance(pd.DataFrame(out), pd.DataFrame)
