"""Volume tables: patches, normalization, loss, augmentation, windows, views.

``volumes`` hold one row per scan with C-order arrays; ``patches`` hold one row per scan
and patch. Whole-volume work stays on its row. Patch rows are the finest table written;
voxels are never exploded.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from math import prod

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelherd.functions import kernels
from voxelherd.functions.columns import hash_between, hash_int, hash_uniform

Shape = Sequence[int]


# --- patches -------------------------------------------------------------------------

def patchify(
    df: DataFrame, shape: Shape, patch: Shape, image: str = "image", scan: str = "scan_id",
    chans: int = 1, stride: int = 1, element: str = "float", mask: str | None = None, keep: str | None = None,
) -> DataFrame:
    """One row per patch: ``patch_id`` in C order of the grid and its values.

    ``mask`` names a voxel mask cut alongside into ``observed``. With ``keep``, one flag
    per patch, only flagged patches become rows.
    """
    parts = [kernels.patch_arrays(shape, patch, chans, stride, element)(F.col(image)).alias("vals")]
    if mask:
        parts.append(kernels.patch_arrays(shape, patch, 1, stride, "boolean")(F.col(mask)).alias("observed"))
    if keep:
        parts.append(F.col(keep).alias("keep"))
    cut = df.select(scan, *parts).withColumn("_rows", F.arrays_zip(*[
        name for name, given in (("vals", True), ("observed", mask), ("keep", keep)) if given
    ]))
    rows = cut.select(scan, F.posexplode("_rows").alias("patch_id", "_row"))
    if keep:
        rows = rows.where("_row.keep")
    return rows.select(scan, "patch_id", "_row.vals", *(["_row.observed"] if mask else []))


def unpatchify(
    patches: DataFrame, shape: Shape, patch: Shape, scan: str = "scan_id", vals: str = "vals",
    chans: int = 1, stride: int = 1, element: str = "float", fill: float | None = None,
) -> DataFrame:
    """Patch rows back to volumes.

    A scan has a fixed number of patches, so a group is one volume. Missing patches are
    an error, or hold ``fill``.
    """
    packed = patches.groupBy(scan).agg(F.collect_list(F.struct("patch_id", F.col(vals).alias("v"))).alias("_rows"))
    place = kernels.volume_arrays(shape, patch, chans, stride, element, fill)
    return packed.select(scan, place(F.col("_rows.patch_id"), F.col("_rows.v")).alias("image"))


def gather_patches(patches: DataFrame, selected: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Rows of the selected patches; ``selected`` has one array of flags per scan.

    For tables of patches that lie apart: flags are unfolded to the wanted patch ids
    before they meet the patch rows. Where the flags are on the scan row,
    ``patchify(keep=...)`` picks the patches without a shuffle.
    """
    column = next(c for c in selected.columns if c != scan)
    wanted = selected.select(scan, F.posexplode(column).alias("patch_id", "_on")).where("_on").drop("_on")
    return patches.join(wanted, on=[scan, "patch_id"], how="left_semi")


def drop_scale(vals: Column, mask: Column) -> Column:
    """Scale a patch up for the voxels it lacks."""
    observed = F.size(F.filter(mask, lambda m: m))
    factor = F.size(vals) / F.greatest(observed, F.lit(1)).cast("double")
    return F.transform(vals, lambda v: v * factor)


def masked_mse(predictions: DataFrame, targets: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Mean squared error over the masked voxels of the predicted patches.

    ``predictions`` has ``pred`` per patch row, ``targets`` has ``target`` and ``mask``.
    Patches are reduced to two numbers before they are summed.
    """
    joined = predictions.join(targets, on=[scan, "patch_id"])
    squared = F.aggregate(
        F.zip_with("mask", F.zip_with("pred", "target", lambda p, t: (p - t) * (p - t)),
                   lambda m, e: F.when(m, e.cast("double")).otherwise(0.0)),
        F.lit(0.0),
        lambda acc, e: acc + e,
    )
    counted = F.size(F.filter("mask", lambda m: m))
    return joined.select(squared.alias("_e"), counted.alias("_n")).agg(
        F.sum("_n").alias("n_voxels"), F.try_divide(F.sum("_e"), F.sum("_n").cast("double")).alias("loss")
    )


def masked_mse_of_scans(df: DataFrame, pred: str = "pred", target: str = "target", mask: str = "mask") -> DataFrame:
    """:func:`masked_mse` for scans that hold predictions, targets and masks as lists of patches.

    Nothing but two numbers per task is shuffled. Use it where the three come from one
    row; the other form is for tables of patches that really lie apart.
    """
    squared = F.zip_with(
        F.flatten(mask), F.zip_with(F.flatten(pred), F.flatten(target), lambda p, t: (p - t) * (p - t)),
        lambda m, e: F.when(m, e.cast("double")).otherwise(0.0),
    )
    error = F.aggregate(squared, F.lit(0.0), lambda acc, e: acc + e)
    counted = F.size(F.filter(F.flatten(mask), lambda m: m))
    return df.select(error.alias("_e"), counted.alias("_n")).agg(
        F.sum("_n").alias("n_voxels"), F.try_divide(F.sum("_e"), F.sum("_n").cast("double")).alias("loss")
    )


def scatter_predictions(
    predictions: DataFrame, scans: DataFrame, shape: Shape, patch: Shape, scan: str = "scan_id",
    mask: str = "mask", element: str = "double",
) -> DataFrame:
    """Predicted patches in a volume of zeros, cleared outside the mask."""
    volumes = unpatchify(predictions, shape, patch, scan, "pred", element=element, fill=0.0)
    joined = scans.select(scan, mask).join(volumes, on=scan, how="left")
    empty = F.array_repeat(F.lit(0.0).cast(element), prod(shape))
    image = F.coalesce("image", empty)
    return joined.select(scan, kernels.fill_outside(prod(shape), 0.0, element)(F.col(mask), image).alias("image"))


def scatter_predictions_of_scans(
    df: DataFrame, shape: Shape, patch: Shape, ids: str = "patch_ids", pred: str = "pred", scan: str = "scan_id",
    mask: str = "mask", element: str = "double",
) -> DataFrame:
    """:func:`scatter_predictions` for scans that hold the predicted patches and their numbers as lists.

    Nothing is shuffled. A scan without predictions gives zeros.
    """
    placed = kernels.volume_arrays(shape, patch, element=element, fill=0.0)(F.col(ids), F.col(pred))
    image = kernels.fill_outside(prod(shape), 0.0, element)(F.col(mask), F.col("_image"))
    return df.withColumn("_image", placed).select(scan, image.alias("image"))


def mean_pool(embeddings: DataFrame, scan: str = "scan_id", vector: str = "embedding") -> DataFrame:
    """Mean embedding per scan, merged from partial sums."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return embeddings.groupBy(scan).agg(mean.alias("_m")).select(scan, vector_to_array("_m").alias(vector))


# --- normalization -------------------------------------------------------------------

def masked_normalize(
    df: DataFrame, shape: Shape, patch: Shape, level: str = "patch", image: str = "image", mask: str | None = "mask"
) -> DataFrame:
    """Add ``norm`` with ``image``, ``mean`` and ``std``; level is global, slice or patch.

    Without a mask every voxel counts.
    """
    flags = F.col(mask) if mask else kernels.all_set(prod(shape))(F.col(image))
    return df.withColumn("norm", kernels.masked_normalize(shape, patch, level)(F.col(image), flags))


def denormalize(value: Column, mean: Column, std: Column) -> Column:
    """Values of a patch row back to raw; untouched where either statistic is missing."""
    known = mean.isNotNull() & std.isNotNull()
    factor, offset = F.when(known, std).otherwise(1.0), F.when(known, mean).otherwise(0.0)
    return F.transform(value, lambda v: v * factor + offset)


def mask_from_segmentation(df: DataFrame, labels: str = "seg") -> DataFrame:
    """``mask``: 1 where a label is set; scans keep their own sizes."""
    return df.withColumn("mask", kernels.positive()(F.col(labels)))


def element_of(df: DataFrame, column: str) -> str:
    """Element type of a volume column."""
    return df.schema[column].dataType.elementType.simpleString()


def unpack_mask(df: DataFrame, cells: int, mask: str = "mask") -> DataFrame:
    """Packed mask bytes to flags; a mask that is dense already stays as it is."""
    if df.schema[mask].dataType.typeName() == "array":
        return df
    return df.withColumn(mask, kernels.unpack_bits(cells)(F.col(mask)))


# --- augmentation --------------------------------------------------------------------

def jitter_shift(scan: Column, pad_range: tuple[int, int], seed: int) -> Column:
    """Voxel shift per axis: pad by p from the range, crop back at a start in [0, 2p]."""
    low, high = pad_range
    if low < 0 or high < low:
        raise ValueError(f"invalid range {pad_range}")

    def axis(i: int) -> Column:
        pad = F.lit(low) + hash_int(seed, scan, "pad", i) % (high - low + 1)
        start = hash_int(seed, scan, "start", i) % (2 * pad + 1)
        return (pad - start).cast("int")

    return F.array(*[axis(i) for i in range(3)])


def jitter_crop(
    df: DataFrame, shape: Shape, pad_range: tuple[int, int], seed: int, image: str = "image", mask: str = "mask",
    scan: str = "scan_id", element: str = "float",
) -> DataFrame:
    """Shift image and mask of a scan by the same random step."""
    moved = df.withColumn("shift", jitter_shift(F.col(scan), pad_range, seed))
    return moved.withColumns({
        image: kernels.shift_volume(shape, element)(F.col(image), F.col("shift")),
        mask: kernels.shift_volume(shape, "boolean")(F.col(mask), F.col("shift")),
    })


def intensity_augment(
    df: DataFrame, shape: Shape, seed: int, scale: tuple[float, float] = (1.0, 1.0),
    shift: tuple[float, float] = (0.0, 0.0), noise_std: tuple[float, float] = (0.0, 0.0),
    image: str = "image", mask: str = "mask", scan: str = "scan_id",
) -> DataFrame:
    """Random gain, offset and noise per scan, cleared outside the mask."""
    key = F.col(scan)
    changed = kernels.intensity(shape, element_of(df, image))(
        F.col(image), F.col(mask),
        hash_between(*scale, seed, key, "scale"),
        hash_between(*shift, seed, key, "shift"),
        hash_between(*noise_std, seed, key, "noise"),
        hash_int(seed, key, "draw"),
    )
    return df.withColumn(image, changed)


def masked_blur(
    df: DataFrame, shape: Shape, seed: int, sigma: tuple[float, float] = (0.3, 0.6), p: float = 1.0,
    image: str = "image", mask: str = "mask", scan: str = "scan_id",
) -> DataFrame:
    """Blur a share ``p`` of the scans inside their mask."""
    key = F.col(scan)
    width = F.when(hash_uniform(seed, key, "blur") < p, hash_between(*sigma, seed, key, "sigma")).otherwise(0.0)
    blur = kernels.gaussian_blur(shape, element=element_of(df, image))
    return df.withColumn(image, blur(F.col(image), F.col(mask), width))


def augment(df: DataFrame, shape: Shape, seed: int, pad_range: tuple[int, int] = (4, 8), blur_p: float = 0.0,
            sigma: tuple[float, float] = (0.3, 0.6), scale: tuple[float, float] = (1.0, 1.0),
            shift: tuple[float, float] = (0.0, 0.0), noise_std: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Train-time augmentation: shift, then blur, then intensity."""
    moved = jitter_crop(df, shape, pad_range, seed) if pad_range[1] > 0 else df
    return intensity_augment(masked_blur(moved, shape, seed, sigma, blur_p), shape, seed, scale, shift, noise_std)


# --- windows -------------------------------------------------------------------------

def pad_to_window(df: DataFrame, shape: Shape, window: Shape, image: str = "image", element: str = "float"):
    """Zero-pad short axes to the window; returns the frame and the new shape."""
    pads = kernels.window_pads(shape, window)
    padded = df.withColumn(image, kernels.pad_volume(shape, pads, element)(F.col(image)))
    return padded, tuple(n + low + high for n, (low, high) in zip(shape, pads))


def crop_back(df: DataFrame, shape: Shape, window: Shape, image: str = "image", element: str = "float") -> DataFrame:
    """Undo :func:`pad_to_window`; ``shape`` is the original shape."""
    pads = kernels.window_pads(shape, window)
    padded = tuple(n + low + high for n, (low, high) in zip(shape, pads))
    return df.withColumn(image, kernels.crop_volume(padded, pads, element)(F.col(image)))


def pad_each_to_window(df: DataFrame, window: Shape, image: str = "image", shape: str = "shape") -> DataFrame:
    """Zero-pad short axes of scans of different shapes; ``shape`` is a column and stays."""
    fit = kernels.fit_window(window, False, element_of(df, image))
    return df.withColumn(image, fit(F.col(image), F.col(shape)))


def crop_each_back(df: DataFrame, window: Shape, image: str = "image", shape: str = "shape") -> DataFrame:
    """Undo :func:`pad_each_to_window`."""
    fit = kernels.fit_window(window, True, element_of(df, image))
    return df.withColumn(image, fit(F.col(image), F.col(shape)))


def window_grid(shape: Shape, window: Shape, overlap: float) -> list[tuple[int, ...]]:
    """Origins of the overlapping windows that cover the volume."""
    return list(product(*[kernels.window_starts(n, w, overlap) for n, w in zip(shape, window)]))


def window_tiles(
    df: DataFrame, shape: Shape, window: Shape, overlap: float = 0.5, image: str = "image", scan: str = "scan_id",
    element: str = "float",
) -> DataFrame:
    """One row per scan and window: ``tile`` number and its values."""
    starts = window_grid(shape, window, overlap)
    cut = kernels.window_arrays(shape, window, starts, element)(F.col(image))
    return df.select(scan, F.posexplode(cut).alias("tile", "vals"))


def window_weights(window: Shape, mode: str) -> np.ndarray:
    if mode == "gaussian":
        axes = [np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / (n * 0.125)) ** 2) for n in window]
        return np.maximum(axes[0][:, None, None] * axes[1][:, None] * axes[2], 1e-6)
    return np.ones(tuple(window))


def stitch(
    tiles: DataFrame, shape: Shape, window: Shape, overlap: float = 0.5, mode: str = "mean", scan: str = "scan_id"
) -> DataFrame:
    """Windows of a scan back to one volume.

    Overlaps are averaged (``mean``), weighted towards window centres (``gaussian``) or
    just added (``sum``). A group is the fixed set of windows of one scan.
    """
    if mode not in ("mean", "gaussian", "sum"):
        raise ValueError(f"unknown mode {mode!r}")
    merge = kernels.merge_windows(
        shape, window, window_grid(shape, window, overlap), window_weights(window, mode), mode != "sum"
    )
    packed = tiles.groupBy(scan).agg(F.sort_array(F.collect_list(F.struct("tile", "vals"))).alias("_rows"))
    return packed.select(scan, merge(F.col("_rows.vals")).alias("image"))


# --- views ---------------------------------------------------------------------------

def extract_view(
    df: DataFrame, shape: Shape, view: str, index: int | None = None, image: str = "image", element: str = "float"
) -> DataFrame:
    """``plane``: rows of one slice in display orientation."""
    return df.withColumn("plane", kernels.view_slice(shape, view, index, element)(F.col(image)))


def view_patch(view: str, patch: Shape) -> tuple[int, int]:
    """Patch size in rows and columns of a view."""
    x, y, z = patch
    sizes = {"sagittal": (z, y), "axial": (y, x), "coronal": (z, x)}
    if view not in sizes:
        raise ValueError(f"unknown view {view!r}")
    return sizes[view]


def intensity_limits(df: DataFrame, image: str = "image", mask: str = "mask") -> DataFrame:
    """``vmin`` and ``vmax`` for display; scans may differ in size."""
    limits = df.withColumn("_limits", kernels.intensity_limits()(F.col(image), F.col(mask)))
    return limits.withColumns({"vmin": F.col("_limits")[0], "vmax": F.col("_limits")[1]}).drop("_limits")


def content_crop(df: DataFrame, patch: Sequence[int], plane: str = "plane") -> DataFrame:
    """``row0 row1 col0 col1`` of the content in a plane of flags."""
    box = df.withColumn("_box", kernels.content_crop(patch)(F.col(plane)))
    names = ("row0", "row1", "col0", "col1")
    return box.withColumns({name: F.col("_box")[i] for i, name in enumerate(names)}).drop("_box")


def composite(df: DataFrame, cells: int, target: str, pred: str, pred_mask: str, element: str = "float") -> DataFrame:
    """Prediction where it was asked for, target elsewhere."""
    return df.withColumn("composite", kernels.choose(cells, element)(F.col(pred_mask), F.col(pred), F.col(target)))


def masked_input_display(
    df: DataFrame, cells: int, image: str, pred_mask: str, mask: str, fill: float, element: str = "float"
) -> DataFrame:
    """What the model saw: a constant where it predicts and outside the mask."""
    seen = kernels.combine_flags(cells, "and_not")(F.col(mask), F.col(pred_mask))
    return df.withColumn("display", kernels.fill_outside(cells, fill, element)(seen, F.col(image)))
