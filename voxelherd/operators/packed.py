"""Volumes as raw bytes: patches, masks and normalization without lists of numbers.

A packed volume is a row with ``image`` (little-endian values in C order), ``element`` (their
type), ``shape``, and optionally ``mask`` (a byte per voxel). Parquet, Spark and Arrow
move such a row as one value; lists of ten million numbers they would handle one by one.
Patches are packed as well, so they go from the volume to rows without becoming lists.
Volumes of one table may differ in shape. ``pack_volumes`` and ``unpack_values`` lead from
lists to bytes and back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from voxelherd.functions.kernels import _from_patches, _to_patches, check_patch

# Element types of packed values.
DTYPES = {
    "float": np.dtype("<f4"), "double": np.dtype("<f8"), "tinyint": np.dtype("i1"), "smallint": np.dtype("<i2"),
    "int": np.dtype("<i4"), "bigint": np.dtype("<i8"), "boolean": np.dtype("bool"),
}
# Axes over which a mean is taken, of an array (slab, patch of the slab, voxel of the patch).
UNITS = {"global": (0, 1, 2), "slice": (1, 2), "patch": (2,)}


def _dtype(element: str) -> np.dtype:
    if element not in DTYPES:
        raise ValueError(f"unknown element type {element!r}")
    return DTYPES[element]


def _rows_of_bytes(values: np.ndarray) -> pa.Array:
    """Binary column over the memory of a two-dimensional array, a value per row."""
    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize
    if len(values) * width >= 1 << 31:
        return pa.array([row.tobytes() for row in values], pa.binary())
    offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _volume(raw: pa.Scalar, dtype: np.dtype, shape: Sequence[int], what: str) -> np.ndarray:
    buffer = raw.as_buffer()
    if buffer is None:
        raise ValueError(f"{what} is null in some rows")
    if buffer.size != prod(shape) * dtype.itemsize:
        raise ValueError(f"{what} has {buffer.size} bytes, not {prod(shape)} values of {dtype.itemsize}")
    return np.frombuffer(buffer, dtype).reshape(shape)


def pack_values(element: str):
    """List column to the bytes of its values; null stays null."""
    dtype = _dtype(element)

    @F.arrow_udf("binary")
    def kernel(lists: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(dtype).tobytes() for x in lists], pa.binary())

    return kernel


def unpack_values(element: str):
    """Bytes back to a list column; null stays null."""
    dtype = _dtype(element)

    @F.arrow_udf(f"array<{element}>")
    def kernel(raw: pa.Array) -> pa.Array:
        kind = pa.list_(pa.from_numpy_dtype(dtype))
        return pa.array([np.frombuffer(x.as_buffer(), dtype) if x.is_valid else None for x in raw], kind)

    return kernel


def pack_volumes(
    df: DataFrame, shape: Sequence[int], image: str = "image", mask: str | None = "mask", element: str = "float"
) -> DataFrame:
    """List volumes of one shape as packed volumes; a table is packed once, then read many times."""
    found = {image: pack_values(element)(F.col(image)), "element": F.lit(element), "shape": F.array(*[F.lit(int(n)) for n in shape])}
    if mask:
        found[mask] = pack_values("boolean")(F.col(mask))
    return df.withColumns(found)


def _schema(df: DataFrame, scan: str, rest: str) -> StructType:
    return StructType([df.schema[scan], *_parse_datatype_string(rest)])


def patchify(
    df: DataFrame, patch: Sequence[int], image: str = "image", scan: str = "scan_id", stride: int = 1,
    mask: str | None = None, keep: str | None = None,
) -> DataFrame:
    """One row per patch: scan, ``patch_id`` in C order of the grid, ``vals`` as bytes.

    ``mask`` names a mask cut alongside into ``observed``; ``keep`` a list of one flag per
    patch, of which only flagged patches become rows. ``stride`` keeps every n-th slice of
    the first axis. Map only: the patches of a volume are a view of it, copied once.
    """
    named = {"raw": image, "element": "element", "shape": "shape"} | ({"mask": mask} if mask else {}) | ({"keep": keep} if keep else {})
    narrow = df.select(scan, *[F.col(column).alias(f"_{name}") for name, column in named.items()])
    out = _schema(df, scan, "patch_id int, vals binary" + (", observed binary" if mask else ""))

    def cut(volume: np.ndarray) -> np.ndarray:
        if volume.shape[0] % stride or patch[0] % stride:
            raise ValueError(f"stride {stride} does not divide {volume.shape[0]} and {patch[0]}")
        thin = (patch[0] // stride, *patch[1:])
        grid = check_patch((volume.shape[0] // stride, *volume.shape[1:]), thin)
        return _to_patches(volume[None, None, ::stride], grid, thin)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = batch.select(["_element", "_shape", *(["_keep"] if keep else [])]).to_pylist()
            for i, row in enumerate(small):
                shape = row["_shape"]
                parts = [cut(_volume(batch.column("_raw")[i], _dtype(row["_element"]), shape, image))]
                if mask:
                    parts.append(cut(_volume(batch.column("_mask")[i], DTYPES["boolean"], shape, mask)))
                ids = np.arange(len(parts[0]), dtype=np.int32)
                if keep:
                    chosen = np.array(row["_keep"], dtype=bool)
                    if len(chosen) != len(ids):
                        raise ValueError(f"{keep} has {len(chosen)} flags for {len(ids)} patches")
                    ids, parts = ids[chosen], [part[chosen] for part in parts]
                owner = batch.column(scan).take(pa.array(np.full(len(ids), i, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([owner, pa.array(ids), *map(_rows_of_bytes, parts)], names=out.names)

    return narrow.mapInArrow(run, out)


def unpatchify(
    patches: DataFrame, shape: Sequence[int], patch: Sequence[int], scan: str = "scan_id", vals: str = "vals",
    element: str = "float", fill: float | None = None,
) -> DataFrame:
    """Patch rows back to packed volumes of one shape; missing patches are an error, or hold ``fill``.

    A scan has a fixed number of patches, so a group is one volume.
    """
    grid, dtype = check_patch(shape, patch), _dtype(element)
    total, width = prod(grid), prod(patch)

    @F.arrow_udf("binary")
    def join(ids: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for own, pieces in zip(ids, parts):
            places = own.values.to_numpy(zero_copy_only=False)
            if len(np.unique(places)) != len(places):
                raise ValueError("a scan repeats a patch")
            if fill is None and len(places) != total:
                raise ValueError("a scan lacks patches")
            volume = np.full((total, width), 0 if fill is None else fill, dtype)
            for place, piece in zip(places, pieces.values):
                volume[place] = _volume(piece, dtype, (width,), vals)
            out.append(_from_patches(volume[None], grid, patch, 1).astype(dtype).tobytes())
        return pa.array(out, pa.binary())

    rows = patches.groupBy(scan).agg(F.collect_list(F.struct("patch_id", F.col(vals).alias("v"))).alias("_rows"))
    return rows.select(
        scan, join(F.col("_rows")["patch_id"], F.col("_rows")["v"]).alias("image"), F.lit(element).alias("element"),
        F.array(*[F.lit(int(n)) for n in shape]).alias("shape"),
    )


def masked_normalize(
    df: DataFrame, patch: Sequence[int], level: str = "patch", image: str = "image", mask: str | None = "mask",
    scan: str = "scan_id", element: str = "float", eps: float = 1e-6,
) -> DataFrame:
    """Packed volumes of zero mean and unit deviation over valid voxels, with ``mean`` and ``std`` per unit.

    ``level`` is global, slice (a slab of patches) or patch. Voxels outside the mask are
    zero; without a mask every voxel counts; a unit without valid voxels counts as having
    one. Sums are in double precision whatever the element type.
    """
    if level not in UNITS:
        raise ValueError(f"unknown level {level!r}")
    over, dtype = UNITS[level], _dtype(element)
    named = {"raw": image, "element": "element", "shape": "shape"} | ({"mask": mask} if mask else {})
    narrow = df.select(scan, *[F.col(column).alias(f"_{name}") for name, column in named.items()])
    out = _schema(df, scan, "image binary, element string, shape array<int>, mean array<double>, std array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = batch.select(["_element", "_shape"]).to_pylist()
            for i, row in enumerate(small):
                shape = row["_shape"]
                grid = check_patch(shape, patch)

                def cut(volume: np.ndarray) -> np.ndarray:
                    return _to_patches(volume[None, None], grid, patch)[0].reshape(grid[0], grid[1] * grid[2], prod(patch))

                x = cut(_volume(batch.column("_raw")[i], _dtype(row["_element"]), shape, image)).astype(dtype, copy=False)
                m = cut(_volume(batch.column("_mask")[i], DTYPES["boolean"], shape, mask)) if mask else None
                n = np.maximum(m.sum(axis=over, keepdims=True), 1) if mask else np.float64(np.prod([x.shape[a] for a in over]))
                mean = (np.where(m, x, 0) if mask else x).sum(axis=over, keepdims=True, dtype=np.float64) / n
                z = x - mean.astype(dtype)
                if mask:
                    z *= m
                std = np.sqrt(np.square(z).sum(axis=over, keepdims=True, dtype=np.float64) / n + eps)
                z /= std.astype(dtype)
                volume = _from_patches(z.reshape(1, prod(grid), -1), grid, patch, 1).reshape(1, -1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(scan).slice(i, 1), _rows_of_bytes(volume), pa.array([element]), pa.array([shape], pa.list_(pa.int32())),
                    pa.array([mean.ravel().tolist()]), pa.array([std.ravel().tolist()]),
                ], names=out.names)

    return narrow.mapInArrow(run, out)


def add_valid(df: DataFrame, patch: Sequence[int], mask: str = "mask") -> DataFrame:
    """Add ``valid``, one flag per patch: any voxel of the mask is set."""

    @F.arrow_udf("array<boolean>")
    def flags(raw: pa.Array, shapes: pa.Array) -> pa.Array:
        out = []
        for value, shape in zip(raw, shapes.to_pylist()):
            volume = _volume(value, DTYPES["boolean"], shape, mask)
            out.append(_to_patches(volume[None, None], check_patch(shape, patch), patch)[0].any(axis=1))
        return pa.array(out, pa.list_(pa.bool_()))

    return df.withColumn("valid", flags(F.col(mask), F.col("shape")))
