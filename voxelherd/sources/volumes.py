"""Voxels of image files, and the samples that shards are made of."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.sources.images import DTYPES, FIELDS, HEADER, LONG_HEADER, _directions

# Places of the scale fields in both layouts (offset, kind), units of the header.
SCALES = {348: ((112, "f4"), (116, "f4")), 540: ((176, "f8"), (184, "f8"))}
STARTS = {348: (108, "f4"), 540: (168, "i8")}
SPACE_UNITS = {0: "unknown", 1: "meter", 2: "mm", 3: "micron"}
TIME_UNITS = {0: "unknown", 8: "sec", 16: "msec", 24: "usec"}

VOLUME_SCHEMA = "image array<float>, shape array<int>, affine array<double>, header string, reason string"
_NAMES = {field.split()[0] for field in VOLUME_SCHEMA.split(", ")}


class VolumeError(ValueError):
    """A file does not hold a usable volume."""


def _number(raw: bytes, place: tuple[int, str], order: str) -> float:
    offset, kind = place
    return np.frombuffer(raw, order + kind, 1, offset)[0].item()


def affine_of(h: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Voxel-to-world matrix: rows given, else rotation and offset, else centred on the volume."""
    out = np.eye(4)
    out[:3, :3] = _directions(h)[0]
    if h["sform"][0] > 0:
        out[:3, 3] = h["srow"][0][:, 3]
    elif h["qform"][0] > 0:
        out[:3, 3] = h["offset"][0]
    else:
        centre = [(n - 1) / 2 for n in (*shape, 1, 1, 1)[:3]]
        out[:3, 3] = -out[:3, :3] @ centre
    return out


def decode_volume(content: bytes) -> tuple[np.ndarray, np.ndarray, dict]:
    """Scaled values (float32, first axis slowest), affine and header summary of a file."""
    try:
        raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    except (OSError, EOFError, zlib.error) as problem:
        raise VolumeError("cannot be unpacked") from problem
    for layout in (HEADER, LONG_HEADER):
        for order in "<>":
            if raw[:4] == np.array(layout.itemsize, order + "i4").tobytes() and len(raw) >= layout.itemsize:
                row = np.frombuffer(raw[: layout.itemsize], layout.newbyteorder(order))
                break
        else:
            continue
        break
    else:
        raise VolumeError("not a known header")
    h = np.zeros(1, FIELDS)
    for name in FIELDS.names:
        h[name] = row[name]
    ndim, code = int(h["dim"][0, 0]), int(h["datatype"][0])
    if not 1 <= ndim <= 7 or code not in DTYPES or DTYPES[code].startswith("complex"):
        raise VolumeError("unknown shape or data type")
    shape = tuple(int(n) for n in h["dim"][0, 1 : ndim + 1])
    kind = np.dtype(DTYPES[code]).newbyteorder(order)
    start = max(int(_number(raw, STARTS[layout.itemsize], order)), layout.itemsize)
    count = int(np.prod(shape))
    if min(shape) < 1 or start + count * kind.itemsize > len(raw):
        raise VolumeError("fewer voxels than the header says")
    values = np.frombuffer(raw, kind, count, start).reshape(shape, order="F")
    slope, shift = (_number(raw, place, order) for place in SCALES[layout.itemsize])
    if np.isfinite(slope) and slope != 0 and np.isfinite(shift) and (slope, shift) != (1.0, 0.0):
        values = values.astype(np.float64) * slope + shift
    affine = affine_of(h, shape)
    units = int(h["units"][0])
    header = {
        "shape": list(shape), "zooms": [float(z) for z in h["pixdim"][0, 1 : ndim + 1]], "datatype": DTYPES[code],
        "units": [SPACE_UNITS.get(units & 7, "unknown"), TIME_UNITS.get(units & 56, "unknown")],
        "affine": affine.tolist(),
    }
    return np.ascontiguousarray(values, dtype=np.float32), affine, header


def _decoded(contents: Iterator[tuple[dict, Callable[[], bytes]]]) -> Iterator[pd.DataFrame]:
    """One row per file and batch: volumes are large."""
    for keep, load in contents:
        try:
            image, affine, header = decode_volume(load())
            found = (image.ravel(), list(image.shape), affine.ravel().tolist(), json.dumps(header), None)
        except VolumeError as problem:
            found = (None, None, None, None, str(problem))
        except OSError as problem:
            found = (None, None, None, None, f"cannot be read: {type(problem).__name__}")
        names = [field.split()[0] for field in VOLUME_SCHEMA.split(", ")]
        yield pd.DataFrame({**{k: [v] for k, v in keep.items()}, **{n: [v] for n, v in zip(names, found, strict=True)}})


def _kept(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def decode_volumes(files: DataFrame, content: str = "content") -> DataFrame:
    """Volumes of a content column: ``image``, ``shape``, ``affine``, ``header``, ``reason``."""
    keep = [c for c in files.columns if c != content]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch[keep].to_dict("records"), batch["_content"], strict=True)
            yield from _decoded((row, lambda raw=raw: bytes(raw or b"")) for row, raw in rows)

    slim = files.select(*keep, F.col(content).alias("_content"))
    return slim.mapInPandas(run, _kept(files.select(*keep)) + VOLUME_SCHEMA)


def read_volumes(paths: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Volumes of the files named by ``path`` below ``root``; each task reads its own rows' files.

    Shapes are those of the files; a file that cannot be used gets a ``reason``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root.rstrip("/"))

        def load(name: str) -> bytes:
            with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                return stream.read()

        for batch in batches:
            rows = batch.to_dict("records")
            yield from _decoded((row, lambda row=row: load(row[path])) for row in rows)

    return paths.mapInPandas(run, _kept(paths) + VOLUME_SCHEMA)


def build_samples(plan: DataFrame, root: str, fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """Samples ready for ``write_shards``, and the rejects.

    ``plan`` has shard, key, image_path, mask_path and meta (JSON text). A sample has the
    scaled image, the mask (1 where the label is above zero), their common shape, and the
    metadata with the header summary added. Shapes are compared on the arrays. With
    ``fail`` the first reject is an error when the samples are read.
    """
    images = read_volumes(plan, root, "image_path")
    both = read_volumes(images.toDF(*[f"_{c}" if c in _NAMES else c for c in images.columns]), root, "mask_path")
    reason = F.coalesce(
        F.col("_reason"), F.concat(F.lit("mask: "), F.col("reason")),
        F.when(~F.col("_shape").eqNullSafe(F.col("shape")), "image and mask differ in shape"),
    )
    text = F.when(F.trim(F.coalesce("meta", F.lit(""))).isin("", "{}"), "{").otherwise(
        F.concat(F.regexp_replace(F.trim("meta"), r"\}$", ""), F.lit(", "))
    )
    made = both.select(
        "shard", "key", F.col("_image").alias("image"),
        F.transform("image", lambda v: (v > 0).cast("tinyint")).alias("mask"), F.col("_shape").alias("shape"),
        F.concat(text, F.lit('"header": '), F.col("_header"), F.lit("}")).alias("meta"), reason.alias("reason"),
    )
    if fail:
        told = F.raise_error(F.concat(F.col("key").cast("string"), F.lit(": "), F.col("reason")))
        made = made.withColumn("reason", F.when(F.col("reason").isNotNull(), told.cast("string")))
    bad = made.where("reason IS NOT NULL").select(F.col("key").alias("path"), F.lit("sample").alias("stage"), "reason")
    return made.where("reason IS NULL").drop("reason"), bad
