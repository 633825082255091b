"""Image files: listing, path entities, headers, content hash, resumable index."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.functions.columns import bids_fields
from voxelherd.session import materialize

# Layout of the published 348-byte header (little endian form).
HEADER = np.dtype({
    "names": ["size", "dim", "datatype", "pixdim", "units", "descrip", "qform", "sform", "quatern", "offset", "srow"],
    "formats": ["i4", ("i2", 8), "i2", ("f4", 8), "u1", "S80", "i2", "i2", ("f4", 3), ("f4", 3), ("f4", (3, 4))],
    "offsets": [0, 40, 70, 76, 123, 148, 252, 254, 256, 268, 280],
    "itemsize": 348,
})

# Data type codes of the header.
DTYPES = {
    2: "uint8", 4: "int16", 8: "int32", 16: "float32", 32: "complex64", 64: "float64", 256: "int8",
    512: "uint16", 768: "uint32", 1024: "int64", 1280: "uint64", 1792: "complex128",
}

# Layout of the published 540-byte header (little endian form).
LONG_HEADER = np.dtype({
    "names": ["size", "dim", "datatype", "pixdim", "units", "descrip", "qform", "sform", "quatern", "offset", "srow"],
    "formats": ["i4", ("i8", 8), "i2", ("f8", 8), "i4", "S80", "i4", "i4", ("f8", 3), ("f8", 3), ("f8", (3, 4))],
    "offsets": [0, 16, 12, 104, 500, 240, 344, 348, 352, 376, 400],
    "itemsize": 540,
})

# Both layouts are decoded to the wider types.
FIELDS = np.dtype([(name, LONG_HEADER[name]) for name in LONG_HEADER.names])

# Bytes of a file in memory at a time.
CHUNK_BYTES = 1 << 20
# Files opened in one task.
TASK_FILES = 64

HEADER_SCHEMA = (
    "shape array<int>, pixdim array<double>, dtype string, orient string, qform_code int, "
    "sform_code int, descrip string, reason string"
)


def filter_listing(files: DataFrame, path: str = "path") -> DataFrame:
    """Drop hidden files and anything under an ignored path."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return files.where(name.contains(".nii") & ~name.startswith(".") & ~F.col(path).contains("bidsignore"))


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``, whatever scheme the reader reports."""
    tail = root.rstrip("/") + "/"
    return F.substring_index(path, tail, -1)


def binary_files(spark: SparkSession, root: str | list[str], pattern: str = "*.nii*") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
    )


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """All image files below ``root``: relative path, size, modification time.

    File contents are not read. Folders starting with a dot or underscore are skipped
    by the reader.
    """
    files = binary_files(spark, root).select(
        relative_to(F.col("path"), root).alias("path"), F.col("length").alias("size"), "modificationTime"
    )
    return filter_listing(files)


def parse_bids_path(df: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Add dataset, entities and suffix; paths that break a rule go to the rejects."""
    parsed = df.withColumn("_f", bids_fields(F.col(path)))
    fields = ["dataset", "entities", "suffix"]
    good = parsed.where("_f.reason IS NULL").select(*df.columns, *[F.col(f"_f.{f}").alias(f) for f in fields])
    bad = parsed.where("_f.reason IS NOT NULL").select(
        F.col(path).alias("path"), F.lit("path").alias("stage"), F.col("_f.reason").alias("reason")
    )
    return good, bad


class HeadReader:
    """Collects the first bytes of a file from its pieces, unpacked if it is a gzip file.

    Members of a gzip file follow each other, each may have extra fields of any length;
    pieces are unpacked until the header is complete, however many that takes.
    """

    def __init__(self):
        self.head, self.first, self.packed, self.broken, self.inflate = b"", b"", None, False, None

    def feed(self, piece: bytes) -> None:
        if self.packed is None:
            self.first += piece
            if len(self.first) < 2:
                return
            self.packed, piece = self.first[:2] == b"\x1f\x8b", self.first
        need = LONG_HEADER.itemsize - len(self.head)
        if not self.packed:
            self.head += piece[:need]
            return
        while piece and need > 0 and not self.broken:
            self.inflate = self.inflate or zlib.decompressobj(wbits=31)
            try:
                self.head += self.inflate.decompress(piece, need)
            except zlib.error:
                self.broken = True
                return
            need = LONG_HEADER.itemsize - len(self.head)
            piece = b""
            if self.inflate.eof:
                piece, self.inflate = self.inflate.unused_data, None

    def complete(self) -> bool:
        """Whether further pieces cannot change the header."""
        return self.broken or len(self.head) >= LONG_HEADER.itemsize

    def result(self) -> bytes:
        return self.first if self.packed is None else self.head


def head_of(content: bytes) -> bytes:
    """Header bytes of a whole file."""
    reader = HeadReader()
    reader.feed(content)
    return reader.result()


def _parse_heads(heads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fields of each header, which are too short, and which have no known layout."""
    out = np.zeros(len(heads), FIELDS)
    short = np.array([len(head) < HEADER.itemsize for head in heads], dtype=bool)
    unknown = ~short
    for layout in (HEADER, LONG_HEADER):
        for order in "<>":
            own = [i for i, head in enumerate(heads) if head[:4] == np.array(layout.itemsize, order + "i4").tobytes()]
            whole = [i for i in own if len(heads[i]) >= layout.itemsize]
            short[list(set(own) - set(whole))] = True
            unknown[own] = False
            rows = np.frombuffer(b"".join(heads[i][: layout.itemsize] for i in whole), layout.newbyteorder(order))
            for name in FIELDS.names:
                out[name][whole] = rows[name]
    return out, short, unknown


def _directions(h: np.ndarray) -> np.ndarray:
    """Voxel-to-world matrices: from the rows given, else the rotation, else the sizes."""
    zooms = h["pixdim"][:, 1:4].astype(np.float64)
    out = np.zeros((len(h), 3, 3))
    out[:, range(3), range(3)] = zooms * [-1, 1, 1]
    b, c, d = (h["quatern"][:, i].astype(np.float64) for i in range(3))
    a = np.sqrt(np.maximum(1 - b * b - c * c - d * d, 0))
    turn = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ]).transpose(2, 0, 1)
    flip = np.where(h["pixdim"][:, :1] < 0, [1.0, 1.0, -1.0], 1.0)
    rotated = h["qform"] > 0
    out[rotated] = (turn * (zooms * flip)[:, None, :])[rotated]
    given = h["sform"] > 0
    out[given] = h["srow"][given][:, :, :3]
    return out


def _orientation(matrix: np.ndarray) -> list[str]:
    """Letter per voxel axis: the world direction it is closest to, each used once."""
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(matrix / np.where(lengths == 0, 1, lengths))
    strong = s > s.max(axis=1, keepdims=True) * 3 * np.finfo(float).eps
    turn = (u * strong[:, None, :]) @ vt
    rows, letters = np.arange(len(turn)), np.full(len(turn), "", dtype="U3")
    names = np.array([["L", "R"], ["P", "A"], ["I", "S"]])
    for axis in range(3):
        column = turn[:, :, axis]
        world = np.abs(column).argmax(axis=1)
        letter = names[world, (column[rows, world] >= 0).astype(int)]
        letters = np.char.add(letters, np.where(np.abs(column).max(axis=1) < 1e-8, "", letter))
        turn[rows, world] = 0
    return letters.tolist()


def decode_headers(contents: list[bytes]) -> pd.DataFrame:
    """Header fields of many files at once; ``reason`` is set where a header is unusable."""
    return decode_heads([head_of(bytes(content or b"")) for content in contents])


def decode_heads(heads: list[bytes]) -> pd.DataFrame:
    """Header fields from the unpacked first bytes of files."""
    h, short, unknown = _parse_heads(heads)
    ndim, matrix = h["dim"][:, 0], _directions(h)
    finite = np.isfinite(matrix).all(axis=(1, 2))
    checks = [
        (short, "truncated header"), (unknown, "not a known header"),
        ((ndim < 1) | (ndim > 7), "invalid number of axes"), (~np.isin(h["datatype"], list(DTYPES)), "unknown data type"),
        (~finite, "orientation is not finite"),
    ]
    reason = np.select([failed for failed, _ in checks], [text for _, text in checks], default="").astype(object)
    good = reason == ""
    orient = _orientation(np.where(finite[:, None, None], matrix, np.eye(3)))

    def where_good(values) -> pd.Series:
        return pd.Series(list(values), dtype=object).where(good, None)

    return pd.DataFrame({
        "shape": where_good(dim[1 : n + 1].tolist() for dim, n in zip(h["dim"], ndim)),
        "pixdim": where_good([round(float(v), 2) for v in size[1 : n + 1]] for size, n in zip(h["pixdim"], ndim)),
        "dtype": where_good(DTYPES.get(int(code)) for code in h["datatype"]),
        "orient": where_good(orient),
        "qform_code": pd.array(h["qform"], dtype="Int32"),
        "sform_code": pd.array(h["sform"], dtype="Int32"),
        "descrip": where_good(bytes(text).decode("utf-8", "replace").rstrip("\x00") for text in h["descrip"]),
        "reason": pd.Series(reason).where(~good, None),
    })


def read_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """Add the header fields to files with a content column; ``reason`` tells a failure.

    For contents that are in the table; :func:`read_files` decodes files where they lie.
    """
    keep = [c for c in files.columns if c != content]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fields = decode_headers(batch.pop("_content").tolist())
            yield pd.concat([batch, fields.set_index(batch.index)], axis=1)

    heads = files.select(*keep, F.col(content).alias("_content"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)
    return heads.mapInPandas(decode, f"{kept}, {HEADER_SCHEMA}")


def content_md5(files: DataFrame, content: str = "content") -> DataFrame:
    """Add the hash of the whole file content; null content gives null."""
    return files.withColumn("md5", F.md5(F.col(content)))


def incremental_index(listing: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """Listed files that the index does not hold yet."""
    return listing.join(existing.select(path), on=path, how="left_anti")


def write_index_table(index: DataFrame, table: str, buckets: int, overwrite: bool = False) -> None:
    """Keep the index as a table bucketed by path, so that listings join it where it lies."""
    mode = "overwrite" if overwrite else "errorifexists"
    index.write.mode(mode).bucketBy(buckets, "path").sortBy("path").saveAsTable(table)


def new_files(listing: DataFrame, table: str, buckets: int) -> DataFrame:
    """Listed files that a bucketed index does not hold; only the listing is shuffled.

    ``buckets`` is the number the table was written with.
    """
    known = listing.sparkSession.table(table).select("path")
    return listing.repartition(buckets, "path").join(known.hint("merge"), on="path", how="left_anti")


def read_files(todo: DataFrame, root: str) -> DataFrame:
    """Add hash and header fields to rows with a ``path`` below ``root``.

    Exactly these files are opened, each in the task that has its row, and read once in
    pieces. A file that cannot be read gets a reason instead.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root.rstrip("/"))
        for batch in batches:
            heads, hashes, errors = [], [], []
            for path in batch["path"]:
                digest, reader, error = hashlib.md5(), HeadReader(), None
                try:
                    with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                        while piece := stream.read(CHUNK_BYTES):
                            digest.update(piece)
                            reader.feed(piece)
                except OSError as problem:
                    error = f"cannot be read: {type(problem).__name__}"
                heads.append(reader.result())
                hashes.append(None if error else digest.hexdigest())
                errors.append(error)
            fields = decode_heads(heads).set_index(batch.index)
            failed = pd.Series(errors, index=batch.index, dtype=object)
            fields["reason"] = failed.where(failed.notna(), fields["reason"])
            yield pd.concat([batch.assign(md5=hashes), fields], axis=1)

    return todo.mapInPandas(read, f"{kept}, md5 string, {HEADER_SCHEMA}")


def index_images(spark: SparkSession, root: str, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Index of the image files below ``root``, and the rejected files with the reason.

    Paths are parsed from the listing alone. Files that the existing index does not hold
    are spread over tasks and read there, once; no other file is opened.
    """
    good, bad_paths = parse_bids_path(list_images(spark, root))
    rows = good.select("path", "size", "dataset", "entities", "suffix")
    todo = materialize(rows if existing is None else incremental_index(rows, existing))
    spread = todo.repartition(max(1, -(-todo.count() // TASK_FILES)), "path")
    decoded = materialize(read_files(spread, root))
    index = decoded.where("reason IS NULL").drop("reason")
    bad_headers = decoded.where("reason IS NOT NULL").select("path", F.lit("header").alias("stage"), "reason")
    return index, bad_paths.unionByName(bad_headers)
