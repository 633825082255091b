"""Image files as a data source: only what a query asks for is listed, opened and decoded.

``spark.read.format("voxelherd_images").schema(…).load(root)`` gives one row per image file.
The schema names the wanted columns: with path, size, modified, dataset and suffix alone no file
is opened. Filters on dataset, suffix, size and the beginning of the path are pushed into
the listing; a filter on the dataset lists its folders only. Partitions are planned by
bytes, so a task opens about as many bytes as another, however many files these are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from voxelherd.session import ship_package
from voxelherd.sources.images import CHUNK_BYTES, HEADER_SCHEMA, HeadReader, decode_heads

LISTED = "path string, size bigint, modified timestamp, dataset string, suffix string"
SCHEMA = f"{LISTED}, md5 string, {HEADER_SCHEMA}"
LISTED_NAMES = ("path", "size", "modified", "dataset", "suffix")

# Bytes and files of one partition.
PARTITION_BYTES = 256 * 1024 * 1024
PARTITION_FILES = 10_000
ROWS_AT_ONCE = 64


def names_of(path: str) -> tuple[str, str]:
    """Dataset and suffix of a path below the root."""
    stem = path.rsplit("/", 1)[-1].split(".", 1)[0]
    return path.split("/", 1)[0], stem.rsplit("_", 1)[-1]


def is_image(path: str) -> bool:
    """The rules of ``filter_listing`` and of Spark's readers for hidden folders."""
    *folders, name = path.split("/")
    return ".nii" in name and name[0] not in "._" and "bidsignore" not in path and not any(f[:1] in ("_", ".") for f in folders)


@dataclass
class Files(api.InputPartition):
    """Files of one partition: (path, size, modified in microseconds)."""

    files: list[tuple[str, int, int]]


class ImageReader(api.DataSourceReader):
    def __init__(self, root: str, schema: StructType, partition_bytes: int) -> None:
        self.root, self.schema, self.partition_bytes = root.rstrip("/"), schema, partition_bytes
        self.tests: list[tuple[str, str, object]] = []
        self.datasets: set[str] | None = None

    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:
        for one in filters:
            column = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            kind = type(one)
            if column in ("dataset", "suffix") and kind in (api.EqualTo, api.In):
                values = set(one.value) if kind is api.In else {one.value}
                self.tests.append((column, "in", values))
                if column == "dataset":
                    self.datasets = values if self.datasets is None else self.datasets & values
            elif column == "size" and kind in (api.GreaterThan, api.GreaterThanOrEqual, api.LessThan, api.LessThanOrEqual):
                self.tests.append((column, kind.__name__, one.value))
            elif column == "path" and kind is api.StringStartsWith:
                self.tests.append((column, "starts", one.value))
            elif kind is not api.IsNotNull or column not in LISTED_NAMES:
                yield one

    def _passes(self, row: dict) -> bool:
        for column, test, value in self.tests:
            own = row[column]
            ok = {
                "in": lambda: own in value, "starts": lambda: own.startswith(value),
                "GreaterThan": lambda: own > value, "GreaterThanOrEqual": lambda: own >= value,
                "LessThan": lambda: own < value, "LessThanOrEqual": lambda: own <= value,
            }[test]()
            if not ok:
                return False
        return True

    def listing(self) -> Iterator[tuple[str, int, int]]:
        """Files that pass the pushed filters, with path below the root."""
        store, base = fs.FileSystem.from_uri(self.root)
        top = store.get_file_info(fs.FileSelector(base))
        for entry in top:
            folder = entry.path[len(base) + 1 :]
            if self.datasets is not None and folder not in self.datasets:
                continue
            below = store.get_file_info(fs.FileSelector(entry.path, recursive=True)) if entry.type == fs.FileType.Directory else [entry]
            for info in below:
                path = info.path[len(base) + 1 :]
                if info.type != fs.FileType.File or not is_image(path):
                    continue
                dataset, suffix = names_of(path)
                if self._passes({"path": path, "size": info.size, "dataset": dataset, "suffix": suffix}):
                    yield path, info.size, info.mtime_ns // 1000

    def partitions(self) -> Sequence[Files]:
        opened = any(name not in LISTED_NAMES for name in self.schema.names)
        out, part, size = [], [], 0
        for file in sorted(self.listing()):
            if part and (len(part) >= PARTITION_FILES or opened and size + file[1] > self.partition_bytes):
                out.append(Files(part))
                part, size = [], 0
            part.append(file)
            size += file[1]
        return [*out, Files(part)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        wanted = self.schema.names
        arrow = to_arrow_schema(self.schema)
        store, base = fs.FileSystem.from_uri(self.root)
        for at in range(0, len(partition.files), ROWS_AT_ONCE):
            files = partition.files[at : at + ROWS_AT_ONCE]
            rows = pd.DataFrame(files, columns=["path", "size", "modified"])
            rows["modified"] = pd.to_datetime(rows["modified"], unit="us", utc=True)
            rows[["dataset", "suffix"]] = [names_of(path) for path in rows["path"]]
            if any(name not in LISTED_NAMES for name in wanted):
                rows = pd.concat([rows, self._contents(store, base, rows["path"].tolist())], axis=1)
            yield pa.RecordBatch.from_pandas(rows[wanted], schema=arrow, preserve_index=False)

    def _contents(self, store: fs.FileSystem, base: str, paths: list[str]) -> pd.DataFrame:
        """Hash and header of files, each read once in pieces; without the hash only as far as the header."""
        whole = "md5" in self.schema.names
        heads, hashes, errors = [], [], []
        for path in paths:
            digest, reader, error = hashlib.md5(), HeadReader(), None
            try:
                with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    while piece := stream.read(CHUNK_BYTES if whole else 4096):
                        digest.update(piece)
                        reader.feed(piece)
                        if not whole and reader.complete():
                            break
            except OSError as problem:
                error = f"cannot be read: {type(problem).__name__}"
            heads.append(reader.result())
            hashes.append(None if error else digest.hexdigest())
            errors.append(error)
        fields = decode_heads(heads)
        failed = pd.Series(errors, dtype=object)
        fields["reason"] = failed.where(failed.notna(), fields["reason"])
        fields.insert(0, "md5", hashes)
        return fields


class ImageSource(api.DataSource):
    """Options: ``path``, and ``partition_bytes`` for files that are opened."""

    @classmethod
    def name(cls) -> str:
        return "voxelherd_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(self.options["path"], schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))


def scan_images(
    spark: SparkSession, root: str, columns: Sequence[str] = LISTED_NAMES, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """The named columns of the image files below ``root``; filters on them reach the listing."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageSource)
    every = _parse_datatype_string(SCHEMA)
    schema = StructType([every[name] for name in columns])
    reader = spark.read.format(ImageSource.name()).schema(schema).option("partition_bytes", str(partition_bytes))
    return reader.load(root)
