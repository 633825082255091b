"""Shard archives as a data source with two-phase commit.

Every attempt of a task writes its archives under names of its own in a folder of the job.
What an attempt has finished is told by its commit message. Only the driver moves archives
to their names, once, when Spark has chosen one attempt of every task; attempts that failed,
were repeated or ran twice leave nothing. If the job fails, its folder is deleted and the
shards of an earlier run stay as they were.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SAMPLE_SCHEMA = "name string, key string, image array<float>, mask array<tinyint>, shape array<int>, meta string"


@dataclass
class Written(WriterCommitMessage):
    """Archives that one attempt has finished: (name, where it lies, samples, bytes)."""

    shards: list[tuple[str, str, int, int]]


def _npy(values: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.save(buffer, values)
    return buffer.getvalue()


def _add(tar: tarfile.TarFile, name: str, data: bytes) -> None:
    entry = tarfile.TarInfo(name)
    entry.size = len(data)
    tar.addfile(entry, io.BytesIO(data))


class ShardWriter(DataSourceArrowWriter):
    """Rows (name, key, image, mask, shape, meta), all of one archive in one task, in key order."""

    def __init__(self, root: str, overwrite: bool, manifest: str | None) -> None:
        self.root, self.overwrite, self.manifest = root, overwrite, manifest
        self.attempts = f"_attempts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.root)
        folder = f"{base}/{self.attempts}/{uuid.uuid4().hex}"
        name, tar, stream, done, count = None, None, None, [], 0

        def close() -> None:
            tar.close()
            stream.close()
            path = f"{folder}/{name}"
            done.append((name, path, count, store.get_file_info(path).size))

        for batch in iterator:
            small = batch.select(["name", "key", "shape", "meta"]).to_pylist()
            for row, image, mask in zip(small, batch.column("image"), batch.column("mask")):
                if row["name"] != name:
                    if tar is not None:
                        close()
                    name, count = row["name"], 0
                    store.create_dir(folder, recursive=True)
                    stream = store.open_output_stream(f"{folder}/{name}")
                    tar = tarfile.open(fileobj=stream, mode="w|")
                key = row["key"]
                for part, cells, kind in (("image", image, np.float32), ("mask", mask, np.uint8)):
                    values = cells.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
                    _add(tar, f"{key}.{part}.npy", _npy(values.reshape(row["shape"])))
                _add(tar, f"{key}.meta.json", json.dumps(json.loads(row["meta"])).encode())
                count += 1
        if tar is not None:
            close()
        return Written(done)

    def _existing(self, store: fs.FileSystem, base: str) -> list[str]:
        if store.get_file_info(base).type == fs.FileType.NotFound:
            return []
        return [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".tar")]

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.root)
        shards = [shard for message in messages if message is not None for shard in message.shards]
        names = [name for name, *_ in shards]
        if len(set(names)) < len(names):
            raise ValueError("the rows of a shard were in several tasks")
        before = self._existing(store, base)
        if before and not self.overwrite:
            raise FileExistsError(f"{len(before)} shards already in {self.root}")
        store.create_dir(base, recursive=True)
        present = {path.rsplit("/", 1)[1] for path in before}
        for name, path, _, _ in shards:
            if name in present:
                store.delete_file(f"{base}/{name}")
            store.move(path, f"{base}/{name}")
        for name in present.difference(names):
            store.delete_file(f"{base}/{name}")
        self._discard()
        if self.manifest:
            lines = [json.dumps({"path": f"{base}/{name}", "n_samples": n, "bytes": size}) for name, _, n, size in shards]
            target, folder = fs.FileSystem.from_uri(self.manifest)
            target.create_dir(folder, recursive=True)
            with target.open_output_stream(f"{folder}/shards.json") as out:
                out.write("\n".join(lines).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._discard()

    def _discard(self) -> None:
        store, base = fs.FileSystem.from_uri(self.root)
        if store.get_file_info(f"{base}/{self.attempts}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.attempts}")


class ShardSource(DataSource):
    """``df.write.format("voxelherd_shards").mode("append" or "overwrite").option("manifest", …).save(root)``.

    ``append`` refuses a folder that has shards. ``manifest`` names a folder for a JSON file
    with one line per shard: path, n_samples, bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "voxelherd_shards"

    def schema(self) -> str:
        return SAMPLE_SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite, self.options.get("manifest"))
