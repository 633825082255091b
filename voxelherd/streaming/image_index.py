"""Continuous image index: new files become index rows, each exactly once.

The index knows every content it has seen: a keyed state per content hash lets the first
file stay and marks later ones as duplicates when they arrive, so nothing that was written
before is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelherd.functions.columns import bids_fields
from voxelherd.sources.images import read_headers, relative_to

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def image_files(spark: SparkSession, root: str, pattern: str = "*.nii*", max_files: int = 1000) -> DataFrame:
    """Stream of the files below ``root``: path below it, size and content."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    return files.select(relative_to(F.col("path"), root).alias("path"), F.col("length").alias("size"), "content")


def mark_duplicates(rows: DataFrame) -> DataFrame:
    """Add ``duplicate`` to a stream with ``path`` and ``md5``: an earlier row has this content.

    Rows of one micro-batch are in order of their paths. A row without a hash is no
    duplicate. The other columns travel as one text.
    """
    packed = rows.select(
        "path", F.coalesce(F.concat(F.lit("m"), F.col("md5")), F.concat(F.lit("p"), F.col("path"))).alias("content_key"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"),
    )

    def mark(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames)).sort_values("path", kind="stable")
        duplicate = [True] * len(new)
        if not state.exists:
            state.update((True,))
            duplicate[0] = False
        yield pd.DataFrame({"row": new["row"].to_numpy(), "duplicate": duplicate})

    marked = packed.groupBy("content_key").applyInPandasWithState(
        mark, "row string, duplicate boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout
    )
    return marked.select(F.from_json("row", rows.schema).alias("row"), "duplicate").select("row.*", "duplicate")


def start_index(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Index a stream of files (path, size, content) that has arrived, and stop.

    Rows have the fields of the batch index: path, size, hash, dataset, entities, suffix
    and header fields; ``reason`` is set where a path or header is unusable, ``duplicate``
    where an earlier file has the same content. A micro-batch writes its own folder and
    replaces it when it is repeated after a failure, so the sink never holds a file twice.
    """
    decoded = read_headers(files.select("path", "size", F.md5("content").alias("md5"), "content"))
    named = decoded.withColumn("_f", bids_fields(F.col("path")))
    rows = named.select(
        "path", "size", "md5", "_f.dataset", "_f.entities", "_f.suffix",
        "shape", "pixdim", "dtype", "orient", "qform_code", "sform_code", "descrip",
        F.coalesce("_f.reason", "reason").alias("reason"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        mark_duplicates(rows)
        .writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_image_index(
    spark: SparkSession, root: str, out: str, checkpoint: str, pattern: str = "*.nii*", max_files: int = 1000
) -> StreamingQuery:
    """Index what has arrived below ``root`` and stop; run again to pick up new files."""
    return start_index(image_files(spark, root, pattern, max_files), out, checkpoint)


def read_image_index(spark: SparkSession, out: str) -> DataFrame:
    """Index so far; ``duplicate`` marks content that an earlier file already has."""
    return spark.read.parquet(out)
