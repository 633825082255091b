"""Reading tables and preparing the session for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.session import ship_package

# Texts are read in batches of bounded size, whatever the length of a row.
ARROW_BYTES = 4 * 1024 * 1024


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and bound the size of Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system. A worker serves one task after the other, of any stage, and else keeps it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A task's function over batches that gives back memory when it ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.encode(F.col(column), "UTF-8"), F.lit(b""))


def parts_for(rows: int, per_part: int) -> int:
    """How many parts hold ``rows`` rows at ``per_part`` rows each, at least one."""
    return max(1, math.ceil(rows / per_part))
