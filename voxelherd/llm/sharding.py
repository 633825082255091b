"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Row numbers 0..n-1 follow a total order of the rows. A balanced Feistel network permutes
the smallest power of four that holds n; numbers that land outside 0..n-1 are sent
through again (cycle walking), which leaves a permutation of exactly 0..n-1. The place
``p`` of a row gives its shard ``p % shards`` and slot ``p // shards``, so shard sizes
differ by one at most, slots have no gaps, and both can be computed for any row number,
forward and backward, without looking at the data.

Defined results: null texts count as empty; a null key sorts first; rows that repeat the
key are ordered by text size and checksum, and rows equal in all of these are exchangeable;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from voxelherd.llm.common import text_bytes
from voxelherd.session import materialize

PRIME = 2147483647
STEP = 48271
ROUNDS = 6
# Row index within a partition, as laid out in the low bits of monotonically_increasing_id.
INDEX_BITS = 33


def round_keys(seed: int) -> list[int]:
    """One key below PRIME for each round."""
    keys, x = [], seed % PRIME
    for r in range(ROUNDS):
        x = (x * x + STEP * (r + 1) + 12345) % PRIME
        keys.append(x)
    return keys


def half_bits(n: int) -> int:
    """Bits of each half: the smallest h of 1 or more with 4**h >= n."""
    h = 1
    while 4**h < n:
        h += 1
    if h > 31:
        raise ValueError("too many rows for the round function")
    return h


def _mixed(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    t = (x + key) % PRIME
    return ((t * t % PRIME) * STEP + key) % PRIME & mask


def _network(x: np.ndarray, h: int, keys: list[int]) -> np.ndarray:
    mask = (1 << h) - 1
    left, right = x >> h, x & mask
    for key in keys:
        left, right = right, left ^ _mixed(right, key, mask)
    return left << h | right


def _network_back(x: np.ndarray, h: int, keys: list[int]) -> np.ndarray:
    mask = (1 << h) - 1
    left, right = x >> h, x & mask
    for key in reversed(keys):
        left, right = right ^ _mixed(left, key, mask), left
    return left << h | right


def _walk(x: np.ndarray, n: int, step, seed: int) -> np.ndarray:
    h, keys = half_bits(n), round_keys(seed)
    out = step(np.asarray(x, dtype=np.int64), h, keys)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = step(out[outside], h, keys)
        outside = outside[out[outside] >= n]
    return out


def place_of(row: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """Place of each row number in the shuffled order of n rows."""
    return _walk(row, n, _network, seed)


def row_of(place: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """Row number at each place: the inverse of :func:`place_of`."""
    return _walk(place, n, _network_back, seed)


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``row_no`` from 0 in the order of the given columns, over all rows.

    Rows are range partitioned and sorted; each slice numbers its rows, and the slices'
    offsets (one small row per slice, hence the broadcast) are added. A running number
    of the input splits rows that are equal in all order columns over several slices.
    """
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt")
    written = materialize(
        ranged.drop("_salt")
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_index", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << INDEX_BITS) - 1)))
    )
    sizes = written.groupBy("_slice").count().collect()
    offsets, total = [], 0
    for row in sorted(sizes):
        offsets.append((row["_slice"], total))
        total += row["count"]
    if not offsets:
        return written.select(*df.columns, F.lit(0).cast("bigint").alias("row_no"))
    steps = df.sparkSession.createDataFrame(offsets, "_slice int, _before bigint")
    joined = written.join(F.broadcast(steps), "_slice")
    return joined.select(*df.columns, (F.col("_index") + F.col("_before")).alias("row_no"))


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``size``, ``text_crc32``, ``row_no``, ``shard``, ``slot``."""
    raw = text_bytes(text)
    slim = docs.select(F.col(key), (F.length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    numbered = number_rows(slim, [key, "size", "text_crc32"])
    n = numbered.count()
    schema = StructType([*numbered.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = place_of(batch.column("row_no").to_numpy(zero_copy_only=False), n, seed)
            columns = [*batch.columns, pa.array((where % shards).astype(np.int32)), pa.array(where // shards)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "shard", "slot"])

    return numbered.mapInArrow(place, schema)
