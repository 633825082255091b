"""Epoch orders that are computed, not sorted: a keyed permutation of blocks and of their rows.

A permutation of 0 … n - 1 is made of rounds: each has a pivot, pairs every number with its
mirror image at the pivot, and a keyed bit of the larger of the two says whether the pair
changes places. Every round undoes itself, so the permutation is computed both ways, for any
n, row by row. A row's slot in an epoch needs no ordering, and the rows of a slot range are
found without looking at what came before, so a run resumes anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.operators.ordering import ordered_prefix

ROUNDS = 24
# A prime below 2**31, so that products stay within 64 bits, and two odd factors.
PRIME, FACTOR, SPREAD = 2_147_483_647, 48_271, 1_000_003


def round_keys(key: str, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two numbers per round for a text key: one for its pivot, one for its bits."""
    def draw(*parts: object) -> int:
        return int(hashlib.md5("-".join(map(str, (key, *parts))).encode()).hexdigest()[:8], 16) % PRIME

    return [(draw(r, "pivot"), draw(r, "bit")) for r in range(rounds)]


def _mix(x, k):
    """Spread a number, in whole numbers that columns and Python share."""
    y = (x + k) % PRIME
    return (y * y % PRIME * FACTOR + k) % PRIME


def permuted(value: int, n: int, key: str, tweak: int = 0, back: bool = False, rounds: int = ROUNDS) -> int:
    """Place of ``value`` in the permutation of 0 … n - 1 of this key and tweak; ``back`` inverts it."""
    for pivot, bit in round_keys(key, rounds)[:: -1 if back else 1]:
        other = (_mix(tweak, pivot) - value) % n
        if _mix(max(value, other) + tweak * SPREAD, bit) // 1024 % 2:
            value = other
    return value


def permute(value: Column, n: Column, key: str, tweak: Column | None = None, back: bool = False, rounds: int = ROUNDS) -> Column:
    """:func:`permuted` for columns: a value, the size of its range (at least 1) and a tweak.

    A batch of rows goes through each round at once.
    """
    keys = round_keys(key, rounds)[:: -1 if back else 1]

    @F.arrow_udf("bigint")
    def kernel(values: pa.Array, sizes: pa.Array, tweaks: pa.Array) -> pa.Array:
        at, size, shift = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (values, sizes, tweaks))
        for pivot, bit in keys:
            other = (_mix(shift, pivot) - at) % size
            swap = _mix(np.maximum(at, other) + shift * SPREAD, bit) // 1024 % 2 == 1
            at = np.where(swap, other, at)
        return pa.array(at)

    tweak = F.lit(0) if tweak is None else tweak
    return kernel(value.cast("bigint"), n.cast("bigint"), tweak.cast("bigint"))


def _blocks(total: int, block_size: int) -> tuple[int, int]:
    """Number of blocks, and rows of the last one."""
    count = -(-total // block_size)
    return count, total - (count - 1) * block_size


def epoch_slots(
    numbered: DataFrame, total: int, seed: int, epoch: int, block_size: int = 1000, position: str = "position",
    number: int = 0,
) -> DataFrame:
    """Add ``slot``: where each row comes in this epoch (and pass ``number`` of it). Map only.

    ``numbered`` has rows 0 … ``total`` - 1 in ``position``. Blocks of neighbouring rows are
    shuffled, and rows within their block, so a reader meets a block's files together.
    """
    if total == 0:
        return numbered.withColumn("slot", F.lit(None).cast("bigint"))
    count, last_size = _blocks(total, block_size)
    key = f"{seed}-{epoch}-{number}"
    at = F.col(position)
    block = F.floor(at / block_size)
    # The short block shifts those that come after it.
    short = permuted(count - 1, count, f"{key}-blocks")
    place = permute(block, F.lit(count).cast("bigint"), f"{key}-blocks")
    begin = place * block_size - F.when(place > short, block_size - last_size).otherwise(0)
    size = F.when(block == count - 1, last_size).otherwise(block_size).cast("bigint")
    own = permute(at % block_size, size, f"{key}-rows", block)
    return numbered.withColumn("slot", (begin + own).cast("bigint"))


def slot_rows(
    spark: SparkSession, total: int, seed: int, epoch: int, first: int, stop: int, block_size: int = 1000, number: int = 0
) -> DataFrame:
    """``slot`` and ``position`` of the slots from ``first`` up to ``stop``, without any other row."""
    count, last_size = _blocks(max(total, 1), block_size)
    key = f"{seed}-{epoch}-{number}"
    stop = min(stop, total)
    slots = spark.range(max(first, 0), max(stop, first, 0)).withColumnRenamed("id", "slot")
    short = permuted(count - 1, count, f"{key}-blocks")
    missing = block_size - last_size
    after = F.col("slot") >= short * block_size + last_size
    full = F.col("slot") + F.when(after, missing).otherwise(0)
    place = F.floor(full / block_size)
    block = permute(place, F.lit(count).cast("bigint"), f"{key}-blocks", back=True)
    placed = slots.select("slot", block.alias("_block"), (full % block_size).alias("_at"))
    size = F.when(F.col("_block") == count - 1, last_size).otherwise(block_size).cast("bigint")
    own = permute(F.col("_at"), size, f"{key}-rows", F.col("_block"), back=True)
    return placed.select("slot", (F.col("_block") * block_size + own).cast("bigint").alias("position"))


def number_samples(df: DataFrame, key: str) -> DataFrame:
    """``key`` and its ``position``; written once per table, the same for all epochs."""
    return ordered_prefix(df.select(key), [key])
