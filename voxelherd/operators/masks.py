"""Patch masks: validity, batch-wide quotas, random, block and hybrid masking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelherd.functions import kernels
from voxelherd.functions.columns import hash_int, hash_order
from voxelherd.session import materialize


def count_set(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x))


def add_valid(df: DataFrame, shape: Sequence[int], patch: Sequence[int], mask: str = "mask") -> DataFrame:
    """``valid``: one flag per patch, true when any of its voxels is in the mask."""
    return df.withColumn("valid", kernels.any_per_patch(shape, patch)(F.col(mask)))


def kept_of(ratio: float, count: Column) -> Column:
    """``(1 - ratio)`` of a count, rounded down; the share is that of the ratio as written.

    ``1 - 0.8`` in doubles is below 0.2, and a fifth of 5 patches would round down to none.
    """
    return F.floor(F.lit(float(1 - Decimal(str(ratio)))) * count).cast("int")


def add_quota(df: DataFrame, ratio: float, flags: str = "valid", batch: str = "batch") -> DataFrame:
    """``num_keep`` of the batch: ``(1 - ratio)`` of its smallest count, rounded down.

    Only a batch number and a count per scan take part in the aggregation. The quotas are
    written out before the join, so that a batch with very many scans can be split. Scans
    without a batch are one batch.
    """
    counted = df.withColumn("_n", count_set(F.col(flags)))
    quota = counted.groupBy(batch).agg(F.min("_n").alias("_min")).select(
        F.col(batch).alias("_batch"), kept_of(ratio, F.col("_min")).alias("num_keep")
    )
    same = F.col(batch).eqNullSafe(F.col("_batch"))
    return counted.drop("_n").join(materialize(quota), same).drop("_batch")


def keep_quota(
    flags: Column, num_keep: Column, scan: Column, seed: int, shuffle: bool = True
) -> Column:
    """Flags with only ``num_keep`` of the set ones left: hashed at random, or the first.

    Patches are sorted by their draw, those not set last; the first ones are marked by
    their place; sorting by patch restores the order. Each patch is hashed once.
    """

    def ticket(on: Column, i: Column) -> Column:
        draw = hash_order(scan, i, seed) if shuffle else F.lit("")
        off = ~F.coalesce(on, F.lit(False))
        return F.struct(off.alias("off"), F.when(~off, draw).alias("draw"), i.cast("int").alias("patch"))

    def mark(drawn: Column, place: Column) -> Column:
        kept = ~drawn["off"] & F.coalesce(place < num_keep, F.lit(False))
        return F.struct(drawn["patch"].alias("patch"), kept.alias("kept"))

    marked = F.transform(F.array_sort(F.transform(flags, ticket)), mark)
    return F.transform(F.array_sort(marked), lambda m: m["kept"])


def random_mask(
    df: DataFrame, ratio: float, seed: int, scan: str = "scan_id", batch: str = "batch", shuffle: bool = True
) -> DataFrame:
    """``visible``: the batch quota of valid patches, at random or in patch order."""
    sized = add_quota(df, ratio, "valid", batch)
    visible = keep_quota(F.col("valid"), F.col("num_keep"), F.col(scan), seed, shuffle)
    return sized.withColumn("visible", visible)


def block_mask(
    df: DataFrame,
    ratio: float,
    seed: int,
    grid: Sequence[int],
    block: Sequence[int] = (2, 2, 2),
    attempts: int = 1000,
    random_fraction: float = 0.0,
    block_fraction: float = 1.0,
    scan: str = "scan_id",
    batch: str = "batch",
) -> DataFrame:
    """``visible``: valid patches left after masking random blocks down to the quota.

    With a ``random_fraction`` that share (rounded half to even) is masked singly after
    the blocks. Draws depend on the seed and the scan only.
    """
    if random_fraction < 0 or block_fraction < 0 or random_fraction + block_fraction <= 0:
        raise ValueError("fractions must not be negative and not both be zero")
    share = random_fraction / (random_fraction + block_fraction)
    sized = add_quota(df, ratio, "valid", batch)
    masked = count_set(F.col("valid")) - F.col("num_keep")
    single = F.rint(masked * F.lit(share)).cast("int")
    draw = kernels.block_mask(grid, block, attempts)(
        F.col("valid"), masked - single, single, hash_int(seed, F.col(scan))
    )
    drawn = sized.withColumn("masked", draw)
    visible = F.zip_with("valid", "masked", lambda v, m: v & ~m)
    return drawn.withColumn("visible", visible)


def hybrid_mask(df: DataFrame, ratio: float, seed: int, grid: Sequence[int], random_fraction: float = 0.5,
                block_fraction: float = 0.5, **options) -> DataFrame:
    """Block masking for one share of the masked patches, single patches for the rest."""
    return block_mask(
        df, ratio, seed, grid, random_fraction=random_fraction, block_fraction=block_fraction, **options
    )


def _random(df: DataFrame, ratio: float, seed: int, grid: Sequence[int], **options) -> DataFrame:
    return random_mask(df, ratio, seed, **options)


MASKINGS: dict[str, Callable[..., DataFrame]] = {"block": block_mask, "hybrid": hybrid_mask, "random": _random}


def apply_masking(name: str, df: DataFrame, ratio: float, seed: int, grid: Sequence[int], **options) -> DataFrame:
    """Masking by name; register another function in ``MASKINGS`` to extend."""
    if name not in MASKINGS:
        raise ValueError(f"unknown masking {name!r}, expected one of {sorted(MASKINGS)}")
    return MASKINGS[name](df, ratio, seed, grid, **options)


def select_pred_patches(
    df: DataFrame,
    shape: Sequence[int],
    patch: Sequence[int],
    ratio: float,
    seed: int,
    mask: str = "mask",
    visible_mask: str = "visible_mask",
    scan: str = "scan_id",
    batch: str = "batch",
) -> DataFrame:
    """``pred``: patches to predict, among those with a valid voxel that is not visible.

    Trimmed at random to the smallest number of candidates in the batch.
    """
    cells = shape[0] * shape[1] * shape[2]
    hidden = kernels.combine_flags(cells, "and_not")(F.col(mask), F.col(visible_mask))
    marked = df.withColumn("candidate", kernels.any_per_patch(shape, patch)(hidden))
    sized = add_quota(marked, ratio, "candidate", batch)
    pred = keep_quota(F.col("candidate"), F.col("num_keep"), F.col(scan), seed)
    return sized.withColumn("pred", pred)


def mask_stats(df: DataFrame, ratio: float, batch: str = "batch") -> DataFrame:
    """Valid patches per batch, mean and smallest, and how many stay visible."""
    counted = df.select(batch, count_set(F.col("valid")).alias("_n"))
    return counted.groupBy(batch).agg(
        F.avg("_n").alias("valid_mean"),
        F.min("_n").alias("valid_min"),
        kept_of(ratio, F.min("_n")).alias("visible"),
    )
