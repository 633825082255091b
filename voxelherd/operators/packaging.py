"""Packaging: pair scans with masks and metadata, plan work, splits, shards and epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelherd.functions.columns import CORE_FIELDS, hash_int, hash_order
from voxelherd.operators.ordering import dedup_first, ordered_prefix
from voxelherd.operators.quality import assert_unique, fail_on_rejects, many_to_one
from voxelherd.session import materialize

DEFAULT_SHARD_BYTES = 700 * 1024**2


# --- pairing -------------------------------------------------------------------------

def pair_image_mask(images: DataFrame, masks: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Images joined to the mask of the same key, and the images that have none.

    A key that repeats on either side is an error.
    """
    assert_unique(images, [key], "images")
    paired = many_to_one(images, masks, [key], how="inner", what="masks")
    missing = images.join(masks.select(key), on=key, how="left_anti")
    return paired, missing


def shape_mismatch(pairs: DataFrame, left: str = "shape", right: str = "mask_shape") -> DataFrame:
    """Pairs whose image and mask differ in shape (a null on one side counts)."""
    return pairs.where(~F.col(left).eqNullSafe(F.col(right)))


def join_metadata(
    scans: DataFrame,
    metadata: DataFrame,
    on: str = "id_event",
    fields: Sequence[str] = CORE_FIELDS,
    allow_unmatched: bool = False,
) -> DataFrame:
    """Scans with the event metadata of their id; ids stay text.

    Without ``allow_unmatched`` only matched scans are returned; list the others with
    :func:`unmatched_metadata`. A field the metadata lacks is null.
    """
    assert_unique(metadata, [on], "event metadata")
    lookup = metadata.select(
        on,
        *[
            F.col(name) if name in metadata.columns else F.lit(None).cast("string").alias(name)
            for name in fields
        ],
        F.lit(True).alias("matched"),
    )
    joined = scans.join(lookup, on=on, how="left" if allow_unmatched else "inner")
    return joined.withColumn("matched", F.coalesce("matched", F.lit(False)))


def unmatched_metadata(scans: DataFrame, metadata: DataFrame, on: str = "id_event") -> DataFrame:
    return scans.join(metadata.select(on), on=on, how="left_anti")


def collect_records(
    images: DataFrame, masks: DataFrame, metadata: DataFrame, allow_unmatched: bool = False
) -> DataFrame:
    """Paired, joined scan records; missing masks or metadata are an error with examples."""
    paired, missing = pair_image_mask(images, masks)
    fail_on_rejects(missing)
    if not allow_unmatched:
        fail_on_rejects(unmatched_metadata(paired, metadata))
    return join_metadata(paired, metadata, allow_unmatched=allow_unmatched)


def record_report(records: DataFrame) -> DataFrame:
    """Records and matched records per modality, and overall (null modality)."""
    per = records.groupBy("modality").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if("matched").alias("n_matched")
    )
    return per.rollup("modality").agg(
        F.sum("n_records").alias("n_records"), F.sum("n_matched").alias("n_matched")
    )


# --- work plan -----------------------------------------------------------------------

def output_names(path: Column, space: str = "MNI152NLin2009cAsym", tool: str = "synthseg") -> dict[str, Column]:
    """Names of everything derived from one scan: template space, segmentation tool."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.nii\.gz$", "")

    def derived(tail: str) -> Column:
        return F.concat(stem, F.lit(tail))

    return {
        "processed": derived(f"_space-{space}_desc-processed.nii.gz"),
        "mask": derived(f"_space-{space}_desc-brain_mask.nii.gz"),
        "transform": derived(f"_from-native_to-{space}_mode-image_xfm.mat"),
        "seg": derived(f"_desc-{tool}_dseg.nii.gz"),
        "volumes": derived("_volumes.csv"),
        "qc": derived("_qc.csv"),
    }


STAGE_OUTPUTS = {
    "registered": ("processed", "transform"),
    "segmented": ("seg", "volumes", "qc"),
    "masked": ("mask",),
}


def work_plan(scans: DataFrame, outputs: DataFrame, key: str = "key") -> DataFrame:
    """What is left to do per scan: ``register``, ``segment``, ``mask_only`` or ``done``.

    ``outputs`` lists existing files as ``(key, kind)``. A stage counts as done only when
    all of its files exist. Outputs are folded to one row per scan before the join.
    """
    have = outputs.groupBy(key).agg(
        *[
            F.max((F.col("kind") == kind).cast("int")).alias(f"_has_{kind}")
            for kinds in STAGE_OUTPUTS.values()
            for kind in kinds
        ]
    )

    def complete(stage: str) -> Column:
        present = [F.coalesce(f"_has_{kind}", F.lit(0)) for kind in STAGE_OUTPUTS[stage]]
        return F.least(*present, F.lit(1)) == 1

    joined = scans.join(have, on=key, how="left")
    status = (
        F.when(~complete("registered"), "register")
        .when(~complete("segmented"), "segment")
        .when(~complete("masked"), "mask_only")
        .otherwise("done")
    )
    return joined.select(*scans.columns, status.alias("status"))


def mark_failures(plan: DataFrame, failed: DataFrame, on: str = "key") -> DataFrame:
    """Plan rows whose ``on`` value failed get the status ``failed`` and the reason.

    With ``on`` a batch column, one failed batch marks everything pending in it; rows
    that were done stay done.
    """
    reasons = failed.groupBy(on).agg(F.min("reason").alias("reason"))
    joined = plan.join(materialize(reasons), on=on, how="left")
    lost = F.col("reason").isNotNull() & (F.col("status") != "done")
    return joined.withColumns({
        "status": F.when(lost, "failed").otherwise(F.col("status")), "reason": F.when(lost, F.col("reason"))
    })


def run_report(plan: DataFrame) -> DataFrame:
    """Scans per status."""
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n_scans"))


# --- splits --------------------------------------------------------------------------

def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """Assign folds 1..min(k, groups) so that no group spans two folds.

    Groups are dealt out by size, largest first, forward and backward in turn. Rows
    without a group are one group, so they stay and share a fold.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    placed = materialize(ordered_prefix(sizes, [F.col("_size").desc(), F.col(group)]))
    folds = max(1, min(k, placed.count()))
    lap = F.col("position") % (2 * folds)
    fold = F.when(lap < folds, lap).otherwise(2 * folds - 1 - lap) + 1
    folded = placed.select(F.col(group).alias("_group"), fold.cast("int").alias("fold"))
    return df.join(folded, F.col(group).eqNullSafe(F.col("_group"))).select(*df.columns, "fold")


def split_assign(
    subject: Column, shares: Sequence[tuple[str, int]] = (("train", 80), ("val", 10), ("test", 10)), seed: int = 0
) -> Column:
    """Split name from a hash of the subject: stable, and the same for all its rows."""
    if sum(share for _, share in shares) != 100:
        raise ValueError("shares must add up to 100")
    bucket = hash_int(seed, subject) % 100
    bound, out = 0, F
    for name, share in shares:
        bound += share
        out = out.when(bucket < bound, name)
    return out


# --- shards and epochs ---------------------------------------------------------------

def plan_shards(
    df: DataFrame, order: Sequence[str | Column], size: str, maxsize: int = DEFAULT_SHARD_BYTES
) -> DataFrame:
    """Shard number per row: rows in order, no gaps in the numbers.

    A shard closes once its bytes reach ``maxsize``, so it exceeds the limit by less
    than its last row.
    """
    placed = ordered_prefix(df, order, sums={"bytes_before": F.col(size)})
    cut = placed.withColumn("_cut", F.expr(f"bytes_before div {int(maxsize)}"))
    numbers = ordered_prefix(cut.select("_cut").distinct(), ["_cut"]).select(
        "_cut", F.col("position").alias("shard")
    )
    return cut.join(materialize(numbers), on="_cut").drop("_cut")


def shard_name(shard: Column, pattern: str = "shard-%06d.tar") -> Column:
    return F.format_string(pattern, shard)


def epoch_plan(
    df: DataFrame,
    key: str,
    seed: int,
    epoch: int,
    epoch_size: int | None = None,
    batch_size: int = 32,
    drop_last: bool = True,
    block_size: int = 1000,
    shuffle: bool = True,
    world_size: int = 1,
) -> DataFrame:
    """Order the samples of one epoch and cut them into batches.

    Samples are numbered by ``key`` and grouped into blocks; blocks are shuffled, then
    samples within a block. When ``epoch_size`` exceeds the data, further passes follow,
    each shuffled anew. Adds ``pass``, ``slot``, ``batch``, ``rank`` and ``step``.

    Blocks are put in order first, which tells where each begins; only rows of blocks
    that the epoch reaches are then ordered, each within its block.
    """
    total = df.count()
    numbered = ordered_prefix(df.select(key), [key])
    wanted = total if epoch_size is None else epoch_size
    if total == 0:
        wanted = 0
    used = (wanted // batch_size) * batch_size if drop_last else wanted
    passes = -(-wanted // total) if total else 1
    every_pass = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")
    if shuffle:
        blocks = df.sparkSession.range(-(-total // block_size)).select(F.col("id").alias("block"), every_pass)
        size = F.least(F.lit(block_size), F.lit(total) - F.col("block") * block_size)
        drawn = blocks.withColumn("_draw", hash_order(seed, epoch, F.col("pass"), "block", F.col("block")))
        placed = ordered_prefix(drawn, ["pass", "_draw", "block"], sums={"_begin": size})
        reached = materialize(placed.where(F.col("_begin") < used).select("pass", "block", "_begin"))
        rows = numbered.select(key, F.expr(f"position div {block_size}").alias("block")).join(reached, on="block")
        drawn_rows = rows.withColumn("_draw", hash_order(seed, epoch, F.col("pass"), F.col(key)))
        within = Window.partitionBy("pass", "block").orderBy("_draw", key)
        slots = drawn_rows.withColumn("slot", F.col("_begin") + F.row_number().over(within) - 1)
    else:
        slots = numbered.select(key, "position", every_pass).withColumn("slot", F.col("pass") * total + F.col("position"))
    batch = F.expr(f"slot div {batch_size}")
    return slots.where(F.col("slot") < used).select(
        key,
        "pass",
        F.col("slot").cast("bigint").alias("slot"),
        batch.cast("bigint").alias("batch"),
        (batch % world_size).cast("int").alias("rank"),
        F.expr(f"(slot div {batch_size}) div {world_size}").cast("bigint").alias("step"),
    )


def collate(plan: DataFrame, samples: DataFrame, key: str, columns: Sequence[str], keep_meta: Sequence[str] = ()) -> DataFrame:
    """The samples of each batch, one row each, in one partition and in slot order.

    A reader takes the rows of a batch as they come; volumes of a batch are never put
    into one row. ``keep_meta`` names the columns that are carried along for evaluation
    and left out for training.
    """
    fields = [key, *columns, *keep_meta]
    rows = plan.select(key, "batch", "slot").join(samples.select(*fields), on=key)
    placed = rows.repartition("batch").sortWithinPartitions("batch", "slot")
    return placed.select("batch", "slot", *fields)


def sample_example(df: DataFrame, by: Sequence[str], key: str, seed: int) -> DataFrame:
    """One reproducibly random row per group."""
    marked = df.withColumn("_draw", hash_order(seed, F.col(key)))
    return dedup_first(marked, list(by), ["_draw", key]).drop("_draw")
