"""The packaging plan: pair, validate, shard, and batch scans for training."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from voxelherd.operators import packaging as p
from voxelherd.operators.quality import fail_on_rejects
from voxelherd.operators.volumes import augment


@dataclass
class Package:
    records: DataFrame
    shards: DataFrame
    report: DataFrame


def package(
    images: DataFrame,
    masks: DataFrame,
    metadata: DataFrame,
    allow_unmatched: bool = False,
    check_shapes: bool = True,
    maxsize: int = p.DEFAULT_SHARD_BYTES,
) -> Package:
    """Scan records with their shard; anything missing or mismatched is an error.

    ``images`` has key, id_event, modality, shape, bytes; ``masks`` key and mask_shape.
    Only these small columns move; voxels are read when the shards are written.
    """
    records = p.collect_records(images, masks, metadata, allow_unmatched)
    if check_shapes:
        fail_on_rejects(p.shape_mismatch(records).select("key", "shape", "mask_shape"))
    shards = p.plan_shards(records.select("key", "bytes"), ["key"], "bytes", maxsize).select("key", "shard")
    return Package(records, records.join(shards, on="key"), p.record_report(records))


def batches(
    samples: DataFrame,
    key: str,
    shape: Sequence[int],
    seed: int,
    epoch: int,
    train: bool,
    columns: Sequence[str] = ("image", "mask"),
    meta: Sequence[str] = (),
    augmentation: dict | None = None,
    **plan,
) -> DataFrame:
    """The rows of the batches of an epoch, batch by batch.

    Training batches are shuffled, augmented anew each epoch and carry no metadata;
    evaluation batches are in order, complete, as stored, with their metadata.
    """
    order = p.epoch_plan(samples, key, seed, epoch, shuffle=train, drop_last=train, **plan)
    if not train:
        return p.collate(order, samples, key, columns, keep_meta=meta)
    changed = augment(samples.withColumnRenamed(key, "scan_id"), shape, seed * 100_003 + epoch, **(augmentation or {}))
    return p.collate(order, changed.withColumnRenamed("scan_id", key), key, columns)
