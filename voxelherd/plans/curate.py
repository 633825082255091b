"""The curation plan: index to curated, de-duplicated, labelled images."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.operators import curation as c
from voxelherd.operators.ordering import dedup_first
from voxelherd.session import materialize


@dataclass
class Curated:
    images: DataFrame
    joined: DataFrame


def curate(
    images: DataFrame,
    participants: DataFrame,
    exclude: DataFrame | Sequence[str] = (),
    bounds: c.Bounds = c.Bounds(),
    order: Sequence = ("path",),
    on: Sequence[str] = ("dataset", "sub"),
    null_equal: bool = False,
) -> Curated:
    """Exclude, filter, keep the first copy of equal content, attach labels.

    Copies are dropped after the filter, so a rejected copy never hides a good one.
    Images without a hash are kept unless ``null_equal``.
    """
    kept = c.curate_filter(c.keep_modalities(c.exclude_datasets(c.add_geometry(images), exclude)), bounds)
    unique = dedup_first(kept, ["md5"], order, null_equal=null_equal)
    subjects = participants
    if "ses" in participants.columns:
        # One row per subject: the first in its file, else of the first session.
        rank = [F.col(name).asc_nulls_first() for name in ("line", "ses") if name in participants.columns]
        subjects = materialize(dedup_first(participants, list(on), rank).drop("ses", "line"))
    return Curated(unique, c.attach_participants(unique, subjects, on))
