"""Image curation: geometry, inclusion rules, reports, label coverage."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelherd.functions.columns import geometry
from voxelherd.operators.ordering import dedup_first, exact_quantiles
from voxelherd.operators.quality import many_to_one
from voxelherd.session import materialize

# Image kinds that are kept.
MODALITIES = ("T1w", "T2w", "FLAIR")


@dataclass(frozen=True)
class Bounds:
    """Inclusive limits of the curated set: file size in MB, lengths in mm.

    The defaults are fixed values.
    """

    ndim: int = 3
    size_low: float = 1.0
    size_high: float = 60.0
    res_low: float = 0.3
    res_xy_high: float = 1.5
    res_z_high: float = 3.0
    fov_low: float = 120.0
    fov_high: float = 260.0


def add_geometry(df: DataFrame, shape: str = "shape", pixdim: str = "pixdim") -> DataFrame:
    return df.withColumns(geometry(F.col(shape), F.col(pixdim)))


def exclude_datasets(df: DataFrame, exclude: DataFrame | Iterable[str], on: str = "dataset") -> DataFrame:
    """Drop rows of excluded datasets.

    A plain list becomes a ``NOT IN`` filter that reaches the scan; a frame becomes an
    anti join whose strategy follows its measured size. Rows without a dataset stay.
    """
    if isinstance(exclude, DataFrame):
        return df.join(exclude.select(on), on=on, how="left_anti")
    names = list(exclude)
    return df.where(F.col(on).isNull() | ~F.col(on).isin(*names)) if names else df


def keep_modalities(df: DataFrame, modalities: Sequence[str] = MODALITIES, column: str = "suffix") -> DataFrame:
    return df.where(F.col(column).isin(*modalities))


def include_rules(bounds: Bounds = Bounds(), size: str = "size") -> dict[str, Column]:
    """Named rules over the geometry columns; a null rule counts as failed.

    Each compares a stored column with a constant, so the scan can skip row groups.
    """
    low, high = (round(mb * 1e6, 3) for mb in (bounds.size_low, bounds.size_high))
    return {
        "ndim": F.col("ndim") == bounds.ndim,
        "size_low": F.col(size) >= math.ceil(low),
        "size_high": F.col(size) <= math.floor(high),
        "res_min": F.col("res_min") >= bounds.res_low,
        "res_x": F.col("res_x") <= bounds.res_xy_high,
        "res_y": F.col("res_y") <= bounds.res_xy_high,
        "res_z": F.col("res_z") <= bounds.res_z_high,
        "fov_min": F.col("fov_min") >= bounds.fov_low,
        "fov_max": F.col("fov_max") <= bounds.fov_high,
    }


def curate_filter(df: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Rows that pass every rule."""
    return df.where(reduce(lambda a, b: a & b, include_rules(bounds).values()))


def rule_report(df: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """One row: all images, kept images, and how many each rule rejects, in one pass."""
    rules = include_rules(bounds)
    rules = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    kept = reduce(lambda a, b: a & b, rules.values())
    return df.agg(
        F.count(F.lit(1)).alias("n_images"),
        F.count_if(kept).alias("n_kept"),
        *[F.count_if(~rule).alias(f"rejected_{name}") for name, rule in rules.items()],
    )


def outlier_lists(
    df: DataFrame, size: str = "size", small: float = 100_000, big: float = 100_000_000, n: int = 10
) -> DataFrame:
    """The ``n`` smallest files below ``small`` and the ``n`` biggest above ``big``."""
    tie = F.col("path")
    low = df.where(F.col(size) < small).orderBy(F.col(size), tie).limit(n)
    high = df.where(F.col(size) > big).orderBy(F.col(size).desc(), tie).limit(n)
    return low.withColumn("kind", F.lit("small")).unionByName(high.withColumn("kind", F.lit("big")))


def non_3d(df: DataFrame) -> DataFrame:
    return df.where(F.col("ndim") != 3)


def top_rows(df: DataFrame, column: str, at_least: float, n: int = 20, tie: str = "dataset") -> DataFrame:
    """The ``n`` rows with the largest value, none below ``at_least``."""
    return df.where(F.col(column) >= at_least).orderBy(F.col(column).desc(), F.col(tie)).limit(n)


def value_counts(df: DataFrame, column: str, n: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts per non-null value, largest first, ties by value; top ``n`` per ``by``."""
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("count"))
    )
    order = [F.col("count").desc(), F.col(column)]
    if n is None:
        return counts.orderBy(*by, *order)
    if not by:
        return counts.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def histogram(df: DataFrame, column: str, bins: int, clip: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Fixed-width bins between the smallest and largest (clipped) value per group.

    The last bin is closed on the right. A column with one distinct value gets a range
    of width one around it. Empty bins give no row.
    """
    value = F.col(column).cast("double")
    if clip is not None:
        value = F.least(value, F.lit(float(clip)))
    # One pass for the ranges, one for the bins; only partial aggregates are shuffled.
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(
        *by, value.alias("_value")
    )
    ranges = [F.min("_value").alias("_low"), F.max("_value").alias("_high")]
    if by:
        counts = rows.join(materialize(rows.groupBy(*by).agg(*ranges)), on=list(by))
    else:
        low, high = rows.agg(*ranges).first()
        counts = rows.withColumns({
            "_low": F.lit(low).cast("double"), "_high": F.lit(high).cast("double")
        })
    flat = F.col("_low") == F.col("_high")
    low = F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_high") - F.col("_low")) / F.lit(float(bins))
    spot = F.least(F.floor((F.col("_value") - low) / width), F.lit(bins - 1))
    return (
        counts.select(*by, spot.cast("int").alias("bin"), low.alias("_low"), width.alias("_width"))
        .groupBy(*by, "bin")
        .agg(
            (F.first("_low") + F.col("bin") * F.first("_width")).alias("bin_start"),
            F.count(F.lit(1)).alias("count"),
        )
    )


def size_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float] = (0.01, 0.05, 0.5, 0.95, 1.0),
    by: Sequence[str] = (),
    approx: bool = False,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles; ``approx`` trades exactness for a single pass."""
    if not approx:
        return exact_quantiles(df, column, probabilities, by, names)
    names = list(names or [f"p{round(p * 100):02d}" for p in probabilities])
    sketch = F.percentile_approx(column, [float(p) for p in probabilities], 10_000)
    found = df.groupBy(*by).agg(sketch.alias("_q"))
    return found.select(*by, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(names)])


def dup_report(df: DataFrame, key: str = "md5") -> DataFrame:
    """Groups of equal content: how many groups, and how many rows they hold."""
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
    )


def attach_participants(images: DataFrame, participants: DataFrame, on: Sequence[str] = ("dataset", "sub")) -> DataFrame:
    """Left join on the subject key; ``matched`` tells whether a participant row exists."""
    marked = participants.withColumn("matched", F.lit(True))
    joined = many_to_one(images, marked, on, "left", "participants")
    return joined.withColumn("matched", F.coalesce("matched", F.lit(False)))


def coverage(joined: DataFrame, sex: str = "sex", age: str = "age") -> DataFrame:
    """Label coverage of the joined images, counts and percentages, in one pass."""
    has_sex, has_age = F.col(sex).isNotNull(), F.col(age).isNotNull()

    def percent(condition: Column) -> Column:
        return F.avg(F.when(condition, 100.0).otherwise(0.0))

    return joined.agg(
        F.count(F.lit(1)).alias("n_images"),
        F.count_if("matched").alias("n_matched"),
        F.count_if(has_sex).alias("n_sex"),
        F.count_if(has_age).alias("n_age"),
        F.count_if(has_sex & has_age).alias("n_both"),
        percent(has_sex).alias("pct_sex"),
        percent(has_age).alias("pct_age"),
        percent(has_sex & has_age).alias("pct_both"),
    )


def dataset_overview(joined: DataFrame, age: str = "age", approx: bool = False) -> DataFrame:
    """Per dataset: images, subjects, labelled fraction, images per subject.

    Counted per subject first, so that a dataset holding a third of all images is
    already reduced before its rows meet.
    """
    if approx:
        per = joined.groupBy("dataset").agg(
            F.count("path").alias("n_images"),
            F.approx_count_distinct("sub").alias("n_subs"),
            F.count(age).alias("_labeled"),
            F.count(F.lit(1)).alias("_rows"),
        )
    else:
        subjects = joined.groupBy("dataset", "sub").agg(
            F.count("path").alias("_images"),
            F.count(age).alias("_labeled"),
            F.count(F.lit(1)).alias("_rows"),
        )
        per = subjects.groupBy("dataset").agg(
            F.sum("_images").alias("n_images"),
            F.count("sub").alias("n_subs"),
            F.sum("_labeled").alias("_labeled"),
            F.sum("_rows").alias("_rows"),
        )
    return per.select(
        "dataset",
        "n_images",
        "n_subs",
        (F.col("_labeled") / F.col("_rows")).alias("frac_labeled"),
        F.try_divide(F.col("n_images"), F.col("n_subs")).alias("im_per_sub"),
    )


def final_counts(df: DataFrame, modalities: Sequence[str] = MODALITIES) -> DataFrame:
    """One row: datasets, subjects, images, and images per modality.

    Nested grouping replaces several distinct counts at once, which would multiply the
    rows before the shuffle.
    """
    kinds = [F.count_if(F.col("suffix") == m).alias(m) for m in modalities]
    subjects = df.groupBy("dataset", "sub").agg(F.count(F.lit(1)).alias("images"), *kinds)
    datasets = subjects.groupBy("dataset").agg(
        F.count("sub").alias("subjects"),
        F.sum("images").alias("images"),
        *[F.sum(m).alias(m) for m in modalities],
    )
    return datasets.agg(
        F.count("dataset").alias("datasets"),
        F.coalesce(F.sum("subjects"), F.lit(0)).alias("subjects"),
        F.coalesce(F.sum("images"), F.lit(0)).alias("images"),
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in modalities],
    )


def per_dataset_age(
    labeled: DataFrame, order: Sequence[str], min_subjects: int = 50, age: str = "age"
) -> DataFrame:
    """Five-number age summary of datasets with enough subjects, one row per subject.

    The first row of a subject in ``order`` counts. Result is ordered by median age.
    """
    with_age = labeled.where(F.col(age).isNotNull())
    # Written once: the quantiles and the sizes both read it.
    subjects = materialize(dedup_first(with_age.select("dataset", "sub", age, *order), ["dataset", "sub"], order))
    summary = exact_quantiles(
        subjects, age, (0.0, 0.25, 0.5, 0.75, 1.0), ("dataset",),
        ("age_min", "age_q1", "age_median", "age_q3", "age_max"),
    )
    sizes = subjects.groupBy("dataset").agg(F.count("sub").alias("n_subs")).where(
        F.col("n_subs") >= min_subjects
    )
    return (
        summary.join(sizes, on="dataset")
        .withColumn("log_count", F.log10("n_subs"))
        .orderBy("age_median", "dataset")
    )
