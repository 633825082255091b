"""Evaluation: region features, quality joins, labels, regression and ranking metrics."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelherd.functions.columns import label_in_months, wave_fields
from voxelherd.operators.ordering import ordered_prefix
from voxelherd.operators.quality import many_to_one, pivot_names
from voxelherd.session import materialize

TOTAL_REGION = "total intracranial"


# --- labels --------------------------------------------------------------------------

def label_lookup(
    scans: DataFrame,
    participants: DataFrame,
    ages: DataFrame,
    name: str = "pat_id",
    units: str = "months",
) -> tuple[DataFrame, DataFrame]:
    """Scans with the age of their participant at their wave, and rejects with a reason.

    ``participants`` has one row per ``participant_id``; ``ages`` is the long wave table
    ``(participant_id, wave, age)``.
    """
    parsed = scans.withColumn("_f", wave_fields(F.col(name))).select(
        *scans.columns, "_f.participant_id", "_f.wave", "_f.scan"
    )
    known = many_to_one(
        parsed,
        participants.select("participant_id", F.lit(True).alias("_known")),
        ["participant_id"],
        what="participants",
    )
    joined = many_to_one(known, ages.select("participant_id", "wave", "age"), ["participant_id", "wave"], what="ages")
    reason = (
        F.when(F.col("participant_id").isNull(), "name did not match")
        .when(F.col("_known").isNull(), "unknown participant")
        .when(F.col("age").isNull(), "age missing")
    )
    marked = joined.withColumn("reason", reason)
    good = marked.where("reason IS NULL").select(
        *scans.columns, "participant_id", "wave", "scan", "age",
        label_in_months(F.col("age"), units).alias("label"),
    )
    return good, marked.where("reason IS NOT NULL").select(*scans.columns, "reason")


# --- region features -----------------------------------------------------------------

def qc_filter(scans: DataFrame, qc: DataFrame, key: str, min_qc: float | None = None) -> DataFrame:
    """Attach smallest and mean quality score; drop a scan only when its score is low.

    A scan without scores stays.
    """
    scores = qc.groupBy(key).agg(F.min("qc_score").alias("qc_min"), F.avg("qc_score").alias("qc_mean"))
    joined = scans.join(scores, on=key, how="left")
    if min_qc is None:
        return joined
    return joined.where(F.col("qc_min").isNull() | (F.col("qc_min") >= min_qc))


def pivot_regions(
    volumes: DataFrame, key: str, regions: Sequence[str] | None = None, total: str = TOTAL_REGION
) -> DataFrame:
    """Long region rows to one wide row per scan, columns ``volume__<region>``.

    Every region in the data is kept; with ``regions`` given, another one is an error.
    Scans without the total region are dropped, and so is any region that is missing in
    one of the remaining scans.
    """
    regions = pivot_names(volumes, "region", regions)
    if total not in regions:
        regions = [total, *regions]
    wide = materialize(
        volumes.groupBy(key)
        .pivot("region", list(regions))
        .agg(F.max("volume_mm3"))
        .where(F.col(f"`{total}`").isNotNull())
    )
    counts = wide.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.col(f"`{r}`")).alias(f"c{i}") for i, r in enumerate(regions)],
    ).first()
    full = [r for i, r in enumerate(regions) if counts[f"c{i}"] == counts["_n"]]
    return wide.select(key, *[F.col(f"`{r}`").alias(f"volume__{r}") for r in full])


def build_features(wide: DataFrame, normalize: bool = True, total: str = TOTAL_REGION) -> dict[str, Column]:
    """Named feature columns: regions relative to the total volume, or raw volumes."""
    regions = [c for c in wide.columns if c.startswith("volume__")]
    if not normalize:
        return {f"{c.removeprefix('volume__')} (mm^3)": F.col(f"`{c}`") for c in regions}
    whole = f"volume__{total}"
    return {
        f"{c.removeprefix('volume__').strip()} / TIV": F.try_divide(F.col(f"`{c}`"), F.col(f"`{whole}`"))
        for c in regions
        if c != whole
    }


# --- metrics -------------------------------------------------------------------------

def error_columns(df: DataFrame, y: str, predicted: str) -> DataFrame:
    error = F.col(predicted) - F.col(y)
    return df.withColumn("residual", error).withColumn("absolute_error", F.abs(error))


def _regression_aggregates(y: Column, predicted: Column) -> list[Column]:
    error = predicted - y
    spread = F.var_pop(y) * F.count(y)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1.0 - F.try_divide(F.sum(error * error), F.when(spread > 0, spread))).alias("r2"),
        F.try_divide(
            F.covar_pop(y, predicted),
            F.when(F.stddev_pop(y) * F.stddev_pop(predicted) > 0, F.stddev_pop(y) * F.stddev_pop(predicted)),
        ).alias("pearson_r"),
        F.avg(error).alias("bias"),
        F.count(F.lit(1)).alias("n"),
    ]


def regression_metrics(df: DataFrame, y: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """mae, rmse, r2, pearson_r, bias and n, overall and per ``by``, in one pass.

    The overall row has ``overall`` true and null ``by`` columns. R2 is null when the
    target does not vary, the correlation when either side does not.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(predicted).isNotNull())
    aggregates = _regression_aggregates(F.col(y).cast("double"), F.col(predicted).cast("double"))
    if not by:
        return rows.agg(*aggregates)
    names = list(by)
    grouped = rows.groupingSets([names, []], *names)
    return grouped.agg((F.grouping_id() != 0).alias("overall"), *aggregates)


def mean_baseline(df: DataFrame, y: str) -> DataFrame:
    """Metrics of predicting the mean for every row."""
    mean = df.agg(F.avg(y)).first()[0]
    return regression_metrics(df.withColumn("_mean", F.lit(mean).cast("double")), y, "_mean")


def fold_metrics(df: DataFrame, fold: str = "outer_fold", alpha: str = "alpha") -> DataFrame:
    """Mean absolute error and the chosen penalty per fold."""
    return df.groupBy(fold).agg(F.max(alpha).alias("alpha"), F.avg("absolute_error").alias("mae"))


def cohort_stats(df: DataFrame, subject: str, age: str, n_features: int) -> DataFrame:
    """Scans, subjects, features and the age range, counted per subject first."""
    subjects = df.groupBy(subject).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(age).alias("_sum"), F.count(age).alias("_aged"),
        F.min(age).alias("_min"), F.max(age).alias("_max"),
    )
    return subjects.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_scans"),
        F.count(subject).alias("n_subjects"),
        F.lit(n_features).alias("n_features"),
        F.min("_min").alias("age_min"),
        F.max("_max").alias("age_max"),
        F.try_divide(F.sum("_sum"), F.sum("_aged")).alias("age_mean"),
    )


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with mid-ranks for ties, overall or per group.

    Rows are folded to one per distinct score first; the number of negatives below a
    score is a distributed running sum. Null when a group has only one class.
    """
    by = list(by)
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    positive = F.col(label).cast("int") == 1
    counts = rows.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg")
    )
    runs = ordered_prefix(counts, ["_score"], by, {"_below": F.col("_neg")})
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    n_pos, n_neg = F.sum("_pos"), F.sum("_neg")
    return runs.groupBy(*by).agg(
        n_pos.alias("n_pos"),
        n_neg.alias("n_neg"),
        F.try_divide(wins, n_pos.cast("double") * n_neg).alias("auroc"),
    )


def f1_score(df: DataFrame, predicted: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """F1 of the positive class; null when nothing is positive on either side."""
    p, y = F.col(predicted).cast("int") == 1, F.col(label).cast("int") == 1
    counts = df.groupBy(*by).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn")
    )
    total = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.withColumn("f1", F.try_divide(2.0 * F.col("tp"), total.cast("double")))


# --- features and models -------------------------------------------------------------

def standardize(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Zero mean and unit population deviation, fitted on ``fit_on`` rows.

    A constant column is only centred. The fitted values are two numbers per column.
    """
    train = df if fit_on is None else df.where(fit_on)
    fitted = train.agg(*[f for c in columns for f in (F.avg(c), F.stddev_pop(c))]).first()
    scaled = {}
    for i, c in enumerate(columns):
        mean, std = fitted[2 * i], fitted[2 * i + 1]
        if mean is None:
            raise ValueError(f"no rows to fit column {c!r}")
        scaled[c] = (F.col(c) - F.lit(float(mean))) / F.lit(float(std) or 1.0)
    return df.withColumns(scaled)


def batch_predict(
    df: DataFrame,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    features: str,
    width: int,
    output: str = "predicted_value",
    return_type: T.DataType | None = None,
    batch_size: int = 1024,
) -> DataFrame:
    """Score table rows with a frozen model, loaded once per worker.

    ``make_model`` returns a function from a ``(rows, width)`` array to predictions in
    the same order; results stay on their row.
    """
    score = predict_batch_udf(
        make_model,
        return_type=return_type or T.DoubleType(),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(output, score(F.col(features)))


def report_json(sections: Mapping[str, DataFrame]) -> DataFrame:
    """Summary frames as one JSON document: one field per section, its rows as a list.

    Sections are summaries with a small fixed number of rows, not data.
    """
    out = None
    for name, frame in sections.items():
        rows = F.to_json(F.sort_array(F.collect_list(F.struct(*frame.columns))))
        part = frame.agg(F.concat(F.lit(json.dumps(name) + ":"), rows).alias("part"))
        out = part if out is None else out.unionByName(part)
    body = F.array_join(F.sort_array(F.collect_list("part")), ",")
    return out.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))
