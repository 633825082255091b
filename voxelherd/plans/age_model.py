"""The evaluation plan: region volumes to cross-validated age predictions and a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.operators import metrics as m
from voxelherd.operators.quality import CohortDataError, require_rows
from voxelherd.operators.ridge import ALPHAS, RidgeResult, ridge_group_cv, top_coefficients
from voxelherd.session import materialize


@dataclass
class AgeModel:
    predictions: DataFrame
    coefficients: DataFrame
    report: DataFrame
    fit: RidgeResult


def age_model(
    volumes: DataFrame,
    qc: DataFrame,
    participants: DataFrame,
    ages: DataFrame,
    regions: Sequence[str] | None = None,
    min_qc: float | None = None,
    normalize: bool = True,
    folds: int = 5,
    alphas: Sequence[float] = ALPHAS,
    inner: str = "grouped",
) -> AgeModel:
    """Label, filter and pivot the scans, fit once, and report.

    ``volumes`` and ``qc`` are long tables keyed by ``pat_id``; ``ages`` has one row per
    participant and wave. The feature matrix is written once: fitting reads it for the
    moments and again for the predictions.
    """
    scans = volumes.select("pat_id").distinct()
    labeled, _ = m.label_lookup(materialize(scans), participants, ages, units="years")
    # Written once: the names of regions, the features and the labels read it.
    good = materialize(m.qc_filter(labeled, qc, "pat_id", min_qc))
    wide = m.pivot_regions(volumes.join(good.select("pat_id"), on="pat_id", how="left_semi"), "pat_id", regions)
    features = m.build_features(wide, normalize)
    if not features:
        raise CohortDataError("no region is present in every scan")
    matrix = wide.select("pat_id", F.array(*features.values()).alias("features"))
    rows = require_rows(materialize(good.join(matrix, on="pat_id")), "usable scans")

    fit = ridge_group_cv(rows, "features", "age", "participant_id", ["pat_id"], alphas, folds, inner, list(features))
    predictions = materialize(fit.predictions.drop("features"))
    scored = m.regression_metrics(predictions, "age", "predicted", ["wave"])
    report = m.report_json({
        "settings": rows.sparkSession.createDataFrame([(folds, min_qc, normalize)], "folds int, min_qc double, normalized boolean"),
        "data": m.cohort_stats(predictions, "participant_id", "age", len(features)),
        "group_cv": scored.where("overall").drop("overall", "wave"),
        "by_wave": scored.where("NOT overall").drop("overall"),
        "mean_age_baseline": m.mean_baseline(predictions, "age"),
        "per_fold": m.fold_metrics(predictions),
        "final_refit": rows.sparkSession.createDataFrame([(fit.final_alpha,)], "alpha double"),
    })
    return AgeModel(predictions, top_coefficients(fit.coefficients), report, fit)
