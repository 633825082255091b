"""Metric logs: long form, smoothed windows, global averages, per-epoch summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelherd.operators.ordering import ordered_prefix
from voxelherd.operators.quality import finite_or_null, pivot_names, require_finite

WINDOW = 20


def metric_log(
    wide: DataFrame, ids: Sequence[str] = ("run", "epoch"), metrics: Sequence[str] | None = None, fail: bool = False
) -> DataFrame:
    """One row per run, epoch and metric; absent metrics give no row.

    With ``fail`` a value that is NaN or infinite is an error, as it is while training.
    """
    names = list(metrics or [c for c in wide.columns if c not in ids])
    typed = wide.select(*ids, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    long = typed.unpivot(list(ids), [F.col(f"`{n}`") for n in names], "metric", "value").where("value IS NOT NULL")
    return long.withColumn("value", require_finite(F.col("value"), "a metric")) if fail else long


def meter_global(
    df: DataFrame, by: Sequence[str], value: str, weight: str | None = None, fail: bool = False
) -> DataFrame:
    """Weighted mean of the finite values per group, merged from partial sums.

    With ``fail`` a value that is NaN or infinite is an error instead of being left out.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    kept = require_finite(F.col(value), value) if fail else finite_or_null(F.col(value))
    finite = df.withColumn("_value", kept).where("_value IS NOT NULL")
    return finite.groupBy(*by).agg(
        F.sum(n).alias("count"),
        F.try_divide(F.sum(F.col("_value") * n), F.sum(n).cast("double")).alias("global_avg"),
    )


def meter_window(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    window: int = WINDOW,
    chunk: int = 65_536,
) -> DataFrame:
    """Median, mean, max and last value of the latest ``window`` finite values per row.

    The median is the lower one of an even count. A row window over one run would put
    the whole run in one task; runs are cut into chunks of ``chunk`` rows instead, and
    the last ``window - 1`` rows of a chunk are repeated as context for the next.
    """
    if chunk < window:
        raise ValueError("chunk must hold at least one window")
    by, order = list(by), list(order)
    finite = df.withColumn("_value", finite_or_null(F.col(value))).where("_value IS NOT NULL")
    placed = ordered_prefix(finite.select(*by, *order, "_value"), order, by)
    own = F.expr(f"position div {chunk}")
    tail = F.col("position") % chunk >= chunk - (window - 1)
    spread = placed.select(
        "*",
        own.alias("_own"),
        F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))).alias("_chunk"),
    )
    recent = Window.partitionBy(*by, "_chunk").orderBy("position").rowsBetween(1 - window, 0)
    values = F.sort_array(F.collect_list("_value").over(recent))
    measured = spread.select(
        *by,
        *order,
        "_own",
        "_chunk",
        F.col("position").alias("step"),
        values.alias("_sorted"),
        F.avg("_value").over(recent).alias("avg"),
        F.max("_value").over(recent).alias("max"),
        F.col("_value").alias("value"),
    ).where("_own = _chunk")
    middle = F.expr("(size(_sorted) - 1) div 2").cast("int")
    return measured.select(*by, *order, "step", F.get("_sorted", middle).alias("median"), "avg", "max", "value")


def eval_summary(
    losses: DataFrame, datasets: Sequence[str] | None = None, train: DataFrame | None = None
) -> DataFrame:
    """One row per epoch: mean loss of every evaluation set next to the train columns.

    Every set in the data gets a column; with ``datasets`` given, another one is an error.
    """
    datasets = pivot_names(losses, "dataset", datasets)
    wide = losses.groupBy("epoch").pivot("dataset", datasets).agg(F.avg(finite_or_null(F.col("loss"))))
    named = wide.select("epoch", *[F.col(f"`{d}`").alias(f"eval/{d}/loss") for d in datasets])
    return named if train is None else train.join(named, on="epoch", how="left")
