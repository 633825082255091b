"""Subject-grouped cross-validated ridge regression from orthogonal factors.

Each task reduces its rows of a validation cell to the triangular factor of ``[1, x, y]``,
factors are merged in a tree, and the driver works on one factor of fixed size per cell.
Fitting, choosing the penalty and scoring the inner folds need only these: the factor of
several cells is the factor of their factors laid upon each other. Products of columns
(second moments) are never formed, so nearly collinear features keep their digits. The data
is read once for the factors and once for the predictions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.operators.ordering import ordered_prefix
from voxelherd.operators.packaging import group_kfold
from voxelherd.session import materialize

# Penalties tried by default.
ALPHAS = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0)

# Factors merged in one task, and rows factored at once.
FAN_IN = 32
ROWS_AT_ONCE = 4096


@dataclass
class RidgeResult:
    predictions: DataFrame
    folds: DataFrame
    coefficients: DataFrame
    final_alpha: float


@dataclass
class Cell:
    """Rows ``[1, x - center_x, y - center_y]`` as a triangular factor."""

    center: np.ndarray
    factor: np.ndarray


def triangle(rows: np.ndarray) -> np.ndarray:
    """Square triangular factor of rows; missing rows are zero."""
    width = rows.shape[1]
    factor = np.linalg.qr(rows, mode="r")
    out = np.zeros((width, width))
    out[: len(factor)] = factor
    return out


def cell_of(values: np.ndarray) -> Cell:
    """Factor of rows ``[x, y]`` around their own mean."""
    center = values.mean(axis=0)
    return Cell(center, triangle(np.column_stack([np.ones(len(values)), values - center])))


def moved(cell: Cell, center: np.ndarray) -> np.ndarray:
    """The factor around another center; exact up to rounding, no longer triangular."""
    out = cell.factor.copy()
    out[:, 1:] += np.outer(cell.factor[:, 0], cell.center - center)
    return out


def merged(cells: Sequence[Cell]) -> Cell:
    """Factor of the rows of several cells."""
    center = cells[0].center
    if len(cells) == 1:
        return cells[0]
    return Cell(center, triangle(np.vstack([moved(cell, center) for cell in cells])))


def factors(df: DataFrame, features: str, y: str, cells: str) -> dict[int, Cell]:
    """One :class:`Cell` per number listed in ``cells``.

    Tasks emit one factor per cell; ``FAN_IN`` of them at a time are merged until one is
    left, so no task and no step sees more than that many.
    """
    schema = "cell int, part bigint, center array<double>, factor array<double>"

    def unpack(row) -> Cell:
        width = len(row["center"]) + 1
        return Cell(np.array(row["center"]), np.array(row["factor"]).reshape(width, width))

    def record(found: dict[int, Cell], part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "cell": pa.array(list(found), pa.int32()),
            "part": pa.array([part] * len(found), pa.int64()),
            "center": pa.array([c.center.tolist() for c in found.values()], pa.list_(pa.float64())),
            "factor": pa.array([c.factor.ravel().tolist() for c in found.values()], pa.list_(pa.float64())),
        })

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Cell] = {}
        part = -1
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(at, ROWS_AT_ONCE)
                n, part = piece.num_rows, piece.column("part")[0].as_py()
                x = piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                values = np.column_stack([x, piece.column("y").to_numpy(zero_copy_only=False)])
                listed = piece.column("cells")
                owner = np.repeat(np.arange(n), np.diff(listed.offsets.to_numpy()))
                cell_numbers = listed.flatten().to_numpy(zero_copy_only=False)
                for number in np.unique(cell_numbers).tolist():
                    own = cell_of(values[owner[cell_numbers == number]])
                    found[number] = merged([found[number], own]) if number in found else own
        if found:
            yield record(found, part)

    def merge(table: pa.Table) -> pa.Table:
        """Parts of one cell, as many as are merged at a time."""
        rows = table.sort_by("part").to_pylist()
        return pa.Table.from_batches([record({rows[0]["cell"]: merged([unpack(r) for r in rows])}, rows[0]["part"] // FAN_IN)])

    narrow = df.select(
        F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"),
        F.col(cells).cast("array<int>").alias("cells"), F.spark_partition_id().cast("bigint").alias("part"),
    )
    parts = materialize(narrow.mapInArrow(partial, schema))
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts = parts.withColumn("step", F.floor(F.col("part") / FAN_IN)).groupBy("cell", "step").applyInArrow(merge, schema)
        most //= FAN_IN
    return {row["cell"]: unpack(row) for row in parts.collect()}


def _scaling(total: Cell) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each feature; deviation 1 where it does not vary."""
    n = total.factor[0, 0] ** 2
    mean = total.center[:-1] + total.factor[0, 1:-1] / total.factor[0, 0]
    # Below the first row stands the factor of the centered columns.
    spread = np.sqrt((total.factor[1:, 1:-1] ** 2).sum(axis=0) / n)
    size = np.sqrt(spread**2 + (mean - total.center[:-1]) ** 2) + np.abs(total.center[:-1])
    flat = spread <= 1e-12 * np.maximum(size, 1e-300)
    return mean, np.where(flat, 1.0, spread)


def _scaled(cell: Cell, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Factor of ``[1, (x - mean) / scale, y - center_y]``."""
    out = moved(cell, np.append(mean, cell.center[-1]))
    out[:, 1:-1] /= scale
    return out


def _solve(factor: np.ndarray, alphas: Sequence[float]) -> list[tuple[np.ndarray, float]]:
    """Coefficients and intercept per penalty; the intercept is not penalized."""
    r = triangle(factor)
    left, values, right = np.linalg.svd(r[1:, 1:-1], full_matrices=False)
    turned = left.T @ r[1:, -1]
    out = []
    for alpha in alphas:
        w = right.T @ (turned * (values / (values**2 + alpha)))
        out.append((w, (r[0, -1] - r[0, 1:-1] @ w) / r[0, 0]))
    return out


def _r2(factor: np.ndarray, w: np.ndarray, b: float) -> float:
    error = np.linalg.norm(factor @ np.concatenate([[-b], -w, [1.0]])) ** 2
    spread = np.linalg.norm(triangle(factor[:, [0, -1]])[1:, -1]) ** 2
    return 1 - error / spread if spread > 0 else 0.0


@dataclass
class Fit:
    """A line around the means: ``level + (x - mean) @ slope``; ``standardized`` is per deviation."""

    alpha: float
    mean: np.ndarray
    slope: np.ndarray
    level: float
    standardized: np.ndarray


def fit_cells(cells: Sequence[Cell], alphas: Sequence[float]) -> Fit:
    """Choose the penalty by mean held-out R2 over ``cells`` and fit on all of them."""
    target = cells[0].center[-1]
    mean, scale = _scaling(merged(cells))
    # All targets around one center.
    scaled = [_scaled(Cell(np.append(c.center[:-1], target), moved(c, np.append(c.center[:-1], target))), mean, scale) for c in cells]
    best = 0
    if len(alphas) > 1 and len(cells) > 1:
        scores = np.zeros((len(cells), len(alphas)))
        for i, held in enumerate(scaled):
            rest = np.vstack([other for j, other in enumerate(scaled) if j != i])
            for j, (w, b) in enumerate(_solve(rest, alphas)):
                scores[i, j] = _r2(held, w, b)
        best = int(np.argmax(scores.mean(axis=0)))
    w, b = _solve(np.vstack(scaled), [alphas[best]])[0]
    return Fit(float(alphas[best]), mean, w / scale, float(target + b), w)


def _add_cells(df: DataFrame, order: Sequence[str], folds: int, inner: str) -> DataFrame:
    """Validation cells of each row.

    ``grouped``: the outer folds serve as inner folds of each other, one cell per row.
    ``contiguous``: for every model (0 is the full fit, f leaves fold f out) the training
    rows in order are cut into equal runs; cell = model * folds + run.
    """
    if inner == "grouped":
        return df.withColumn("_cells", F.array(F.col("fold") - 1))
    if inner != "contiguous":
        raise ValueError(f"unknown inner split {inner!r}")
    counts = {f"_before{f}": (F.col("fold") == f).cast("bigint") for f in range(1, folds + 1)}
    narrow = df.select(*order, "fold")
    placed = ordered_prefix(narrow, order, sums=counts).drop("fold")
    sizes = {row["fold"]: row["count"] for row in df.groupBy("fold").count().collect()}
    n = sum(sizes.values())

    def run_of(position, size: int):
        # The first size % folds runs hold one row more.
        base, extra = divmod(size, folds)
        edge = extra * (base + 1)
        late = F.lit(extra) + F.floor((position - edge) / F.lit(max(base, 1)))
        return F.when(position < edge, F.floor(position / F.lit(base + 1))).otherwise(late).cast("int")

    cells = [run_of(F.col("position"), n)]
    for f in range(1, folds + 1):
        run = run_of(F.col("position") - F.col(f"_before{f}"), n - sizes.get(f, 0))
        cells.append(F.when(F.col("fold") != f, run + f * folds))
    joined = df.join(placed, on=list(order))
    return joined.withColumn("_cells", F.array_compact(F.array(*cells))).drop(
        "position", *[f"_before{f}" for f in range(1, folds + 1)]
    )


def ridge_group_cv(
    df: DataFrame,
    features: str,
    y: str,
    group: str,
    order: Sequence[str] = (),
    alphas: Sequence[float] = ALPHAS,
    folds: int = 5,
    inner: str = "grouped",
    names: Sequence[str] | None = None,
) -> RidgeResult:
    """Out-of-fold ridge predictions with no subject in two folds.

    ``order`` identifies a row and is needed for ``contiguous`` only. Features are
    standardized with the population deviation of the training rows; the penalty of each
    fold is chosen on its training rows only.
    The full refit gives the standardized coefficients.
    """
    spark = df.sparkSession
    # Written once: the factors, the fold sizes and the predictions read it.
    folded = materialize(group_kfold(df, group, folds))
    # Groups are dealt out in turn, so no fold is empty.
    k = folded.agg(F.max("fold")).first()[0]
    if k is None:
        raise ValueError("no rows to fit")
    present = list(range(1, k + 1))
    found = factors(_add_cells(folded, order, k, inner), features, y, "_cells")

    def training_cells(fold: int) -> list[Cell]:
        if inner == "grouped":
            keep = [f - 1 for f in present if f != fold]
        else:
            keep = [fold * k + j for j in range(k)]
        return [found[c] for c in keep if c in found]

    models, final = [], None
    for fold in [0, *present]:
        cells = training_cells(fold)
        if not cells:
            raise ValueError("cross-validation needs at least two groups")
        fit = fit_cells(cells, alphas)
        if fold == 0:
            final = fit
        else:
            models.append((fold, fit.alpha, fit.mean.tolist(), fit.slope.tolist(), fit.level))

    # One row per fold: the broadcast size is fixed by the number of folds.
    table = spark.createDataFrame(
        models, "outer_fold int, alpha double, _mean array<double>, _slope array<double>, _level double"
    )
    moved_x = F.zip_with(F.col(features).cast("array<double>"), F.col("_mean"), lambda a, b: a - b)
    dot = F.aggregate(F.zip_with(moved_x, F.col("_slope"), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    scored = folded.withColumnRenamed("fold", "outer_fold").join(F.broadcast(table), on="outer_fold")
    predictions = (
        scored.withColumn("predicted", dot + F.col("_level"))
        .withColumn("residual", F.col("predicted") - F.col(y))
        .withColumn("absolute_error", F.abs("residual"))
        .drop("_mean", "_slope", "_level")
    )
    labels = list(names or [f"x{i}" for i in range(len(final.mean))])
    coefficients = spark.createDataFrame(
        list(zip(labels, final.standardized.tolist())), "feature string, standardized_coefficient double"
    )
    return RidgeResult(predictions, table.select("outer_fold", "alpha"), coefficients, final.alpha)


def top_coefficients(coefficients: DataFrame, n: int | None = None) -> DataFrame:
    """Coefficients by size, largest first."""
    ordered = coefficients.orderBy(F.abs("standardized_coefficient").desc(), "feature")
    return ordered if n is None else ordered.limit(n)
