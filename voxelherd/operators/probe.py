"""Linear probes on frozen features: one head per penalty, chosen by validation AUROC.

All heads are fitted at once. The rows are packed into blocks of numbers once; a step reads
them once, and tasks emit the loss, gradient and curvature of every head, which are summed
in two levels. The driver takes one damped Newton step per head from sums of fixed size. So the
number of jobs does not depend on the number of penalties.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.operators.metrics import auroc
from voxelherd.session import materialize

# Rows of one block, partial sums that one task adds up, and when a head is finished.
BLOCK_ROWS = 4096
SUM_GROUPS = 32
TOLERANCE = 1e-9


def pack_blocks(df: DataFrame, features: str, label: str, split: str) -> DataFrame:
    """Blocks of rows of one split: ``split``, ``n``, and ``x`` and ``y`` as little-endian doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            splits = np.array(batch.column("split").to_pylist(), dtype=object)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for name in dict.fromkeys(splits.tolist()):
                rows = np.flatnonzero(splits == name)
                for at in range(0, len(rows), BLOCK_ROWS):
                    part = rows[at : at + BLOCK_ROWS]
                    yield pa.RecordBatch.from_pydict({
                        "split": [name], "n": [len(part)],
                        "x": [np.ascontiguousarray(x[part], "<f8").tobytes()], "y": [y[part].astype("<f8").tobytes()],
                    })

    narrow = df.select(
        F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.col(split).alias("split")
    )
    return narrow.mapInArrow(pack, "split string, n bigint, x binary, y binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["split"], np.frombuffer(row["x"], "<f8").reshape(row["n"], -1), np.frombuffer(row["y"], "<f8")


def summed(blocks: DataFrame, of_block) -> np.ndarray | None:
    """Sum of ``of_block(x, y)`` over all blocks; each task emits one sum, ``SUM_GROUPS`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x, y in _read(batches):
            made = of_block(x, y)
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = blocks.mapInArrow(run, "v array<double>").select(
        array_to_vector("v").alias("v"), (F.spark_partition_id() % SUM_GROUPS).alias("part")
    )
    found = parts.groupBy("part").agg(Summarizer.sum(F.col("v")).alias("v")).collect()
    return sum(row["v"].toArray() for row in sorted(found, key=lambda r: r["part"])) if found else None


def fit_heads(blocks: DataFrame, penalties: Sequence[float], max_iter: int = 50) -> np.ndarray | None:
    """Logistic coefficients and intercept of each penalty, (heads, features + 1).

    Minimizes the mean loss plus half the penalty times the squares of the coefficients per
    sample deviation; the intercept and features that do not vary are left out of it.
    """
    base = summed(blocks, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0)]))
    if base is None:
        return None
    n, mean = base[0], base[2:] / base[0]
    square = summed(blocks, lambda x, y: ((x - mean) ** 2).sum(axis=0))
    scale = np.sqrt(square / max(n - 1, 1))
    scale = np.where(scale > 1e-12 * (np.abs(mean) + scale), scale, 0.0)
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    d, heads = len(mean), len(penalties)
    ridge = np.asarray(penalties, dtype=float)[:, None] * np.append((scale > 0).astype(float), 0.0)
    # Coefficients of (x - mean) / deviation, the last is the level.
    weights = np.zeros((heads, d + 1))
    rate = np.clip(base[1] / n, 1e-6, 1 - 1e-6)
    weights[:, -1] = np.log(rate / (1 - rate))
    loss, step, open_heads = np.full(heads, np.inf), np.zeros((heads, d + 1)), np.ones(heads, dtype=bool)
    for _ in range(max_iter):
        tried = weights + step

        def parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.column_stack([(x - mean) * inverse, np.ones(len(x))])
            margin = z @ tried.T
            chance = 0.5 * (1 + np.tanh(margin / 2))
            out = []
            for h in range(heads):
                curve = (z * (chance[:, h] * (1 - chance[:, h]))[:, None]).T @ z
                own = np.logaddexp(0, margin[:, h]) - y * margin[:, h]
                out += [[own.sum()], z.T @ (chance[:, h] - y), curve.ravel()]
            return np.concatenate(out)

        sums = summed(blocks, parts).reshape(heads, -1) / n
        for h in np.flatnonzero(open_heads):
            value = sums[h, 0] + 0.5 * (ridge[h] * tried[h] ** 2).sum()
            if value > loss[h] + 1e-12 * abs(loss[h]):
                # Too far: half the way from the same place.
                step[h] /= 2
                open_heads[h] = np.abs(step[h]).max() > TOLERANCE
                continue
            weights[h], loss[h] = tried[h], value
            gradient = sums[h, 1 : d + 2] + ridge[h] * weights[h]
            curve = sums[h, d + 2 :].reshape(d + 1, d + 1) + np.diag(ridge[h])
            step[h] = -np.linalg.lstsq(curve, gradient, rcond=1e-12)[0]
            open_heads[h] = np.abs(step[h]).max() > TOLERANCE
        step[~open_heads] = 0
        if not open_heads.any():
            break
    slope = weights[:, :-1] * inverse
    return np.column_stack([slope, weights[:, -1] - slope @ mean])


def linear_probe(
    df: DataFrame, features: str, label: str, split: str, penalties: Sequence[float], max_iter: int = 50
) -> DataFrame:
    """Per penalty: validation and test AUROC, and whether validation chose it.

    ``split`` holds ``train``, ``val`` and ``test``; other rows are left out. Ties go to the
    earlier penalty. Without rows to train on every AUROC is null.
    """
    used = df.where(F.col(split).isin("train", "val", "test"))
    blocks = materialize(pack_blocks(used, features, label, split))
    heads = fit_heads(blocks.where("split = 'train'"), penalties, max_iter)
    found = {}
    if heads is not None:

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, x, y in _read(batches):
                margin = x @ heads[:, :-1].T + heads[:, -1]
                yield pa.RecordBatch.from_pydict({
                    "split": [name] * (len(y) * len(heads)), "label": np.tile(y, len(heads)),
                    "head": np.repeat(np.arange(len(heads)), len(y)), "score": margin.T.ravel(),
                })

        long = blocks.where("split <> 'train'").mapInArrow(score, "split string, label double, head bigint, score double")
        found = {(r["head"], r["split"]): r["auroc"] for r in auroc(long, "score", "label", ["head", "split"]).collect()}
    results = [(float(p), found.get((i, "val")), found.get((i, "test"))) for i, p in enumerate(penalties)]
    best = max(range(len(results)), key=lambda i: (results[i][1] is not None, results[i][1] or 0.0, -i))
    rows = [(*r, i == best) for i, r in enumerate(results)]
    return df.sparkSession.createDataFrame(
        rows, "penalty double, val_auroc double, test_auroc double, chosen boolean"
    )
