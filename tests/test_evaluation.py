import json
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxelherd.operators import meters, metrics
from voxelherd.operators.probe import fit_heads, linear_probe, pack_blocks
from voxelherd.operators.quality import failure_report, require_finite, require_rows, CohortDataError
from voxelherd.operators.ridge import ALPHAS, cell_of, fit_cells, merged, moved, ridge_group_cv, top_coefficients, triangle
from voxelherd.session import materialize
from voxelherd.sources import sinks
from voxelherd.streaming.live_meters import compact_live_meters, read_live_meters, start_live_meters
from voxelherd.streaming.live_windows import read_live_windows, start_live_windows


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"w": rng.choice(["a", "b"], 300), "y": rng.normal(50, 9, 300)})
    data["q"] = data["y"] * 0.7 + rng.normal(10, 3, 300)
    got = metrics.regression_metrics(spark.createDataFrame(data), "y", "q", ["w"]).toPandas()
    for row in got.itertuples():
        part = data if row.overall else data[data["w"] == row.w]
        e = part["q"] - part["y"]
        assert row.mae == pytest.approx(e.abs().mean()) and row.bias == pytest.approx(e.mean()) and row.n == len(part)
        assert row.rmse == pytest.approx(np.sqrt((e**2).mean()))
        assert row.r2 == pytest.approx(1 - (e**2).sum() / ((part["y"] - part["y"].mean()) ** 2).sum())
        assert row.pearson_r == pytest.approx(np.corrcoef(part["y"], part["q"])[0, 1])


def test_constant_target_has_no_r2(spark):
    row = metrics.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, q double"), "y", "q").first()
    assert row["r2"] is None and row["pearson_r"] is None and row["mae"] == 1.5
    base = metrics.mean_baseline(spark.createDataFrame([(1.0,), (3.0,)], "y double"), "y").first()
    assert base["mae"] == 1.0 and base["r2"] == 0.0


def test_auroc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1), (0.2, 0)], "s double, y int")
    assert metrics.auroc(df, "s", "y").first()["auroc"] == pytest.approx(5.5 / 6)
    assert metrics.auroc(df.where("y = 1"), "s", "y").first()["auroc"] is None


def test_f1_without_positives(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("b", 0, 0)], "g string, p int, y int")
    assert {r["g"]: r["f1"] for r in metrics.f1_score(df, "p", "y", ["g"]).collect()} == {"a": pytest.approx(2 / 3), "b": None}


def test_regions(spark):
    rows = [("s1", "total intracranial", 10.0), ("s1", "left", 2.0), ("s1", "right", 4.0), ("s2", "total intracranial", 20.0),
            ("s2", "left", 5.0), ("s3", "left", 1.0), ("s3", "right", 1.0)]
    df = spark.createDataFrame(rows, "scan string, region string, volume_mm3 double")
    wide = metrics.pivot_regions(df, "scan", ["total intracranial", "left", "right"])
    assert set(metrics.pivot_regions(df, "scan").columns) == set(wide.columns)
    with pytest.raises(CohortDataError, match="unexpected values of region: right"):
        metrics.pivot_regions(df, "scan", ["total intracranial", "left"])
    assert wide.columns == ["scan", "volume__total intracranial", "volume__left"] and wide.count() == 2
    features = metrics.build_features(wide)
    assert list(features) == ["left / TIV"]
    assert sorted(r[0] for r in wide.select(features["left / TIV"]).collect()) == [0.2, 0.25]
    assert list(metrics.build_features(wide, normalize=False)) == ["total intracranial (mm^3)", "left (mm^3)"]


def test_scans_without_scores_stay(spark):
    scans = spark.createDataFrame([("a",), ("b",), ("c",)], "scan string")
    qc = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("b", 0.7)], "scan string, qc_score double")
    got = {r["scan"]: (r["qc_min"], r["qc_mean"]) for r in metrics.qc_filter(scans, qc, "scan", 0.6).collect()}
    assert got == {"b": (0.7, 0.7), "c": (None, None)}
    assert metrics.qc_filter(scans, qc, "scan").count() == 3


def test_labels_and_reasons(spark):
    scans = spark.createDataFrame([(n,) for n in ("sub-1_ses-wave1_a", "sub-1_ses-wave2_a", "sub-2_ses-wave1_a", "bad")], "pat_id string")
    people = spark.createDataFrame([("sub-1",)], "participant_id string")
    ages = spark.createDataFrame([("sub-1", "wave1", 30.5)], "participant_id string, wave string, age double")
    good, bad = metrics.label_lookup(scans, people, ages)
    assert [(r["pat_id"], r["scan"], r["label"]) for r in good.collect()] == [("sub-1_ses-wave1_a", "a", 366.0)]
    assert {r["pat_id"]: r["reason"] for r in bad.collect()} == {
        "sub-1_ses-wave2_a": "age missing", "sub-2_ses-wave1_a": "unknown participant", "bad": "name did not match",
    }


def test_standardize_leaves_constant_columns_centred(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (9.0, 5.0)], "a double, b double")
    got = metrics.standardize(df, ["a", "b"], F.col("a") < 5).toPandas()
    assert got["a"].tolist() == [-1.0, 1.0, 7.0] and got["b"].tolist() == [0.0, 0.0, 0.0]


def test_report_document(spark, tmp_path):
    report = metrics.report_json({
        "data": spark.createDataFrame([(3, 2)], "n_scans int, n_subjects int"),
        "by wave": spark.createDataFrame([("wave2", 1.5), ("wave1", 2.5)], "wave string, mae double"),
    })
    sinks.write_report(report, str(tmp_path / "r"))
    document = json.loads(next((tmp_path / "r").glob("*.txt")).read_text())
    assert document == {"data": [{"n_scans": 3, "n_subjects": 2}], "by wave": [{"wave": "wave1", "mae": 2.5}, {"wave": "wave2", "mae": 1.5}]}


def test_guards(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    with pytest.raises(PySparkException, match="loss is NaN"):
        df.select(require_finite(F.col("v"), "loss")).collect()
    with pytest.raises(CohortDataError):
        require_rows(df.where("v > 5 AND v < 5"), "scans")
    rejects = spark.createDataFrame([("a", "x", "r"), ("b", "x", "r")], "path string, stage string, reason string")
    assert failure_report(rejects).first()["n_failed"] == 2


# --- ridge ---------------------------------------------------------------------------

def ridge_by_rows(x, y, alphas, splits):
    """Plain row-wise fit: scale, choose the penalty over ``splits``, refit."""
    mean, std = x.mean(0), x.std(0)
    z = (x - mean) / np.where(std == 0, 1, std)

    def solve(z, y, alpha):
        zc, yc = z - z.mean(0), y - y.mean()
        w = np.linalg.solve(zc.T @ zc + alpha * np.eye(z.shape[1]), zc.T @ yc)
        return w, y.mean() - z.mean(0) @ w

    scores = np.zeros((len(splits), len(alphas)))
    for i, held in enumerate(splits):
        train = np.setdiff1d(np.arange(len(y)), held)
        for j, alpha in enumerate(alphas):
            w, b = solve(z[train], y[train], alpha)
            error = y[held] - z[held] @ w - b
            scores[i, j] = 1 - (error**2).sum() / ((y[held] - y[held].mean()) ** 2).sum()
    alpha = alphas[int(np.argmax(scores.mean(0)))]
    w, b = solve(z, y, alpha)
    return alpha, w, lambda new: (new - mean) / np.where(std == 0, 1, std) @ w + b


@pytest.fixture(scope="module")
def cohort():
    rng = np.random.default_rng(4)
    n = 260
    group = np.where(rng.random(n) < 0.35, 999, rng.integers(0, 30, n))
    x = rng.normal(100, 5, (n, 6)) * [1, 2, 0.5, 1, 1, 0] + [0, 0, 0, 0, 0, 7]
    y = x[:, 0] * 1.5 - x[:, 2] * 4 + rng.normal(0, 6, n) + group % 5
    return pd.DataFrame({"id": rng.permutation(n), "group": group, "x": x.tolist(), "y": y})


@pytest.mark.parametrize("inner", ["grouped", "contiguous"])
def test_ridge_matches_row_wise_fit(spark, cohort, inner):
    fit = ridge_group_cv(spark.createDataFrame(cohort), "x", "y", "group", ["id"], inner=inner)
    got = fit.predictions.toPandas().sort_values("id").reset_index(drop=True)
    assert len(got) == len(cohort) and (got.groupby("group")["outer_fold"].nunique() == 1).all()
    x, y, fold = np.stack(got["x"]), got["y"].to_numpy(), got["outer_fold"].to_numpy()

    def splits(rows):
        if inner == "contiguous":
            return np.array_split(np.arange(len(rows)), 5)
        return [np.flatnonzero(fold[rows] == f) for f in np.unique(fold[rows])]

    for f in range(1, 6):
        train = np.flatnonzero(fold != f)
        alpha, _, predict = ridge_by_rows(x[train], y[train], ALPHAS, splits(train))
        held = got[fold == f]
        assert set(held["alpha"]) == {alpha}
        assert np.allclose(held["predicted"], predict(x[fold == f]), atol=1e-6)
    alpha, w, _ = ridge_by_rows(x, y, ALPHAS, splits(np.arange(len(y))))
    coefficients = {r["feature"]: r["standardized_coefficient"] for r in fit.coefficients.collect()}
    assert fit.final_alpha == alpha and np.allclose([coefficients[f"x{i}"] for i in range(6)], w, atol=1e-6)
    top = top_coefficients(fit.coefficients, 2).collect()
    assert {r["feature"] for r in top} == {f"x{i}" for i in np.argsort(-np.abs(w))[:2]}


def test_ridge_does_not_depend_on_partitioning(spark, cohort):
    df = spark.createDataFrame(cohort)
    a = ridge_group_cv(df, "x", "y", "group", ["id"]).predictions.toPandas().sort_values("id")["predicted"].to_numpy()
    b = ridge_group_cv(df.repartition(3), "x", "y", "group", ["id"]).predictions.toPandas().sort_values("id")["predicted"].to_numpy()
    assert np.allclose(a, b)


def test_age_model_report(spark, folder):
    from voxelherd.plans.age_model import age_model
    from voxelherd.plans.q_evaluation import region_study
    from voxelherd.plans.registry import Tables

    rows, people, ages = region_study(Tables(spark, folder))
    found = age_model(rows, rows, people, ages, ["total intracranial", "left", "right"], min_qc=2.0)
    report = json.loads(found.report.first()[0])
    assert set(report) == {"settings", "data", "group_cv", "by_wave", "mean_age_baseline", "per_fold", "final_refit"}
    predictions = found.predictions.toPandas()
    assert report["group_cv"][0]["n"] == len(predictions) == report["data"][0]["n_scans"] == sum(w["n"] for w in report["by_wave"])
    assert report["group_cv"][0]["mae"] == pytest.approx((predictions["predicted"] - predictions["age"]).abs().mean())
    assert len(report["per_fold"]) == 5 and (predictions["qc_min"] >= 2).all()
    assert {c["feature"] for c in found.coefficients.collect()} == {"left / TIV", "right / TIV"}


def test_ridge_needs_two_groups(spark, cohort):
    one = spark.createDataFrame(cohort).where("group = 999")
    with pytest.raises(ValueError, match="two groups"):
        ridge_group_cv(one, "x", "y", "group", ["id"])
    with pytest.raises(ValueError):
        ridge_group_cv(one, "x", "y", "group", ["id"], inner="other")


def test_constant_target_prefers_first_penalty():
    rows = np.column_stack([np.arange(6.0), np.full(6, 2.0)])
    fit = fit_cells([cell_of(rows[:3]), cell_of(rows[3:])], ALPHAS)
    assert fit.alpha == ALPHAS[0] and np.allclose(fit.slope, 0) and fit.level == pytest.approx(2.0)


def test_factors_of_parts_are_the_factor_of_all():
    rng = np.random.default_rng(8)
    rows = rng.normal(1e6, 1, (500, 5)) * [1, 1e3, 1e-3, 1, 1]
    parts = np.split(rows, [1, 3, 200, 201])
    left = merged([merged([cell_of(p) for p in parts[:2]]), *(cell_of(p) for p in parts[2:])])
    right = cell_of(rows)
    a, b = (triangle(moved(cell, right.center)) for cell in (left, right))
    assert np.allclose(np.abs(a), np.abs(b), rtol=1e-8, atol=1e-9 * np.abs(b).max(axis=0))
    assert left.factor[0, 0] ** 2 == pytest.approx(500)


def test_nearly_collinear_features_keep_their_digits(spark):
    """The last feature repeats the sum of two others but for one part in 10^7; without a real
    penalty the fit has to find its coefficient, which second moments (10^14) cannot."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (4000, 3))
    x = np.column_stack([x, x[:, 0] + x[:, 1] + 1e-7 * rng.normal(0, 1, 4000)])
    y = x[:, :3] @ [1.0, -2.0, 0.5] + 3e7 * (x[:, 3] - x[:, 0] - x[:, 1]) + 40
    data = pd.DataFrame({"id": range(4000), "group": np.arange(4000) % 40, "x": x.tolist(), "y": y})
    fit = ridge_group_cv(spark.createDataFrame(data).repartition(70), "x", "y", "group", ["id"], alphas=[1e-16])
    got = fit.predictions.toPandas()
    assert (got["predicted"] - got["y"]).abs().max() < 1e-3
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
    ours = {r["feature"]: r["standardized_coefficient"] for r in fit.coefficients.collect()}
    assert np.allclose([ours[f"x{i}"] for i in range(4)], want, rtol=1e-4)
    moments = z.T @ z
    assert not np.allclose(np.linalg.solve(moments, z.T @ (y - y.mean())), want, rtol=1e-3)


def test_probe_picks_best_penalty(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(i % 2, 0.7, 4).tolist(), i % 2, ("train", "train", "val", "test")[i // 2 % 4]) for i in range(400)]
    got = linear_probe(spark.createDataFrame(rows, "f array<double>, y int, s string"), "f", "y", "s", [0.01, 100.0]).toPandas()
    assert got["chosen"].sum() == 1 and got.loc[got["chosen"], "val_auroc"].iloc[0] == got["val_auroc"].max()
    assert got["test_auroc"].min() > 0.8


def logistic_by_rows(x, y, penalty):
    """Plain gradient descent with a shrinking step until nothing moves, on standardized features."""
    z = np.column_stack([(x - x.mean(0)) / x.std(0, ddof=1), np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], penalty), 0)
    w = np.zeros(z.shape[1])
    rate = 4 / np.linalg.eigvalsh(z.T @ z / len(z)).max()
    for _ in range(20_000):
        w -= rate * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y) + ridge * w) / (1 + rate * penalty)
    return w[:-1] / x.std(0, ddof=1), w[-1] - w[:-1] @ (x.mean(0) / x.std(0, ddof=1))


def packed(spark, x, y, parts=5):
    rows = spark.createDataFrame(pd.DataFrame({"f": x.tolist(), "y": y, "s": "train"})).repartition(parts)
    return pack_blocks(rows, "f", "y", "s")


def test_heads_match_a_fit_by_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 2, (300, 4)) * [1, 10, 0.1, 1]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 3) + 0.2 * (x[:, 1] - 30)))).astype(float)
    got = fit_heads(packed(spark, x, y), [0.001, 0.1, 5.0])
    for head, penalty in zip(got, [0.001, 0.1, 5.0]):
        slope, level = logistic_by_rows(x, y, penalty)
        assert np.allclose(head[:-1], slope, rtol=1e-5, atol=1e-7) and head[-1] == pytest.approx(level, rel=1e-5, abs=1e-5)


def test_separable_constant_and_missing_classes(spark):
    x = np.column_stack([np.arange(40.0), np.full(40, 7.0)])
    heads = fit_heads(packed(spark, x, (x[:, 0] > 20).astype(float)), [0.0, 0.01], max_iter=6)
    assert np.isfinite(heads).all() and (heads[:, 0] > 0).all() and (heads[:, 1] == 0).all()
    assert np.isfinite(fit_heads(packed(spark, x, np.ones(40)), [0.1])).all()
    assert fit_heads(packed(spark, x, np.ones(40)).where("n < 0"), [0.1]) is None
    empty = spark.createDataFrame([], "f array<double>, y int, s string")
    assert [tuple(r) for r in linear_probe(empty, "f", "y", "s", [0.1, 1.0]).collect()] == [(0.1, None, None, True), (1.0, None, None, False)]


def test_jobs_do_not_grow_with_the_penalties(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (200, 3))
    blocks = materialize(packed(spark, x, (x[:, 0] + rng.normal(0, 1, 200) > 0).astype(float)))

    def jobs(penalties):
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        fit_heads(blocks, penalties)
        return len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before))

    assert jobs([0.01] * 8) == jobs([0.01])


# --- meters --------------------------------------------------------------------------

def test_meter_windows_match_a_deque(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        value = [float("nan"), float("inf"), None, None][i % 37] if i % 37 < 4 else float(rng.integers(0, 30))
        rows.append(("hot" if i % 3 else f"r{i % 9}", "loss", i, value))
    got = meters.meter_window(
        spark.createDataFrame(rows, "run string, metric string, i int, value double"), ["run", "metric"], ["i"], "value", chunk=32
    ).toPandas()
    windows, want = {}, []
    for run, _, i, value in rows:
        if value is None or not np.isfinite(value):
            continue
        window = windows.setdefault(run, deque(maxlen=20))
        window.append(value)
        ordered = sorted(window)
        want.append((i, ordered[(len(ordered) - 1) // 2], sum(window) / len(window), max(window), value))
    got = got.sort_values("i")
    assert got["i"].tolist() == [w[0] for w in want]
    for position, name in enumerate(["median", "avg", "max", "value"], start=1):
        assert np.allclose(got[name], [w[position] for w in want])


def test_global_meter(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 2), ("a", float("nan"), 9), ("b", None, 1), ("c", float("-inf"), 1)], "m string, v double, n int")
    assert [tuple(r) for r in meters.meter_global(df, ["m"], "v", "n").collect()] == [("a", 3, 3.0)]


def test_logs_and_meters_fail_on_request(spark):
    wide = spark.createDataFrame([("r", 0, 1.0, float("nan"))], "run string, epoch int, a double, b double")
    assert meters.metric_log(wide).count() == 2
    with pytest.raises(PySparkException, match="a metric is NaN"):
        meters.metric_log(wide, fail=True).collect()
    assert [tuple(r) for r in meters.metric_log(wide.drop("b"), fail=True).collect()] == [("r", 0, "a", 1.0)]
    rows = spark.createDataFrame([("m", 1.0), ("m", float("inf")), ("m", None)], "m string, loss double")
    assert meters.meter_global(rows, ["m"], "loss").first()["count"] == 1
    with pytest.raises(PySparkException, match="loss is Infinity"):
        meters.meter_global(rows, ["m"], "loss", fail=True).collect()


def test_epoch_summary(spark):
    losses = spark.createDataFrame([(0, "val", 1.0), (0, "val", 3.0), (1, "val", float("nan"))], "epoch int, dataset string, loss double")
    train = spark.createDataFrame([(0, 9.0), (1, 8.0)], "epoch int, `train/loss` double")
    got = meters.eval_summary(losses, ["val"], train).orderBy("epoch").collect()
    assert [tuple(r) for r in got] == [(0, 9.0, 2.0), (1, 8.0, None)]
    more = losses.unionByName(spark.createDataFrame([(1, "test", 5.0)], losses.schema))
    assert meters.eval_summary(more).columns == ["epoch", "eval/test/loss", "eval/val/loss"]
    with pytest.raises(CohortDataError, match="unexpected values of dataset: test"):
        meters.eval_summary(more, ["val"])


def test_live_meters_over_two_runs(spark, tmp_path):
    (tmp_path / "log").mkdir()
    run = lambda: start_live_meters(
        spark.readStream.schema("run string, metric string, value double").json(str(tmp_path / "log")),
        ["run", "metric"], "value", str(tmp_path / "out"), str(tmp_path / "state"),
    ).awaitTermination()
    put = lambda name, rows: (tmp_path / "log" / name).write_text("\n".join(json.dumps(dict(zip(("run", "metric", "value"), r))) for r in rows))
    put("a.json", [("r", "loss", 2.0), ("r", "loss", 4.0), ("s", "loss", 1.0)])
    run()
    put("b.json", [("r", "loss", 9.0)])
    run()
    got = {r["run"]: (r["count"], r["global_avg"]) for r in read_live_meters(spark, str(tmp_path / "out"), ["run", "metric"]).collect()}
    assert got == {"r": (3, 5.0), "s": (1, 1.0)}
    assert compact_live_meters(spark, str(tmp_path / "out"), ["run", "metric"]) >= 2
    assert compact_live_meters(spark, str(tmp_path / "out"), ["run", "metric"]) == 0
    put("c.json", [("s", "loss", 3.0), ("t", "loss", 7.0)])
    run()
    again = {r["run"]: (r["count"], r["global_avg"]) for r in read_live_meters(spark, str(tmp_path / "out"), ["run", "metric"]).collect()}
    assert again == {"r": (3, 5.0), "s": (2, 2.0), "t": (1, 7.0)}


def test_live_windows_over_runs_equal_the_batch(spark, tmp_path):
    """The log arrives in three files, one a run; the windows go on where they were."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        value = float(rng.integers(0, 50)) if i % 11 else [float("nan"), float("inf"), None][i % 3]
        rows.append(("hot" if i % 3 else f"r{i % 7}", "loss", 1_700_000_000 + i // 2, i, value))
    names = ("run", "metric", "at", "number", "value")
    schema = "run string, metric string, at timestamp, number long, value double"
    (tmp_path / "log").mkdir()
    out, done = str(tmp_path / "out"), []

    def arrive(name, part):
        spark.createDataFrame([(*r[:2], r[2], *r[3:]) for r in part], schema.replace("timestamp", "long")).withColumn(
            "at", F.timestamp_seconds("at")
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        done.extend(part)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        start_live_windows(stream, ["run", "metric"], "at", "number", "value", out, str(tmp_path / "state")).awaitTermination()

    for at, stop in ((0, 7), (7, 300), (300, 600)):
        arrive(at, rows[at:stop])
    batch = spark.createDataFrame(rows, schema.replace("timestamp", "long")).withColumn("at", F.timestamp_seconds("at"))
    want = meters.meter_window(batch, ["run", "metric"], ["at", "number"], "value", chunk=64).toPandas().sort_values("number", ignore_index=True)
    got = read_live_windows(spark, out).toPandas().sort_values("number", ignore_index=True)
    assert len(got) == len(want) == len(done) - sum(r[4] is None or not np.isfinite(r[4]) for r in rows) and not got["late"].any()
    for name in ("run", "at", "number", "step"):
        assert got[name].tolist() == want[name].tolist()
    for name in ("median", "avg", "max", "value"):
        assert np.allclose(got[name], want[name])

    # Late rows enter no window, and those in order go on as if they had not come.
    arrive(9, [("hot", "loss", 1_699_999_000, 5, 1e9), ("hot", "loss", 1_700_000_900, 9000, 3.0), ("new", "loss", 5, 1, 2.0)])
    more = read_live_windows(spark, out).where("number IN (5, 9000) AND value > 2.5 AND (late OR number = 9000) OR run = 'new'").toPandas()
    late, new = more[more["late"]], more[more["number"] == 9000].iloc[0]
    assert late["value"].tolist() == [1e9] and late["step"].isna().all() and late["median"].isna().all()
    last = [r[4] for r in rows if r[0] == "hot" and r[4] is not None and np.isfinite(r[4])][-19:] + [3.0]
    assert new["avg"] == pytest.approx(np.mean(last)) and new["max"] == max(last) and new["median"] == sorted(last)[9]
    assert more[more["run"] == "new"][["step", "median"]].values.tolist() == [[0, 2.0]]


def test_live_windows_keep_rings_as_a_table(spark, tmp_path, monkeypatch):
    """No call per meter: meters are rows of a table, written by each micro-batch, whole now and then."""
    from voxelherd.streaming import live_windows

    monkeypatch.setattr(live_windows, "RINGS_WHOLE", 2)
    out, state, rows = str(tmp_path / "out"), str(tmp_path / "state"), []
    schema = "run long, at timestamp, number long, value double"
    for batch in range(5):
        own = [(r, batch * 100 + i, float((r + i) % 5)) for r in ([0, 1] if batch % 2 else range(40)) for i in range(3)]
        rows += own
        spark.createDataFrame(own, "run long, number long, value double").withColumn("at", F.timestamp_seconds("number")).coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        start_live_windows(stream, ["run"], "at", "number", "value", out, state, window=4).awaitTermination()
    assert not (tmp_path / "state" / "state").exists()
    sizes = [spark.read.parquet(f"{state}/rings/{n}").count() for n in range(5)]
    assert sizes == [40, 2, 40, 2, 40]
    batch = spark.createDataFrame(rows, "run long, number long, value double").withColumn("at", F.timestamp_seconds("number"))
    want = meters.meter_window(batch, ["run"], ["at", "number"], "value", 4, chunk=64)
    columns = ["run", "number", "step", "median", "avg", "max", "value"]
    got = read_live_windows(spark, out).where("NOT late")
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
