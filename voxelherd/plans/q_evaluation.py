"""Queries: region features, labels, metrics, ridge, probes, metric logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxelherd.operators import meters, metrics
from voxelherd.operators.packaging import split_assign
from voxelherd.operators.probe import linear_probe
from voxelherd.operators.quality import pivot_names
from voxelherd.operators.ridge import ridge_group_cv, top_coefficients
from voxelherd.plans.age_model import age_model
from voxelherd.plans.registry import query
from voxelherd.plans.ridge_sql import crc32_sql, probe_sql, ridge_sql
from voxelherd.session import materialize

TOTAL_REGION = metrics.TOTAL_REGION
REGIONS_SQL = """long AS (
  SELECT l_orderkey AS scan, CASE l_linenumber WHEN 1 THEN 'total intracranial' ELSE 'r' || l_linenumber END AS region,
         max(l_extendedprice) AS volume_mm3 FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT l_orderkey, 'r9', 1.5::DOUBLE + l_orderkey % 7 FROM lineitem GROUP BY 1, 2, 3
)"""


def region_rows(t):
    line = F.col("l_linenumber")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("scan"),
        F.when(line == 1, "total intracranial").otherwise(F.concat(F.lit("r"), line)).alias("region"),
        F.col("l_extendedprice").alias("volume_mm3"),
    )
    ninth = t.lineitem.select(
        F.col("l_orderkey").alias("scan"), F.lit("r9").alias("region"),
        (F.lit(1.5) + F.col("l_orderkey") % 7).alias("volume_mm3"),
    )
    return rows.unionByName(ninth.distinct())


@query("region_pivot", f"""WITH {REGIONS_SQL},
w AS (SELECT scan, max(CASE WHEN region = 'total intracranial' THEN volume_mm3 END) AS tiv,
             max(CASE WHEN region = 'r9' THEN volume_mm3 END) AS r9 FROM long GROUP BY 1)
SELECT scan, tiv, round(r9 / tiv, 9) AS r9_share, CAST(3 AS INTEGER) AS n_columns FROM w WHERE tiv IS NOT NULL""")
def region_pivot(t):
    wide = metrics.pivot_regions(region_rows(t), "scan")
    share = metrics.build_features(wide)["r9 / TIV"]
    return wide.select(
        "scan", F.col("`volume__total intracranial`").alias("tiv"), F.round(share, 9).alias("r9_share"),
        F.lit(len(wide.columns)).alias("n_columns"),
    )


@query("qc_filter", """
WITH q AS (SELECT l_orderkey, min(l_quantity) FILTER (WHERE l_returnflag = 'A') AS qc_min, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS qc_mean FROM lineitem GROUP BY 1)
SELECT o_orderkey AS scan, qc_min, round(qc_mean, 6) AS qc_mean FROM orders LEFT JOIN q ON o_orderkey = l_orderkey
WHERE qc_min IS NULL OR qc_min >= 10""")
def qc_filter(t):
    score = F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))
    qc = t.lineitem.select(F.col("l_orderkey").alias("scan"), score.alias("qc_score"))
    kept = metrics.qc_filter(t.orders.select(F.col("o_orderkey").alias("scan")), qc, "scan", 10.0)
    return kept.withColumn("qc_mean", F.round("qc_mean", 6))


LABEL_SQL = """
WITH s AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS w, o_orderkey % 10 = 0 AS bad FROM orders),
j AS (SELECT s.*, c.c_custkey IS NOT NULL AS known,
             CASE WHEN c.c_custkey IS NOT NULL AND (c_custkey + w) % 5 <> 0 THEN 20.0::DOUBLE + c_nationkey + w END AS age
      FROM s LEFT JOIN (SELECT *, CASE WHEN c_custkey % 9 = 0 THEN -c_custkey ELSE c_custkey END AS id FROM customer) c ON s.o_custkey = c.id)
"""


@query("age_label", LABEL_SQL + """
SELECT o_orderkey, CASE WHEN bad OR w = 0 THEN 'name did not match' WHEN NOT known THEN 'unknown participant'
       WHEN age IS NULL THEN 'age missing' END AS reason,
       CASE WHEN bad OR w = 0 OR NOT known THEN NULL ELSE round(age * 12, 4) END AS label FROM j""")
def age_label(t):
    order = F.col("o_orderkey")
    name = F.concat(
        F.lit("sub-"), F.col("o_custkey"), F.when(order % 10 == 0, "-ses-wave").otherwise("_ses-wave"), order % 4, F.lit("_T1w")
    )
    custkey = F.col("c_custkey")
    person = F.when(custkey % 9 == 0, -custkey).otherwise(custkey)
    ages = t.customer.select(F.concat(F.lit("sub-"), person).alias("participant_id"), *[
        F.when((F.col("c_custkey") + w) % 5 != 0, F.lit(20.0) + F.col("c_nationkey") + w).alias(f"wave{w}") for w in (1, 2, 3)
    ])
    long = ages.unpivot(["participant_id"], ["wave1", "wave2", "wave3"], "wave", "age").where("age IS NOT NULL")
    good, bad = metrics.label_lookup(t.orders.select("o_orderkey", name.alias("pat_id")), ages, long)
    return good.select("o_orderkey", F.lit(None).cast("string").alias("reason"), F.round("label", 4).alias("label")).unionByName(
        bad.select("o_orderkey", "reason", F.lit(None).cast("double").alias("label"))
    )


PRED_SQL = """p AS (SELECT l_linestatus, l_returnflag, l_extendedprice AS y, 1500.0::DOUBLE * l_quantity + 100 * l_linenumber AS q FROM lineitem)"""
METRIC_SQL = """round(avg(abs(q - y)), 4) AS mae, round(sqrt(avg((q - y) * (q - y))), 4) AS rmse,
  round(1 - sum((q - y) * (q - y)) / (var_pop(y) * count(*)), 6) AS r2, round(corr(y, q), 6) AS pearson_r,
  round(avg(q - y), 4) AS bias, count(*) AS n"""


def predictions(t):
    return t.lineitem.select(
        "l_linestatus", "l_returnflag", F.col("l_extendedprice").alias("y"),
        (F.lit(1500.0) * F.col("l_quantity") + 100 * F.col("l_linenumber")).alias("q"),
    )


def rounded_metrics(df):
    digits = {"mae": 4, "rmse": 4, "r2": 6, "pearson_r": 6, "bias": 4}
    return df.withColumns({k: F.round(k, d) for k, d in digits.items()})


@query("regression_metrics", f"""WITH {PRED_SQL}
SELECT l_returnflag, false AS overall, {METRIC_SQL} FROM p GROUP BY 1
UNION ALL SELECT NULL, true, {METRIC_SQL} FROM p""")
def regression(t):
    return rounded_metrics(metrics.regression_metrics(predictions(t), "y", "q", ["l_returnflag"]))


@query("mean_baseline", """
WITH b AS (SELECT l_extendedprice AS y, avg(l_extendedprice) OVER () AS q FROM lineitem)
SELECT round(avg(abs(q - y)), 4) AS mae, round(sqrt(avg((q - y) * (q - y))), 4) AS rmse,
       round(abs(avg(q - y)), 3) AS bias, count(*) AS n, CAST(NULL AS DOUBLE) AS pearson_r FROM b""")
def baseline(t):
    found = rounded_metrics(metrics.mean_baseline(t.lineitem, "l_extendedprice"))
    return found.select("mae", "rmse", F.round(F.abs("bias"), 3).alias("bias"), "n", "pearson_r")


@query("error_columns", f"""WITH {PRED_SQL}
SELECT y, q, round(q - y, 4) AS residual, round(abs(q - y), 4) AS absolute_error FROM p""")
def errors(t):
    made = metrics.error_columns(predictions(t).select("y", "q"), "y", "q")
    return made.withColumns({k: F.round(k, 4) for k in ("residual", "absolute_error")})


@query("fold_metrics", """
SELECT l_linenumber AS outer_fold, CAST(l_linenumber * 10 AS DOUBLE) AS alpha,
       round(avg(abs(1500.0::DOUBLE * l_quantity - l_extendedprice)), 4) AS mae FROM lineitem GROUP BY 1, 2""")
def folds(t):
    rows = t.lineitem.select(
        F.col("l_linenumber").alias("outer_fold"), (F.col("l_linenumber") * 10).cast("double").alias("alpha"),
        F.abs(F.lit(1500.0) * F.col("l_quantity") - F.col("l_extendedprice")).alias("absolute_error"),
    )
    return metrics.fold_metrics(rows).withColumn("mae", F.round("mae", 4))


@query("cohort_stats", """
SELECT count(*) AS n_scans, count(DISTINCT o_custkey) AS n_subjects, CAST(12 AS INTEGER) AS n_features,
       min(o_totalprice) AS age_min, max(o_totalprice) AS age_max, round(avg(o_totalprice), 4) AS age_mean FROM orders""")
def cohort(t):
    return metrics.cohort_stats(t.orders, "o_custkey", "o_totalprice", 12).withColumn("age_mean", F.round("age_mean", 4))


AUROC_SQL = """
WITH s AS (SELECT l_returnflag AS g, l_quantity AS score, l_discount > 0.05::DOUBLE AS pos FROM lineitem),
c AS (SELECT g, score, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM s GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT g AS l_returnflag, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
       round(CAST(sum(p * (below + n / 2.0::DOUBLE)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * sum(n)), 8) AS auroc FROM w GROUP BY g"""


@query("auroc_by", AUROC_SQL)
def auroc_by(t):
    rows = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("score"), (F.col("l_discount") > 0.05).alias("pos"))
    return metrics.auroc(rows, "score", "pos", ["l_returnflag"]).withColumn("auroc", F.round("auroc", 8))


@query("auroc", """
WITH s AS (SELECT n_chars AS score, quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mid FROM s)
SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg,
       round((sum(mid) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0::DOUBLE)
             / (count(*) FILTER (WHERE quality = 1) * CAST(count(*) FILTER (WHERE quality = 0) AS DOUBLE)), 8) AS auroc FROM r""")
def auroc(t):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), on="doc_id")
    return metrics.auroc(rows, "n_chars", "quality").withColumn("auroc", F.round("auroc", 8))


@query("f1_by", """
SELECT l_returnflag, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn,
       round(2.0::DOUBLE * count(*) FILTER (WHERE p AND y) / (2 * count(*) FILTER (WHERE p AND y) + count(*) FILTER (WHERE p AND NOT y)
             + count(*) FILTER (WHERE NOT p AND y)), 8) AS f1
FROM (SELECT l_returnflag, l_quantity > 20 AS p, l_discount > 0.05::DOUBLE AS y FROM lineitem) GROUP BY 1""")
def f1_by(t):
    rows = t.lineitem.select("l_returnflag", (F.col("l_quantity") > 20).alias("p"), (F.col("l_discount") > 0.05).alias("y"))
    return metrics.f1_score(rows, "p", "y", ["l_returnflag"]).withColumn("f1", F.round("f1", 8))


@query("standardize", """
SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS price, CAST(0 AS DOUBLE) AS flat
FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 2 = 0)""")
def standardize(t):
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(3.0).alias("flat"))
    return metrics.standardize(rows, ["price", "flat"], F.col("o_orderkey") % 2 == 0).withColumn("price", F.round("price", 6))


def frozen_scorer():
    """Fixed linear model over 64 features."""
    weights = np.cos(np.arange(64, dtype=np.float64))

    def score(x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ weights

    return score


@query("batch_predict", """
SELECT vec_id, label, round(sum(CAST(embedding[i] AS DOUBLE) * cos(i - 1)), 6) AS predicted_value
FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2""")
def batch_predict(t):
    scored = metrics.batch_predict(t.embeddings, frozen_scorer, "embedding", 64)
    return scored.select("vec_id", "label", F.round("predicted_value", 6).alias("predicted_value"))


def ridge_input(t):
    return t.embeddings.select("vec_id", "embedding", "label", (F.col("vec_id") % 50).alias("subject"))


RIDGE_SRC = "src AS (SELECT vec_id AS id, vec_id % 50 AS s, list_transform(embedding, lambda v: v::DOUBLE) AS x, label::DOUBLE AS y, label FROM embeddings)"


def rounded_fit(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("ridge_cv", ridge_sql(RIDGE_SRC, 64, """
SELECT id AS vec_id, s AS subject, label, outer_fold, alpha, round(predicted, 6) AS predicted,
       round(predicted - y, 6) AS residual, round(abs(predicted - y), 6) AS absolute_error FROM predicted"""))
def ridge_cv(t):
    fit = ridge_group_cv(ridge_input(t), "embedding", "label", "subject", ["vec_id"])
    found = rounded_fit(fit.predictions, "predicted", "residual", "absolute_error")
    return found.select("vec_id", "subject", "label", "outer_fold", "alpha", "predicted", "residual", "absolute_error")


@query("ridge_cv_contiguous", ridge_sql(RIDGE_SRC, 64, """
SELECT id AS vec_id, s AS subject, label, outer_fold, alpha, round(predicted, 6) AS predicted FROM predicted""", inner="contiguous"))
def ridge_cv_contiguous(t):
    fit = ridge_group_cv(ridge_input(t), "embedding", "label", "subject", ["vec_id"], inner="contiguous")
    return rounded_fit(fit.predictions, "predicted").select("vec_id", "subject", "label", "outer_fold", "alpha", "predicted")


@query("ridge_fit", ridge_sql(RIDGE_SRC, 64, """
SELECT 'x' || (i - 1) AS feature, round(v, 6) AS standardized_coefficient
FROM (SELECT unnest(range(1, 65)) AS i, unnest(w) AS v FROM fits WHERE model = 0) ORDER BY abs(v) DESC LIMIT 15"""))
def ridge_fit(t):
    fit = ridge_group_cv(ridge_input(t), "embedding", "label", "subject", ["vec_id"])
    return rounded_fit(top_coefficients(fit.coefficients, 15), "standardized_coefficient")


@query("ridge_line", """
WITH r AS (SELECT l_orderkey % 97 AS s, l_quantity AS x, l_extendedprice AS y, l_orderkey, l_linenumber FROM lineitem),
g AS (SELECT s, row_number() OVER (ORDER BY count(*) DESC, s) - 1 AS k FROM r GROUP BY s),
f AS (SELECT r.*, CASE WHEN k % 10 < 5 THEN k % 10 ELSE 9 - k % 10 END + 1 AS fold FROM r JOIN g ON r.s = g.s),
c AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM f GROUP BY fold),
a AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM c),
m AS (SELECT c.fold, a.n - c.n AS n, (a.sx - c.sx) / (a.n - c.n) AS mx, (a.sy - c.sy) / (a.n - c.n) AS my,
             (a.sxx - c.sxx) / (a.n - c.n) AS mxx, (a.sxy - c.sxy) / (a.n - c.n) AS mxy FROM c, a),
w AS (SELECT fold, mx, my, ((mxy - mx * my) / sqrt(mxx - mx * mx) * n) / (n + 3.0::DOUBLE) / sqrt(mxx - mx * mx) AS b FROM m)
SELECT CAST(f.fold AS INTEGER) AS outer_fold, count(*) AS n, round(avg(abs(my + b * (x - mx) - y)), 3) AS mae, CAST(3 AS DOUBLE) AS alpha
FROM f JOIN w ON f.fold = w.fold GROUP BY 1""")
def ridge_line(t):
    rows = t.lineitem.select(
        F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
        (F.col("l_orderkey") % 97).alias("s"),
    )
    fit = ridge_group_cv(rows, "x", "y", "s", alphas=[3.0])
    return fit.predictions.groupBy("outer_fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("absolute_error"), 3).alias("mae"), F.max("alpha").alias("alpha")
    )


PROBE_SPLIT = "CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split"


@query("probe", probe_sql(f"""src AS (
  SELECT vec_id AS id, {PROBE_SPLIT}, list_transform(embedding, lambda v: v::DOUBLE) AS x, (label >= 5)::INTEGER::DOUBLE AS y
  FROM (SELECT *, CAST('0x' || substr(md5('3-' || vec_id), 1, 8) AS BIGINT) % 100 AS b FROM embeddings)
)""", 64, [0.001, 0.01, 0.1]))
def probe(t):
    rows = t.embeddings.select(
        "embedding", (F.col("label") >= 5).cast("int").alias("y"), split_assign(F.col("vec_id"), seed=3).alias("split")
    )
    found = linear_probe(rows, "embedding", "y", "split", [0.001, 0.01, 0.1])
    return found.withColumns({c: F.round(c, 8) for c in ("val_auroc", "test_auroc")})


@query("probe_line", probe_sql(f"""src AS (
  SELECT o_orderkey AS id, {PROBE_SPLIT}, [o_totalprice] AS x, (o_orderstatus = 'F')::INTEGER::DOUBLE AS y
  FROM (SELECT *, CAST('0x' || substr(md5('5-' || o_orderkey), 1, 8) AS BIGINT) % 100 AS b FROM orders)
)""", 1, [0.01, 1.0]))
def probe_line(t):
    rows = t.orders.select(
        F.array("o_totalprice").alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        split_assign(F.col("o_orderkey"), seed=5).alias("split"),
    )
    found = linear_probe(rows, "x", "y", "split", [0.01, 1.0])
    return found.withColumns({c: F.round(c, 8) for c in ("val_auroc", "test_auroc")})


# --- metric logs ---------------------------------------------------------------------

def log_rows(t):
    return finite_log(t.events)


def finite_log(events):
    """Events as a metric log in which some values are not finite."""
    return events.select(
        F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "ts", "event_id",
        F.when(F.col("event_id") % 50 == 0, float("nan")).when(F.col("event_id") % 71 == 0, float("inf"))
        .otherwise(F.col("value")).alias("value"),
    )


FINITE_SQL = "e AS (SELECT user_id AS run, event_type AS metric, ts, event_id, value FROM events WHERE event_id % 50 <> 0 AND event_id % 71 <> 0)"


@query("meter_global", f"""WITH {FINITE_SQL}
SELECT run, metric, CAST(sum(event_id % 3 + 1) AS BIGINT) AS count, round(sum(value * (event_id % 3 + 1)) / sum(event_id % 3 + 1), 9) AS global_avg
FROM e GROUP BY 1, 2""")
def meter_global(t):
    rows = log_rows(t).withColumn("n", F.col("event_id") % 3 + 1)
    return meters.meter_global(rows, ["run", "metric"], "value", "n").withColumn("global_avg", F.round("global_avg", 9))


@query("meter_window", f"""WITH {FINITE_SQL},
w AS (SELECT *, row_number() OVER o - 1 AS step, list_sort(list(value) OVER (o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS l,
      avg(value) OVER (o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a, max(value) OVER (o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m
      FROM e WINDOW o AS (PARTITION BY run, metric ORDER BY ts, event_id))
SELECT run, metric, event_id, step, l[(len(l) - 1) // 2 + 1] AS median, round(a, 6) AS avg, m AS max, value FROM w""")
def meter_window(t):
    made = meters.meter_window(log_rows(t), ["run", "metric"], ["ts", "event_id"], "value", chunk=64)
    return made.select("run", "metric", "event_id", "step", "median", F.round("avg", 6).alias("avg"), "max", "value")


@query("metric_log", """
SELECT run, epoch, metric, round(value, 4) AS value FROM (
  SELECT user_id AS run, date_diff('day', TIMESTAMP '2024-01-01', ts) AS epoch, 'train/' || event_type AS metric, avg(value) AS value
  FROM events GROUP BY 1, 2, 3)""")
def metric_log(t):
    epoch = F.datediff("ts", F.lit("2024-01-01")).cast("bigint")
    kinds = pivot_names(t.events, "event_type")
    wide = t.events.groupBy(F.col("user_id").alias("run"), epoch.alias("epoch")).pivot("event_type", kinds).agg(F.avg("value"))
    named = wide.select("run", "epoch", *[F.col(f"`{kind}`").alias(f"train/{kind}") for kind in kinds])
    return meters.metric_log(named).withColumn("value", F.round("value", 4))


@query("eval_summary", """
SELECT l_linenumber AS epoch, count(*) AS n_train, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 4) AS "eval/A/loss",
       round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 4) AS "eval/N/loss",
       round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 4) AS "eval/R/loss" FROM lineitem GROUP BY 1""")
def eval_summary(t):
    losses = t.lineitem.select(
        F.col("l_linenumber").alias("epoch"), F.col("l_returnflag").alias("dataset"), F.col("l_extendedprice").alias("loss")
    )
    train = losses.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_train"))
    made = meters.eval_summary(losses, train=train)
    return made.withColumns({k: F.round(F.col(f"`{k}`"), 4) for k in made.columns if k.startswith("eval/")})


# --- the whole evaluation plan -------------------------------------------------------

def region_study(t):
    """``lineitem`` as region volumes of scans with participants, waves and quality scores."""
    order = F.col("l_orderkey")
    scan = F.concat(F.lit("sub-"), order % 300, F.lit("_ses-wave"), order % 3 + 1, F.lit("_o"), order)
    wide = t.lineitem.groupBy(scan.alias("pat_id")).agg(
        F.sum("l_extendedprice").alias(TOTAL_REGION), F.sum("l_quantity").alias("left"),
        (F.sum("l_tax") + 1).alias("right"), F.min("l_quantity").alias("qc_score"),
    )
    # The plan reads its long table several times, so it is written once like a source.
    rows = materialize(
        wide.unpivot(["pat_id", "qc_score"], [F.col(f"`{TOTAL_REGION}`"), "left", "right"], "region", "volume_mm3")
    )
    people = t.customer.select(F.concat(F.lit("sub-"), F.col("c_custkey") % 250).alias("participant_id")).distinct()
    ages = people.select("participant_id", F.explode(F.array(*[F.lit(f"wave{w}") for w in (1, 2, 3)])).alias("wave"))
    age = F.lit(20.0) + F.crc32("participant_id") % 60 + F.substring("wave", 5, 1).cast("int") * 4
    return rows, people, ages.withColumn("age", age)


AGE_SRC = f"""study AS (
  SELECT 'sub-' || l_orderkey % 300 AS participant_id, 'wave' || (l_orderkey % 3 + 1) AS wave,
         'sub-' || l_orderkey % 300 || '_ses-wave' || (l_orderkey % 3 + 1) || '_o' || l_orderkey AS id,
         sum(l_extendedprice) AS tiv, sum(l_quantity) AS lefts, sum(l_tax) + 1 AS rights, min(l_quantity) AS qc_min
  FROM lineitem GROUP BY l_orderkey
), people AS (
  SELECT participant_id, {crc32_sql('participant_id')} % 60 AS draw
  FROM (SELECT DISTINCT 'sub-' || c_custkey % 250 AS participant_id FROM customer)
), src AS (
  SELECT id, participant_id AS s, wave, qc_min, [lefts / tiv, rights / tiv] AS x,
         20.0::DOUBLE + draw + right(wave, 1)::INTEGER * 4 AS y
  FROM study JOIN people USING (participant_id) WHERE qc_min >= 2
)"""


@query("age_model", ridge_sql(AGE_SRC, 2, """
SELECT id AS pat_id, s AS participant_id, wave, y AS age, qc_min, round(predicted, 6) AS predicted,
       round(predicted - y, 6) AS residual, outer_fold, alpha FROM predicted"""))
def age_model_predictions(t):
    rows, people, ages = region_study(t)
    found = age_model(rows, rows, people, ages, [TOTAL_REGION, "left", "right"], min_qc=2.0)
    rounded = rounded_fit(found.predictions, "predicted", "residual")
    return rounded.select("pat_id", "participant_id", "wave", "age", "qc_min", "predicted", "residual", "outer_fold", "alpha")
