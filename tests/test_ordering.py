import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxelherd.operators.sketches import merge_sketches, quantile_sketches, sketch_quantiles, sketch_rank
from voxelherd.session import materialize
from voxelherd.operators.ordering import (
    batch_slice, dedup_first, exact_quantiles, first_n, ordered_prefix, sorted_curve,
)


def hot_frame(n=3000, seed=0):
    """One group holds more than a third of the rows, one key is null."""
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 50, n).astype(str)).astype(object)
    group[rng.random(n) < 0.05] = None
    return pd.DataFrame({"g": group, "k": rng.permutation(n), "v": rng.integers(0, 40, n)})


@pytest.mark.parametrize("slices", [None, 1, 8, 40])
def test_prefix_matches_pandas(spark, slices):
    data = hot_frame()
    got = ordered_prefix(
        spark.createDataFrame(data), ["k"], ["g"], {"before": F.col("v")}, slices, totals=True
    ).toPandas().sort_values("k")
    want = data.sort_values("k")
    groups = want.groupby("g", dropna=False)
    assert got["position"].tolist() == groups.cumcount().tolist()
    assert got["before"].tolist() == (groups["v"].cumsum() - want["v"]).tolist()
    assert got["before_total"].tolist() == groups["v"].transform("sum").tolist()


def test_prefix_without_group(spark):
    data = hot_frame()
    got = ordered_prefix(spark.createDataFrame(data), [F.col("k").desc()], sums={"before": F.col("v")}, slices=5)
    got = got.toPandas().sort_values("k", ascending=False)
    assert got["position"].tolist() == list(range(len(data)))
    assert got["before"].tolist() == (got["v"].cumsum() - got["v"]).tolist()


def test_hot_group_is_cut_into_slices(spark):
    hot = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("k"))
    placed = ordered_prefix(hot, ["k"], ["g"], slices=8)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan
    sizes = placed.sparkSession.read.parquet(placed.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_slice").count().toPandas()
    assert len(sizes) == 8 and sizes["count"].max() < 1000
    assert placed.agg(F.max("position")).first()[0] == 3999


def test_slices_follow_the_size_of_the_data(spark):
    def count(n):
        rows = spark.range(n).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("pay"))
        placed = ordered_prefix(rows, ["k"])
        assert placed.agg(F.max("position"), F.countDistinct("position")).first() == (n - 1, n)
        return len(placed.inputFiles())

    assert count(100) == 1 and count(400_000) > 4


def test_empty_frame(spark):
    assert ordered_prefix(spark.range(0), ["id"], sums={"s": F.col("id")}).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, numbers):
    df = spark.createDataFrame([(x,) for x in numbers], "x int")
    known = [x for x in numbers if x is not None]
    got = exact_quantiles(df, "x", (0.0, 0.3, 0.5, 1.0)).first()
    want = np.quantile(known, (0.0, 0.3, 0.5, 1.0)) if known else [None] * 4
    assert list(got) == pytest.approx(list(want)) if known else list(got) == [None] * 4


def test_grouped_quantiles(spark):
    data = hot_frame()
    got = exact_quantiles(spark.createDataFrame(data), "v", (0.25, 0.9), ["g"]).toPandas().set_index("g")
    for name, part in data.groupby("g", dropna=False):
        row = got[got.index.isna()].iloc[0] if name is None or name != name else got.loc[name]
        assert row["p25"] == pytest.approx(part["v"].quantile(0.25)) and row["p90"] == pytest.approx(part["v"].quantile(0.9))


@pytest.mark.parametrize("n, points", [(1, 5), (2, 5), (3, 200), (500, 7), (1000, 200)])
def test_curve(spark, n, points):
    numbers = np.random.default_rng(n).integers(0, 50, n)
    got = sorted_curve(spark.createDataFrame([(int(x),) for x in numbers], "x int"), "x", points).toPandas().sort_values("point")
    ranks = [i * (n - 1) // (points - 1) for i in range(points)]
    assert got["x"].tolist() == np.sort(numbers)[ranks].tolist()


def test_batches_cover_everything_once(spark):
    df = spark.range(103).select((F.col("id") * 37 % 103).alias("k"))
    parts = [[r["k"] for r in batch_slice(df, ["k"], b, 25).orderBy("k").collect()] for b in range(6)]
    assert [x for p in parts for x in p] == list(range(103)) and len(parts[4]) == 3 and parts[5] == []


def test_first_n_needs_enough_rows(spark):
    df = spark.range(5)
    assert [(r["id"], r["index"]) for r in first_n(df, ["id"], 3).collect()] == [(0, 1), (1, 2), (2, 3)]
    with pytest.raises(PySparkException, match="expected 9 rows, found 5"):
        first_n(df, ["id"], 9).collect()


def test_dedup_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    for null_equal in (True, False):
        plan = dedup_first(df, ["k"], ["id"], null_equal)._jdf.queryExecution().executedPlan().toString()
        assert "row_number(), 1, Partial" in plan and plan.count("Exchange") == 1


# --- sketches ------------------------------------------------------------------------

def test_merged_sketches_keep_their_rank_error(spark):
    """Fifty datasets of unlike size and place, one of them a third of all rows."""
    rng = np.random.default_rng(4)
    group = np.where(rng.random(120_000) < 1 / 3, 0, rng.integers(1, 50, 120_000))
    values = rng.normal(group * 3.0, 20.0)
    df = spark.createDataFrame(pd.DataFrame({"g": group, "v": values})).repartition(16)
    stored = materialize(quantile_sketches(df, "v", ["g"]))
    assert stored.count() == 50 and stored.agg(F.max(F.length("sketch"))).first()[0] < 40_000
    row = sketch_quantiles(merge_sketches(stored), (0.01, 0.25, 0.5, 0.75, 0.99), names=list("abcde")).first()
    ordered = np.sort(values)
    assert row["n"] == len(values)
    for name, p in zip("abcde", (0.01, 0.25, 0.5, 0.75, 0.99)):
        assert abs(np.searchsorted(ordered, row[name], side="right") / len(values) - p) < 0.01
    later = df.where("g < 5").withColumn("v", F.col("v") + 500)
    both = merge_sketches(stored.unionByName(quantile_sketches(later, "v", ["g"])), ["g"])
    assert both.where("g = 0").first()["n"] == 2 * int((group == 0).sum())
    middle = both.where("g = 0").select(sketch_rank(F.col("sketch"), F.lit(250.0)).alias("r")).first()["r"]
    assert abs(middle - 0.5) < 0.01


def test_small_sketches_are_exact_and_nulls_are_left_out(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", None), ("a", 2), ("b", None)], "g string, v int")
    got = [tuple(r) for r in sketch_quantiles(quantile_sketches(df, "v", ["g"]), (0.0, 0.5, 1.0), ["g"]).collect()]
    assert got == [("a", 3, 1.0, 2.0, 3.0)]
    assert quantile_sketches(df.limit(0), "v", ["g"]).count() == 0 and quantile_sketches(df.where("v IS NULL"), "v").count() == 0
