"""The physical plans that the operators rely on at scale."""

from pyspark.sql import functions as F

from voxelherd.operators import curation, masks, volumes
from voxelherd.operators.quality import many_to_one
from voxelherd.plans.analogs import PATCH, SHAPE, images, participants
from voxelherd.plans.analogs import volumes as volume_table
from voxelherd.plans.curate import curate
from voxelherd.plans.registry import Tables
from voxelherd.session import materialize
from voxelherd.sources.images import new_files, write_index_table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, folder, tmp_path):
    curation.add_geometry(images(Tables(spark, folder))).drop("shape", "pixdim").write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = plan_of(curation.curate_filter(curation.exclude_datasets(index, ["src3"])).select("path"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters")[1]
    assert "LessThanOrEqual(res_x,1.5)" in pushed and "GreaterThanOrEqual(fov_min,120.0)" in pushed
    assert "src3" in pushed and "md5" not in plan.split("ReadSchema")[1]


def test_curation_plan_has_no_cross_join_or_single_partition(spark, folder):
    t = Tables(spark, folder)
    plan = plan_of(curate(images(t), participants(t), ["src3"], on=("sub",)).joined)
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning(md5") == 1


def test_volume_work_needs_no_shuffle(spark, folder):
    t = Tables(spark, folder)
    normalized = volumes.masked_normalize(volume_table(t), SHAPE, PATCH)
    for df in (normalized, volumes.patchify(volume_table(t), SHAPE, PATCH, mask="mask"), masks.add_valid(volume_table(t), SHAPE, PATCH)):
        assert "Exchange" not in plan_of(df) and "BatchEvalPython" not in plan_of(df)


def skewed(spark):
    return spark.range(60_000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("batch"), F.md5(F.col("id").cast("string")).alias("pay")
    )


def run_with_small_partitions(spark, df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan_of(df)


def test_hot_lookup_key_is_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.files.maxPartitionBytes": "256KB",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        rows = materialize(skewed(spark))
        lookup = rows.groupBy("batch").agg(F.min("id").alias("m"))
        direct = run_with_small_partitions(spark, rows.join(lookup, on="batch"))
        written = run_with_small_partitions(spark, rows.join(materialize(lookup), on="batch"))
        checked = run_with_small_partitions(spark, many_to_one(rows, materialize(lookup), ["batch"]))
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" not in direct
    assert "skew=true" in written and "skew=true" in checked


def test_a_bucketed_index_is_not_shuffled(spark):
    """The daily listing goes to the index, not the index to the listing."""
    table = "index_of_test_plans"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    index = spark.range(3000).select(F.concat(F.lit("ds/f"), "id").alias("path"), F.col("id").alias("size"))
    try:
        write_index_table(index, table, 8)
        listing = spark.range(2990, 3010).select(F.concat(F.lit("ds/f"), "id").alias("path"))
        found = new_files(listing, table, 8)
        plan = plan_of(found)
        assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 8 out of 8" in plan.split("Exchange")[1]
        assert {r["path"] for r in found.collect()} == {f"ds/f{i}" for i in range(3000, 3010)}
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_hidden_patches_stay_on_their_scan(spark, folder):
    """Only the quota of the batch is shuffled, never values of patches."""
    from voxelherd.plans.q_volumes import hidden_on_scan

    scans = hidden_on_scan(Tables(spark, folder))
    base = plan_of(scans).count("Exchange")
    assert plan_of(volumes.scatter_predictions_of_scans(scans, SHAPE, PATCH)).count("Exchange") == base
    plan = plan_of(volumes.masked_mse_of_scans(scans, mask="observed"))
    assert plan.count("Exchange") == base + 1 and "Exchange SinglePartition" in plan and "partial_sum" in plan


def test_partitions_grow_with_the_tables(spark, folder, monkeypatch):
    """What a task sorts or holds is bounded: a shuffle gets more partitions from more input."""
    from voxelherd import session
    from voxelherd.plans.catalog import QUERIES

    monkeypatch.setattr(session, "INPUT_PER_PARTITION", 1000)
    QUERIES["pair_missing"](spark, folder)
    assert int(spark.conf.get(session.PARTITIONS)) > 100
    monkeypatch.undo()
    QUERIES["pair_missing"](spark, folder)
    assert int(spark.conf.get(session.PARTITIONS)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.prepare_session(spark)
    assert spark.conf.get(session.PARTITIONS, None) is None
