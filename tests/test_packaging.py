import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelherd.operators import packaging as p
from voxelherd.operators.quality import CohortDataError, fail_on_rejects
from voxelherd.sources import sinks
from voxelherd.sources.tables import list_pairs


def scans(spark):
    return spark.createDataFrame([("k1", "e1", "T1w"), ("k2", "e2", "T2w"), ("k3", "0", "T1w")], "key string, id_event string, modality string")


def masks(spark, keys):
    return spark.createDataFrame([(k, f"mask/{k}") for k in keys], "key string, mask_path string")


def metadata(spark, ids):
    return spark.createDataFrame([(i, "F") for i in ids], "id_event string, sex string")


def test_records_need_masks_and_metadata(spark):
    done = p.collect_records(scans(spark), masks(spark, ["k1", "k2", "k3"]), metadata(spark, ["e1", "e2", "0"]))
    assert done.count() == 3 and done.where("race IS NOT NULL").count() == 0
    with pytest.raises(CohortDataError, match="k3"):
        p.collect_records(scans(spark), masks(spark, ["k1", "k2"]), metadata(spark, ["e1", "e2", "0"]))
    with pytest.raises(CohortDataError, match="k2"):
        p.collect_records(scans(spark), masks(spark, ["k1", "k2", "k3"]), metadata(spark, ["e1", "0"]))
    kept = p.collect_records(scans(spark), masks(spark, ["k1", "k2", "k3"]), metadata(spark, ["e1", "0"]), allow_unmatched=True)
    report = {r["modality"]: (r["n_records"], r["n_matched"]) for r in p.record_report(kept).collect()}
    assert report == {"T1w": (2, 2), "T2w": (1, 0), None: (3, 2)}
    with pytest.raises(CohortDataError, match="duplicate"):
        p.join_metadata(scans(spark), metadata(spark, ["e1", "e1"]))


def test_work_plan_states(spark):
    have = {
        "a": [], "b": ["processed"], "c": ["processed", "transform", "seg", "volumes"],
        "d": ["processed", "transform", "seg", "volumes", "qc"], "e": ["processed", "transform", "seg", "volumes", "qc", "mask"],
    }
    files = spark.createDataFrame([(k, f) for k, kinds in have.items() for f in kinds], "key string, kind string")
    plan = p.work_plan(spark.createDataFrame([(k,) for k in have], "key string"), files)
    assert {r["key"]: r["status"] for r in plan.collect()} == {
        "a": "register", "b": "register", "c": "segment", "d": "mask_only", "e": "done",
    }


def test_folds_keep_groups_together(spark):
    rows = spark.range(900).select("id", F.when(F.col("id") < 300, "hot").otherwise((F.col("id") % 40).cast("string")).alias("g"))
    got = p.group_kfold(rows, "g", 5).toPandas()
    assert len(got) == 900 and (got.groupby("g")["fold"].nunique() == 1).all() and sorted(got["fold"].unique()) == [1, 2, 3, 4, 5]
    few = p.group_kfold(rows.where("g = 'hot'"), "g", 5).toPandas()
    assert set(few["fold"]) == {1}
    sizes = got[got["g"] != "hot"].groupby("fold").size()
    assert sizes.sum() == 600
    gaps = p.group_kfold(rows.withColumn("g", F.nullif("g", F.lit("hot"))), "g", 5).toPandas()
    assert len(gaps) == 900 and gaps[gaps["g"].isna()]["fold"].nunique() == 1


def test_split_is_stable_and_balanced(spark):
    rows = spark.range(5000).withColumn("split", p.split_assign(F.col("id")))
    share = {r["split"]: r["count"] / 5000 for r in rows.groupBy("split").count().collect()}
    assert share["train"] == pytest.approx(0.8, abs=0.03) and share["val"] == pytest.approx(0.1, abs=0.02)
    again = spark.range(5000).repartition(7).withColumn("split", p.split_assign(F.col("id")))
    assert rows.exceptAll(again).isEmpty()


@pytest.mark.parametrize("sizes, limit", [([10] * 7, 20), ([5, 100, 5, 5], 20), ([1], 20), ([20, 20, 20], 20), ([7, 9, 13, 2, 30, 1, 1, 1] * 20, 25)])
def test_shards_are_ordered_bounded_and_without_gaps(spark, sizes, limit):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k int, size int")
    got = p.plan_shards(df, ["k"], "size", limit).toPandas().sort_values("k")
    numbers = got["shard"].tolist()
    assert numbers == sorted(numbers) and set(numbers) == set(range(max(numbers) + 1))
    for _, shard in got.groupby("shard"):
        assert shard["size"].iloc[:-1].sum() < limit


def test_epoch_covers_data_and_reshuffles(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    plan = p.epoch_plan(df, "k", 1, 0, batch_size=8, block_size=10, world_size=2).toPandas().sort_values("slot")
    assert len(plan) == 96 and plan["k"].is_unique and plan["slot"].tolist() == list(range(96))
    assert (plan["batch"] == plan["slot"] // 8).all() and (plan["rank"] == plan["batch"] % 2).all()
    blocks = (plan["k"] // 10).tolist()
    assert all(len(set(blocks[i : i + 10])) == 1 for i in range(0, 90, 10))
    other = p.epoch_plan(df, "k", 1, 1, batch_size=8, block_size=10).toPandas().sort_values("slot")
    assert other["k"].tolist() != plan["k"].tolist()
    again = p.epoch_plan(df.repartition(5), "k", 1, 0, batch_size=8, block_size=10).toPandas().sort_values("slot")
    assert again["k"].tolist() == plan["k"].tolist()


def test_epoch_longer_and_shorter_than_data(spark):
    df = spark.range(30).select(F.col("id").alias("k"))
    long = p.epoch_plan(df, "k", 1, 0, epoch_size=75, batch_size=10, drop_last=False, block_size=7).toPandas()
    assert len(long) == 75 and long.groupby("pass")["k"].nunique().tolist() == [30, 30, 15]
    assert p.epoch_plan(df, "k", 1, 0, epoch_size=12, batch_size=10).count() == 10
    assert p.epoch_plan(df.limit(0), "k", 1, 0, epoch_size=12).count() == 0


def test_batches_keep_slot_order(spark):
    df = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    plan = p.epoch_plan(df, "k", 3, 0, batch_size=5, block_size=4)
    want = plan.toPandas().sort_values("slot").groupby("batch")["k"].apply(list)
    rows = p.collate(plan, df, "k", ["x"]).collect()
    for batch, keys in want.items():
        own = [row for row in rows if row["batch"] == batch]
        assert [row["k"] for row in own] == keys and all(row["x"] == 2 * row["k"] for row in own)


def test_repeated_keys_are_an_error(spark):
    images = spark.createDataFrame([("a",), ("b",)], "key string")
    twice = spark.createDataFrame([("a",), ("a",)], "key string")
    for left, right in ((images, twice), (twice, images)):
        with pytest.raises(CohortDataError, match="duplicate key"):
            p.pair_image_mask(left, right)


def test_listed_pairs(spark):
    files = spark.createDataFrame([("b",), ("a",), ("c",)], "path string")
    assert [r["path"] for r in list_pairs(files, limit=2).collect()] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        list_pairs(files.limit(0))


def test_rejects_are_counted(spark):
    with pytest.raises(CohortDataError, match="25 rejected rows"):
        fail_on_rejects(spark.range(25))


def samples(spark):
    rows = [(i // 3, f"s{i}", [float(i + j) for j in range(8)], [1, 0] * 4, [2, 2, 2], json.dumps({"id": i})) for i in range(8)]
    return spark.createDataFrame(rows, "shard long, key string, image array<float>, mask array<tinyint>, shape array<int>, meta string")


def test_shard_archives(spark, tmp_path):
    root = str(tmp_path / "shards")
    written = sinks.write_shards(samples(spark), root).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["n_samples"]) for r in written) == [
        ("shard-000000.tar", 3), ("shard-000001.tar", 3), ("shard-000002.tar", 2),
    ]
    with tarfile.open(f"{root}/shard-000001.tar") as tar:
        assert tar.getnames() == [f"s{i}.{part}" for i in (3, 4, 5) for part in ("image.npy", "mask.npy", "meta.json")]
        image = np.load(io.BytesIO(tar.extractfile("s4.image.npy").read()))
        assert image.dtype == np.float32 and image.shape == (2, 2, 2) and image[1, 1, 1] == 11
        assert json.loads(tar.extractfile("s5.meta.json").read()) == {"id": 5}
    with pytest.raises(FileExistsError):
        sinks.write_shards(samples(spark), root)
    assert sinks.write_shards(samples(spark).where("shard = 0"), root, overwrite=True).count() == 1
    assert [f.name for f in (tmp_path / "shards").iterdir()] == ["shard-000000.tar"]


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ds", {"sub": "1"}, "T1w", [1, 2], [0.5], "int16", "RAS", 3, "m", "p")],
                               "dataset string, entities map<string,string>, suffix string, shape array<int>, pixdim array<double>,"
                               "dtype string, orient string, size long, md5 string, path string")
    sinks.write_csv(sinks.index_columns(df, ["sub", "ses"]), str(tmp_path / "csv"))
    text = "".join(f.read_text() for f in (tmp_path / "csv").glob("*.csv")).splitlines()
    assert text[0] == "dataset,sub,ses,suffix,shape,pixdim,dtype,orient,size,md5,path"
    sinks.write_file_list(df, str(tmp_path / "list"))
    assert "".join(f.read_text() for f in (tmp_path / "list").glob("*.txt")) == "p\n"
    sinks.write_table(df, str(tmp_path / "t"), partition_by=["suffix"])
    assert (tmp_path / "t" / "suffix=T1w").exists()
    with pytest.raises(Exception, match="already exists"):
        sinks.write_table(df, str(tmp_path / "t"))


def test_packaging_plan(spark):
    from voxelherd.plans.pack import package

    images = spark.createDataFrame([(f"k{i}", f"e{i}", "T1w", [2, 2, 2], 10 * i) for i in range(1, 6)], "key string, id_event string, modality string, shape array<int>, bytes long")
    good = images.select("key", F.col("shape").alias("mask_shape"))
    made = package(images, good, metadata(spark, [f"e{i}" for i in range(1, 6)]), maxsize=40)
    assert {r["key"]: r["shard"] for r in made.shards.collect()} == {"k1": 0, "k2": 0, "k3": 0, "k4": 1, "k5": 2}
    bad = good.withColumn("mask_shape", F.when(F.col("key") == "k4", F.array(F.lit(1))).otherwise(F.col("mask_shape")))
    with pytest.raises(CohortDataError, match="k4"):
        package(images, bad, metadata(spark, [f"e{i}" for i in range(1, 6)]))
    assert package(images, bad, metadata(spark, [f"e{i}" for i in range(1, 6)]), check_shapes=False).records.count() == 5


def test_training_and_evaluation_batches(spark):
    from voxelherd.plans.pack import batches

    rows = [(i, [float(i)] * 8, [True] * 8, f"m{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, image array<float>, mask array<boolean>, note string")
    held = batches(df, "id", (2, 2, 2), 1, 0, False, meta=["note"], batch_size=4).collect()
    held = sorted(held, key=lambda r: r["batch"])
    assert [(r["batch"], r["id"], r["note"]) for r in held] == [(i // 4, i, f"m{i}") for i in range(10)]
    train = batches(df, "id", (2, 2, 2), 1, 0, True, batch_size=4, augmentation={"pad_range": (0, 0), "scale": (2.0, 2.0)}).collect()
    assert [sum(r["batch"] == b for r in train) for b in (0, 1)] == [4, 4] and "note" not in train[0]
    assert all(row["image"][0] == 2.0 * row["id"] for row in train)
    assert batches(df, "id", (2, 2, 2), 1, 0, True).schema["image"] == batches(df, "id", (2, 2, 2), 1, 0, False).schema["image"]


def test_failed_batches_mark_pending_scans(spark):
    plan = spark.createDataFrame([("a", 1, "segment"), ("b", 1, "done"), ("c", 2, "segment")], "key string, batch int, status string")
    failed = spark.createDataFrame([(1, "timeout")], "batch int, reason string")
    got = {r["key"]: (r["status"], r["reason"]) for r in p.mark_failures(plan, failed, "batch").collect()}
    assert got == {"a": ("failed", "timeout"), "b": ("done", None), "c": ("segment", None)}
