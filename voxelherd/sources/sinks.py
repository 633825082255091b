"""Sinks: tables, file lists, shard archives, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.operators.packaging import shard_name
from voxelherd.operators.quality import pivot_names
from voxelherd.session import scratch_folder, ship_package
from voxelherd.sources.shards import ShardSource
from voxelherd.sources.volumes import build_samples

# Column order of the exported tables.
INDEX_TAIL = ("suffix", "shape", "pixdim", "dtype", "orient", "size", "md5", "path")
PREDICTION_COLUMNS = (
    "pat_id", "participant_id", "wave", "scan", "age", "synthseg_qc_min", "synthseg_qc_mean", "predicted_age",
    "residual", "absolute_error", "outer_fold", "alpha",
)


def save_mode(overwrite: bool) -> str:
    """Existing output is an error unless it may be replaced."""
    return "overwrite" if overwrite else "errorifexists"


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = ()) -> None:
    df.write.mode(save_mode(overwrite)).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, overwrite: bool = False) -> None:
    """CSV with a header; lists become their JSON text."""
    names = list(columns or df.columns)
    flat = [
        F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c)
        for c in names
    ]
    df.select(*flat).write.mode(save_mode(overwrite)).csv(path, header=True)


def index_columns(df: DataFrame, entities: Sequence[str] | None = None) -> DataFrame:
    """Index in export form: dataset, one column per entity, then the fixed tail.

    All entities of the data are exported; with ``entities`` given, another one is an error.
    """
    entities = pivot_names(df.select(F.explode(F.map_keys("entities")).alias("entity")), "entity", entities)
    return df.select("dataset", *[F.col("entities")[e].alias(e) for e in entities], *INDEX_TAIL)


def write_file_list(df: DataFrame, path: str, column: str = "path", overwrite: bool = False) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(save_mode(overwrite)).text(path)


def write_report(report: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON document, see ``report_json``."""
    report.coalesce(1).write.mode(save_mode(overwrite)).text(path)


def write_file_shards(
    plan: DataFrame, source: str, root: str, pattern: str = "shard-%06d.tar", overwrite: bool = False
) -> DataFrame:
    """Read the files of a plan in the tasks that write their shards; no voxel is shuffled.

    ``plan`` has shard, key, image_path, mask_path and meta. A sample that cannot be
    built is an error: the shard plan counts on it.
    """
    placed = plan.repartition("shard").sortWithinPartitions("shard", "key")
    samples = build_samples(placed, source, fail=True)[0]
    return write_shards(samples, root, pattern, overwrite, placed=True)


def write_shards(
    samples: DataFrame, root: str, pattern: str = "shard-%06d.tar", overwrite: bool = False, placed: bool = False
) -> DataFrame:
    """Write one tar per shard and return what was written: path, n_samples, bytes.

    ``samples`` has shard, key, image, mask, shape and meta (JSON text). A shard is
    bounded by the shard plan; its rows are streamed into the archive in key order, one
    Arrow batch at a time. Archives appear under their names when all are complete, see
    ``shards``; shards of an earlier run that are not replaced are deleted then. Rows
    that are ``placed`` have each shard in one partition already, in key order.
    """
    spark = samples.sparkSession
    if "://" not in root and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{root} has no scheme: on a cluster it would be a disk of each executor")
    target, base = fs.FileSystem.from_uri(root)
    if not overwrite and target.get_file_info(base).type != fs.FileType.NotFound:
        present = [f for f in target.get_file_info(fs.FileSelector(base)) if f.path.endswith(".tar")]
        if present:
            raise FileExistsError(f"{len(present)} shards already in {root}")
    named = samples.select(
        shard_name(F.col("shard"), pattern).alias("name"), F.col("key").cast("string").alias("key"),
        F.col("image").cast("array<float>").alias("image"), F.col("mask").cast("array<tinyint>").alias("mask"),
        F.col("shape").cast("array<int>").alias("shape"), "meta",
    )
    rows = named if placed else named.repartition("name").sortWithinPartitions("name", "key")
    ship_package(spark)
    spark.dataSource.register(ShardSource)
    manifest = scratch_folder(spark)
    mode = "overwrite" if overwrite else "append"
    rows.write.format(ShardSource.name()).mode(mode).option("manifest", manifest).save(root)
    return spark.read.schema("path string, n_samples bigint, bytes bigint").json(manifest)
