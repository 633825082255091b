"""Session settings and materialized intermediate tables."""

from __future__ import annotations

import glob
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Volumes are tens of megabytes per row, so Arrow batches are bounded by bytes, not rows.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(256 * 1024 * 1024),
}

# A shuffle gets a partition for so much input, and partitions are merged up to so much:
# sorts and hash tables of keys hold some thirty times their shuffled bytes.
INPUT_PER_PARTITION = 4 * 1024 * 1024
MERGED_PARTITION = 16 * 1024 * 1024
PARTITIONS, MERGED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"

_written: list[str] = []
_sized: set[str] = set()
_shipped: set[str] = set()


def build_session(app: str = "voxelherd", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the runtime settings of this package; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def prepare_session(spark: SparkSession) -> None:
    """Make a session somebody else built fit for this package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key in _sized:
        spark.conf.unset(key)
    _sized.clear()
    ship_package(spark)


def fit_partitions(spark: SparkSession, tables: Iterable[str]) -> None:
    """Let the number of shuffle partitions grow with the tables at these paths.

    With a fixed number, what a task sorts or holds grows with the input. Holds until
    :func:`prepare_session`; never fewer partitions than the session asks for.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in tables]
    size = sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)
    wanted = {PARTITIONS: max(size // INPUT_PER_PARTITION, int(spark.conf.get("spark.sql.shuffle.partitions"))), MERGED: MERGED_PARTITION}
    for key, value in wanted.items():
        if key in _sized or spark.conf.get(key, None) in (None, str(64 * 1024 * 1024), "67108864b", "64MB"):
            spark.conf.set(key, str(value))
            _sized.add(key)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-")
    archive = os.path.join(folder, "voxelherd.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(glob.glob(f"{package}/**/*.py", recursive=True)):
            out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the cluster.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by :func:`release`."""
    path = f"{checkpoint_root(spark)}/voxelherd-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and fixes the values of
    expressions that depend on the physical layout (partition ids). A join to such a
    table shuffles both sides itself, or broadcasts by file size; joined straight to an
    aggregation, hot keys of the other side could not be split at run time.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what :func:`materialize` and :func:`scratch_folder` made; returns how many."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
        count += 1
    return count
