"""Live metric meters: running totals per run and metric from a growing log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelherd.operators.quality import finite_or_null


def start_live_meters(
    stream: DataFrame, by: Sequence[str], value: str, out: str, checkpoint: str, weight: str | None = None,
    compact_every: int = 100,
) -> StreamingQuery:
    """Keep sum and count of the finite values per group; process what is there, stop.

    Only changed groups are written per micro-batch, into a folder that a repeated
    batch replaces. Every ``compact_every`` batches the folders become one.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    finite = stream.withColumn("_value", finite_or_null(F.col(value))).where("_value IS NOT NULL")
    totals = finite.groupBy(*by).agg(F.sum(F.col("_value") * n).alias("total"), F.sum(n).alias("count"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}/merged=0")
        if (batch_id + 1) % compact_every == 0:
            compact_live_meters(batch.sparkSession, out, by)

    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _latest(updates: DataFrame, by: Sequence[str]) -> DataFrame:
    return updates.withColumn("_at", F.struct("batch_id", "merged")).groupBy(*by).agg(
        F.max_by("total", "_at").alias("total"), F.max_by("count", "_at").alias("count")
    )


def compact_live_meters(spark: SparkSession, out: str, by: Sequence[str]) -> int:
    """Put the latest totals of all groups into one folder; returns how many folders went.

    The merged folder is complete before others go, and both say the same, so nothing is
    lost or counted twice if the job ends in between; one that was not completed is made
    again from the others.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def at(name: str):
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(conf), path

    updates = spark.read.parquet(out)
    batches = [r["batch_id"] for r in updates.select("batch_id").distinct().collect()]
    last = max(batches)
    merged = f"{out}/batch_id={last}/merged=1"
    store, mark = at(f"{merged}/_SUCCESS")
    if not store.exists(mark):
        others = updates.where((F.col("batch_id") < last) | (F.col("merged") == 0))
        _latest(others, by).write.mode("overwrite").parquet(merged)
    gone = 0
    for name in [f"{out}/batch_id={b}" for b in batches if b != last] + [f"{out}/batch_id={last}/merged=0"]:
        store, path = at(name)
        gone += bool(store.delete(path, True))
    return gone


def read_live_meters(spark: SparkSession, out: str, by: Sequence[str]) -> DataFrame:
    """Latest totals per group with their mean."""
    latest = _latest(spark.read.parquet(out), by)
    return latest.select(
        *by, "count", F.try_divide(F.col("total"), F.col("count").cast("double")).alias("global_avg")
    )
