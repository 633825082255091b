"""Live smoothed meters: statistics of the latest values per run and metric, row by row.

Each run and metric keeps a ring of its last ``window - 1`` finite values with their places
and the number of values seen. A micro-batch brings its rows in order of their place; rings
and new rows together go through the batch operator ``meter_window``, whatever the number of
meters, and every new row gets the lower median, mean, maximum and value of the window that
ends with it. A row whose place is not after the last one of its meter came too late to enter
any window: it is put out with ``late = true`` and its value alone, and leaves the ring as it
is. So the result does not depend on how a log in order is cut into micro-batches.

Rings are a table next to the checkpoint: a micro-batch writes those of its own meters, and
every RINGS_WHOLE-th one all of them, so that no more folders than that are read. A folder is
read by later micro-batches only, and one that is repeated replaces its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelherd.operators.meters import WINDOW, meter_window
from voxelherd.operators.quality import finite_or_null
from voxelherd.session import materialize, scratch_folder

# Micro-batches from one table of all rings to the next.
RINGS_WHOLE = 50


def _same(by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"n.{name}").eqNullSafe(F.col(f"r.{name}")) for name in by])


def _measure(rows: DataFrame, by: list[str], window: int, rings: DataFrame | None) -> DataFrame:
    """Rows (``by``, ``_at``, ``_id``, step, median, avg, max, value, late) of a micro-batch."""
    chunk = max(65_536, window)
    if rings is None:
        return meter_window(rows, by, ["_at", "_id"], "_value", window, chunk).withColumn("late", F.lit(False))
    last = F.element_at("r.ring", -1)
    past = F.coalesce(F.struct(F.col("n._at"), F.col("n._id")) <= F.struct(last["_at"], last["_id"]), F.lit(False))
    marked = materialize(rows.alias("n").join(rings.alias("r"), _same(by), "left").select("n.*", past.alias("_past")))
    touched = rows.select(*by).distinct()
    kept = rings.alias("r").join(touched.alias("n"), _same(by), "left_semi").select(*by, F.inline("ring"))
    both = marked.where("NOT _past").drop("_past").unionByName(kept)
    made = meter_window(both, by, ["_at", "_id"], "_value", window, chunk)
    placed = made.alias("n").join(rings.alias("r"), _same(by), "left").where(~past)
    before = F.coalesce(F.col("seen") - F.size("ring"), F.lit(0))
    new = placed.select("n.*", F.lit(False).alias("late"), before.alias("_before"))
    new = new.withColumn("step", F.col("step") + F.col("_before")).drop("_before")
    late = marked.where("_past").select(*by, "_at", "_id", F.col("_value").alias("value"), F.lit(True).alias("late"))
    return new.unionByName(late, allowMissingColumns=True)


def _rings(made: DataFrame, by: list[str], window: int, rings: DataFrame | None, whole: bool) -> DataFrame:
    """Rings after a micro-batch: of its meters, or of all."""
    fresh = made.where("NOT late").select(*by, "step", "_at", "_id", F.col("value").alias("_value"))
    if rings is not None:
        kept = rings if whole else rings.alias("r").join(fresh.select(*by).distinct().alias("n"), _same(by), "left_semi")
        old = kept.select(*by, (F.col("seen") - F.size("ring")).alias("_before"), F.posexplode("ring").alias("_place", "_v"))
        fresh = fresh.unionByName(old.select(*by, (F.col("_before") + F.col("_place")).alias("step"), "_v.*"))
    # One value stays for its place, even if the window is of one row.
    latest = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("step").desc()))
    held = fresh.withColumn("_rank", latest).where(F.col("_rank") <= max(window - 1, 1))
    ring = F.sort_array(F.collect_list(F.struct("step", "_at", "_id", "_value")))
    return held.groupBy(*by).agg(ring.alias("_ring"), (F.max("step") + 1).alias("seen")).select(
        *by, F.transform("_ring", lambda x: F.struct(x["_at"].alias("_at"), x["_id"].alias("_id"), x["_value"].alias("_value"))).alias("ring"), "seen"
    )


def start_live_windows(
    stream: DataFrame, by: Sequence[str], at: str, number: str, value: str, out: str, checkpoint: str, window: int = WINDOW
) -> StreamingQuery:
    """Process what is there and stop; a repeated micro-batch replaces its own folders.

    Output rows: ``by``, ``at``, ``number``, step, median, avg, max, value, late. ``at`` is a
    timestamp and ``number`` a whole number that orders rows of one time. Values that are not
    finite are left out; ``step`` counts the values of a meter from 0 (null if late).
    """
    by = list(by)
    spark = stream.sparkSession
    finite = stream.withColumn("_value", finite_or_null(F.col(value))).where("_value IS NOT NULL")
    rows = finite.select(
        *by, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(number).cast("bigint").alias("_id"), "_value"
    )
    keys = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in by)
    kept = f"{keys}, ring array<struct<_at: bigint, _id: bigint, _value: double>>, seen bigint, batch bigint"

    def rings_before(batch_id: int) -> DataFrame | None:
        first = (batch_id - 1) // RINGS_WHOLE * RINGS_WHOLE
        folders = [f"{checkpoint}/rings/{n}" for n in range(first, batch_id)]
        if not folders:
            return None
        found = spark.read.schema(kept).parquet(*folders)
        latest = found.groupBy(*by).agg(F.max_by(F.struct("ring", "seen"), "batch").alias("_r"))
        return materialize(latest.select(*by, "_r.*"))

    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch's own session plans without measured sizes.
        path = scratch_folder(spark)
        batch.write.parquet(path)
        new = spark.read.schema(batch.schema).parquet(path)
        rings = rings_before(batch_id) if batch_id else None
        folder = f"{out}/batch_id={batch_id}"
        _measure(new, by, window, rings).select(
            *by, F.timestamp_micros("_at").alias(at), F.col("_id").alias(number), "step", "median", "avg", "max", "value", "late"
        ).write.mode("overwrite").parquet(folder)
        made = spark.read.parquet(folder).withColumn("_at", F.unix_micros(at)).withColumn("_id", F.col(number))
        whole = batch_id % RINGS_WHOLE == 0
        after = _rings(made, by, window, rings, whole).withColumn("batch", F.lit(batch_id).cast("bigint"))
        after.write.mode("overwrite").parquet(f"{checkpoint}/rings/{batch_id}")

    return (
        rows.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_live_windows(spark: SparkSession, out: str) -> DataFrame:
    """All rows so far."""
    return spark.read.parquet(out).drop("batch_id")
