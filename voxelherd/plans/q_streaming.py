"""Queries: streaming front ends over the table files."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelherd.plans.q_evaluation import FINITE_SQL, finite_log
from voxelherd.plans.registry import query
from voxelherd.session import scratch_folder
from voxelherd.streaming.image_index import read_image_index, start_index
from voxelherd.streaming.live_meters import read_live_meters, start_live_meters
from voxelherd.streaming.live_windows import read_live_windows, start_live_windows


def table_stream(t, name: str):
    """Stream of one table, a single Parquet file or a folder of them.

    The name is a pattern: a stream takes a plain path for a folder.
    """
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/{{{name}}}.parquet")


@query("stream_meters", """
SELECT user_id AS run, event_type AS metric, count(*) AS count, round(avg(value), 9) AS global_avg FROM events GROUP BY 1, 2""")
def stream_meters(t):
    log = table_stream(t, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value")
    folder = scratch_folder(t.spark)
    start_live_meters(log, ["run", "metric"], "value", f"{folder}/out", f"{folder}/state").awaitTermination()
    return read_live_meters(t.spark, f"{folder}/out", ["run", "metric"]).withColumn("global_avg", F.round("global_avg", 9))


@query("stream_window", f"""WITH {FINITE_SQL},
w AS (SELECT *, row_number() OVER o - 1 AS step, list_sort(list(value) OVER (o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS l,
      avg(value) OVER (o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a, max(value) OVER (o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m
      FROM e WINDOW o AS (PARTITION BY run, metric ORDER BY ts, event_id))
SELECT run, metric, event_id, step, l[(len(l) - 1) // 2 + 1] AS median, round(a, 6) AS avg, m AS max, value, false AS late FROM w""")
def stream_window(t):
    folder = scratch_folder(t.spark)
    start_live_windows(
        finite_log(table_stream(t, "events")), ["run", "metric"], "ts", "event_id", "value", f"{folder}/out", f"{folder}/state"
    ).awaitTermination()
    made = read_live_windows(t.spark, f"{folder}/out")
    return made.select("run", "metric", "event_id", "step", "median", F.round("avg", 6).alias("avg"), "max", "value", "late")


@query("stream_index", """
SELECT 'd' || doc_id || '.nii' AS path, strlen(text) AS size, md5(text) AS md5,
       row_number() OVER (PARTITION BY md5(text) ORDER BY 'd' || doc_id || '.nii') > 1 AS duplicate FROM documents""")
def stream_index(t):
    content = F.encode("text", "UTF-8")
    files = table_stream(t, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id"), F.lit(".nii")).alias("path"), F.length(content).cast("bigint").alias("size"),
        content.alias("content"),
    )
    folder = scratch_folder(t.spark)
    start_index(files, f"{folder}/out", f"{folder}/state").awaitTermination()
    return read_image_index(t.spark, f"{folder}/out").select("path", "size", "md5", "duplicate")
