"""Query of the suffix-array dedup operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.llm.common import table
from voxelherd.llm.suffixes import remove_repeats


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document outside 50-byte strings that start in an earlier document."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50, texts=False)
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.decode("kept", "UTF-8").alias("kept_sha256")
    )
