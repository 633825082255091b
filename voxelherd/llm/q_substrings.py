"""Query of the substring dedup operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.llm.common import table
from voxelherd.llm.substrings import remove_repeats


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside windows of 50 words that start in an earlier document."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50, texts=False)
    return found.select("doc_id", "n_words", "n_removed", F.decode("kept", "UTF-8").alias("kept_sha256"))
