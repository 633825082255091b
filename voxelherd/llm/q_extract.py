"""Query of the main text operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.llm.common import table
from voxelherd.llm.extract import extract_text


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars")
    )
