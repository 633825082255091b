"""Query of the MinHash operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelherd.llm.common import table
from voxelherd.llm.minhash import with_groups


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, how alike they are, and near-duplicate groups."""
    return with_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
