"""Query of the SimHash operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.llm.common import table
from voxelherd.llm.simhash import near_groups


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links are 4 or fewer differing bits."""
    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lpad(F.lower(F.hex("simhash")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
