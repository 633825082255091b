"""Query of the WARC operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelherd.llm.common import table
from voxelherd.llm.warc import read_archives, write_archives


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to seekable archives and read the records back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    bundles, _ = write_archives(pages, least_bytes=0)
    return read_archives(bundles).drop("url", "payload")


# Base32 of a digest, five bits at a time, from its 40 hexadecimal digits.
OP8_SQL = """
WITH raw AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM raw
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (
                 (('0x' || digest[1 + (i * 5) // 4])::INTEGER * 16
                  + ('0x' || coalesce(nullif(digest[2 + (i * 5) // 4], ''), '0'))::INTEGER)
                 >> (3 - (i * 5) % 4)) % 32], '' ORDER BY i)
        FROM range(32) AS r(i)) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts"""
