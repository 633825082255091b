"""Query of the decontamination operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.llm.common import table
from voxelherd.llm.decontaminate import contamination


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten consecutive words of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), size=10)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH items AS (
  SELECT item_id, coalesce({_WORDS}, []) AS words FROM benchmark
), windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, words[i : i + size - 1] AS run, size
  FROM (SELECT *, least(10, len(words)) AS size FROM items WHERE len(words) > 0),
       unnest(range(1, len(words) - size + 2)) AS u(i)
), docs AS (
  SELECT row_number() OVER () AS no, doc_id, coalesce({_WORDS}, []) AS words FROM documents
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT no, i, size, words[i : i + size - 1] AS run
  FROM docs, sizes, unnest(range(1, greatest(len(words) - size + 2, 1))) AS u(i)
), hits AS (
  SELECT no, i, size, item FROM places JOIN windows USING (size, run)
), per_doc AS (
  SELECT no, count(DISTINCT place) AS n_hit FROM (SELECT no, unnest(range(i, i + size)) AS place FROM hits) GROUP BY no
), named AS (
  SELECT no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT no, item FROM hits) GROUP BY no
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN per_doc USING (no) LEFT JOIN named USING (no)"""
