"""Query of the sharding operator."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.llm.common import table
from voxelherd.llm.sharding import PRIME, STEP, round_keys, shard_rows


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 whose row counts differ by one at most."""
    placed = shard_rows(table(spark, sf_dir, "documents"), shards=8, seed=42)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _network_sql() -> str:
    """The rounds of the network as nested queries over ``t(…, l, r)``."""
    sql = "SELECT i, n, h, m, x >> h AS l, x & m AS r FROM walk WHERE NOT done"
    for key in round_keys(42):
        square = f"(((r + {key}) % {PRIME}) * ((r + {key}) % {PRIME}) % {PRIME})"
        sql = f"SELECT i, n, h, m, r AS l, xor(l, ({square} * {STEP} + {key}) % {PRIME} & m) AS r FROM ({sql})"
    return f"SELECT i, n, h, m, (l << h) | r AS x, ((l << h) | r) < n AS done FROM ({sql})"


# Remainders of the reflected polynomial for each byte value, made from the rule by which
# a checksum of one byte is this remainder up to two fixed terms.
_CRC_TABLE = [zlib.crc32(bytes([b])) ^ 0xFFFFFFFF ^ 0x00FFFFFF for b in range(256)]
_CRC_TABLE = [_CRC_TABLE[b ^ 0xFF] for b in range(256)]

OP4_SQL = f"""
WITH RECURSIVE bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits,
         strlen(coalesce(text, '')) AS n_bytes
  FROM documents
), sums AS (
  SELECT doc_id, n_bytes + 1 AS size,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(n_bytes), lambda j:
             (instr('0123456789ABCDEF', digits[2 * j + 1]) * 16 + instr('0123456789ABCDEF', digits[2 * j + 2]) - 17)::BIGINT)),
           lambda c, b: xor(c >> 8, {_CRC_TABLE}[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM bytes
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS i, count(*) OVER () AS n FROM sums
), sized AS (
  SELECT min(h) AS h, (1::BIGINT << min(h)) - 1 AS m
  FROM (SELECT unnest(range(1, 32)) AS h), (SELECT count(*) AS total FROM documents)
  WHERE pow(4, h) >= total
), walk AS (
  SELECT i, n, h, m, i AS x, false AS done FROM numbered, sized
  UNION ALL
  ({_network_sql()})
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(x % 8 AS INTEGER) AS shard, CAST(x // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN (SELECT i, x FROM walk WHERE done) USING (i)"""
