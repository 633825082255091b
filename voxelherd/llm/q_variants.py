"""Query of the spelling variant operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.llm.common import table
from voxelherd.llm.q_sharding import _CRC_TABLE
from voxelherd.llm.variants import LEAST_COUNT, LEAST_LENGTH, LETTERS, TIMES, group_variants, misspelt, runs, vocabulary
from voxelherd.session import materialize


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    found = runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = found.select(misspelt(F.col("owner"), F.col("run")).alias("word"))
    grouped = group_variants(materialize(vocabulary(words)))
    return grouped.select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = f"""
WITH RECURSIVE found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS owner,
         translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{LEAST_LENGTH},}}')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), runs AS (
  SELECT owner, run, count(*) AS times, hex(encode(owner || ':' || run)) AS digits FROM found GROUP BY owner, run
), summed AS (
  SELECT *, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(length(digits) // 2), lambda j:
             (instr('0123456789ABCDEF', digits[2 * j + 1]) * 16 + instr('0123456789ABCDEF', digits[2 * j + 2]) - 17)::BIGINT)),
           lambda c, b: xor(c >> 8, {_CRC_TABLE}[(xor(c, b) & 255) + 1]))) AS h
  FROM runs
), spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
         times
  FROM summed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}
), shorter AS (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT s.word AS a, w.word AS b FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT s.word, t.word FROM shorter s JOIN shorter t ON s.rest = t.rest AND s.i = t.i AND s.word <> t.word
), ranked AS (
  SELECT a AS word, b AS form, n AS form_n, count(*) OVER (PARTITION BY a) AS n_near,
         row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank
  FROM pairs JOIN words ON word = b
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * n THEN form END AS form,
         CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND rank = 1
), chains AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT c.word, c.next, f.form FROM chains c JOIN formed f ON c.next = f.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chains c ON f.word = c.word AND c.next IS NULL"""
