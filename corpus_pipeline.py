"""A corpus from raw documents to token ids, in five stages.

Each stage works on all rows its predecessor kept, and all but the last return the columns
of ``documents``. Defined results: rows with null keys or texts pass through every stage by
the rules of its operator; an empty table stays empty; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.llm import bpe, decontaminate, language, simhash, suffixes
from voxelherd.llm.common import prepare, table
from voxelherd.session import materialize

# A text is rejected if its main language has less than this share of its letters.
LEAST_SHARE = 0.4
# Names of columns that live within a stage only.
OWN = "__stage_"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that no language dominates."""
    prepare(spark)
    model = language.fit(docs)
    found = language.predict(docs, model, spans=False, prefix=OWN)
    kept = found.where((F.col(OWN + "lang_pred") != language.UNKNOWN) & (F.col(OWN + "score") >= LEAST_SHARE))
    return kept.select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    A document without an id stays if no document of its group has one. Rows that repeat
    an id and text are one document.
    """
    prepare(spark)
    mark = OWN + "text"
    marked = docs.withColumn(mark, F.xxhash64("text"))
    groups = simhash.near_groups(marked, also=(mark,))
    kept = materialize(
        groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("doc_id", mark).agg(F.count(F.lit(1)).alias(OWN + "rows"))
    )
    ids = kept.select(F.col("doc_id").alias(OWN + "id"), F.col(mark).alias(OWN + "key"))
    same = F.col("doc_id").eqNullSafe(F.col(OWN + "id")) & (F.col(mark) == F.col(OWN + "key"))
    rows = marked.join(ids, same, "left_semi")
    if not kept.where(F.col(OWN + "rows") > 1).isEmpty():
        rows = rows.dropDuplicates(["doc_id", mark])
    return rows.select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes that an earlier document has; drop texts of which nothing is left.

    A character goes if some of its bytes go; ``n_chars`` is counted anew.
    """
    prepare(spark)
    found = suffixes.remove_repeats(docs, keep=docs.columns)
    left = found.where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_bytes"))))
    text = F.when(F.col("n_removed") == 0, F.col("rest.text")).otherwise(F.decode("kept", "UTF-8"))
    columns = {"text": F.col(OWN + "new"), "n_chars": F.length(OWN + "new").cast("bigint")}
    ready = left.withColumn(OWN + "new", text).select(OWN + "new", "rest.*")
    return ready.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with ten consecutive words of a benchmark item (or a whole shorter item)."""
    mark = OWN + "text"
    marked = docs.withColumn(mark, F.xxhash64("text"))
    texts = marked.select(F.col(mark).alias("doc_id"), "text")
    found = decontaminate.contamination(texts, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    gone = materialize(found.where("contaminated").select(F.col("doc_id").alias(mark)).distinct())
    return marked.join(gone, mark, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, bpe.load_tokenizer(path, public_tokenizers.PATTERN), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# Several stages are iterative or need hashes that SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
