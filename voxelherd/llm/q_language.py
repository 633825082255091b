"""Query of the language identification operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.llm.common import table
from voxelherd.llm.language import fit_outside_fold, held_out, predict


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, by a model that has not seen the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_outside_fold(docs)
    found = predict(docs.select("doc_id", "text"), model, spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
