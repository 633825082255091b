"""Query of the BPE operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxelherd.llm.bpe import load_tokenizer, round_trip
from voxelherd.llm.common import table


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), load_tokenizer(ranks, public_tokenizers.PATTERN))
