import public_tokenizers as tokens
import pytest

import corpus_pipeline
from corpus_pipeline import STAGES, decontamination, language_id, simhash_dedup, suffix_dedup, tokens as last_stage
from tests.llm import test_decontaminate, test_simhash, test_suffixes
from tests.llm.test_bpe import reference  # noqa: F401
from voxelherd.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return {(r.doc_id, r.text): r for r in df.collect()}


@pytest.fixture(scope="module")
def results(spark, folder):
    """Input and result of every stage, as lists of rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for name, stage in STAGES:
        made = materialize(stage(spark, docs, folder))
        out.append((name, docs.collect(), made.collect(), made.columns))
        docs = made
    return out


def test_columns_and_rows(results):
    assert [name for name, *_ in results] == ["language_id", "simhash_dedup", "suffix_dedup", "decontamination", "tokens"]
    assert all(columns == COLUMNS for *_, columns in results[:-1])
    for (_, before, after, _), (_, following, *_) in zip(results, results[1:]):
        assert sorted(map(str, after)) == sorted(map(str, following)) and len(after) <= len(before)


def test_language_stage(results):
    _, before, after, _ = results[0]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert all(len(r.text.split()) < 20 or not any(map(str.isalpha, r.text)) for r in before if r.doc_id in gone)


def test_near_dedup_stage(results):
    _, before, after, _ = results[1]
    ids = [r.doc_id for r in before]
    groups = test_simhash.brute_groups([test_simhash.brute_print(r.text) for r in before], ids)
    assert {r.doc_id for r in after} == set(groups)


def test_suffix_stage(results):
    _, before, after, _ = results[2]
    want = {}
    for key, size, removed, _, kept in test_suffixes.brute([(r.doc_id, r.text) for r in before], 50):
        if not removed or removed < size:
            want[key] = kept.decode(errors="ignore")
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if r.doc_id in want)


def test_decontamination_stage(spark, folder, results):
    _, before, after, _ = results[3]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before if not test_decontaminate.brute(r.text, items, 10)[1]}
    assert {r.doc_id for r in after} == clean


def test_last_stage(results, reference):  # noqa: F811
    _, before, after, _ = results[4]
    got = {r.doc_id: list(r.ids) for r in after}
    assert got == {r.doc_id: reference.encode_ordinary(r.text) for r in before}
    assert tokens.PATTERN


def edge_docs(spark, folder):
    text = "a first sentence of plain words that is long enough to be kept by every stage of it"
    rows = [(None, text + " null key", None, None, None, 1), (1, None, "en", "s", 0, 1), (2, "", "en", "s", 0, 1), (3, "123", "en", "s", 3, 1),
            (4, text, "en", "s", 5, 1), (4, text, "en", "s", 5, 1), (5, text, "de", "s", 5, 1), (6, "word " * 30_000, "en", "s", 9, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __rows int")


def test_edge_rows_and_clashing_columns(spark, folder):
    docs = edge_docs(spark, folder).withColumnRenamed("__rows", "rest").withColumn("block", docs_literal())
    found = materialize(language_id(spark, docs, folder))
    assert sorted(map(str, (r.doc_id for r in found.collect()))) == sorted(map(str, [None, 4, 4, 5, 6]))
    found = materialize(simhash_dedup(spark, found, folder))
    assert sorted(map(str, (r.doc_id for r in found.collect()))) == sorted(map(str, [None, 4, 6]))
    assert found.columns == docs.columns
    found = materialize(suffix_dedup(spark, found, folder))
    assert found.columns == docs.columns and found.count() == 3
    found = materialize(decontamination(spark, found, folder))
    assert found.columns == docs.columns and found.count() == 3
    assert last_stage(spark, found, folder).count() == 3


def docs_literal():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_empty_documents(spark, folder):
    docs = edge_docs(spark, folder).limit(0)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, folder))
    assert docs.count() == 0
    assert corpus_pipeline.ORACLE_SQL is None
