import itertools
import random
import zlib

import numpy as np
import pytest

from voxelherd.llm import language
from voxelherd.llm.language import PENALTY, WORD, Labeller, fit, fit_outside_fold, predict, script_of, trigrams, viterbi
from voxelherd.llm.q_language import op3_language_id


def best_path(scores, penalty):
    paths = itertools.product(range(scores.shape[1]), repeat=len(scores))
    value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in paths), value


def test_viterbi_against_all_paths():
    rng = np.random.RandomState(0)
    sizes = np.array([3, 0, 6, 1, 5])
    scores = rng.normal(size=(sizes.sum(), 3)) * 3
    starts = np.cumsum(sizes) - sizes
    labels = viterbi(scores, starts, sizes, 2.0)
    for a, n in zip(starts, sizes):
        most, value = best_path(scores[a : a + n], 2.0)
        assert abs(value(labels[a : a + n]) - most) < 1e-9


def test_held_out_accuracy(spark, folder):
    got = op3_language_id(spark, folder).collect()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    judged = [r for r in got if r.held_out and any(c.isalpha() for c in truth[r.doc_id].text)]
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in judged)
    assert right / len(judged) >= 0.95


def training(spark):
    en, de = "the house and the garden with this thing", "der garten und das haus mit diesem ding"
    ru = "дом и сад с этой вещью"
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_spans_scripts_and_edges(spark):
    model = fit(training(spark))
    assert model.languages == ["de", "en", "ru"]
    assert [script_of(w) for w in ("house", "дом", "漢字", "λόγος", "1a", "²")] == ["latin", "cyrillic", "han", "greek", "latin", "other"]
    mixed = "the house and the garden und das haus mit diesem garten дом и сад"
    rows = [(1, mixed), (2, None), (3, ""), (4, "12 ² !!"), (5, "дом"), (6, "漢字"), (7, "the house " * 5000), (8, mixed)]
    df = spark.createDataFrame([(*r, "src", 9) for r in rows], "doc_id long, text string, lang_pred string, score int")
    got = {r.doc_id: r for r in predict(df, model).collect()}
    assert [(s.lang, s.first, s.stop) for s in got[1].spans] == [("en", 0, 5), ("de", 5, 11), ("ru", 11, 14)]
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and [got[i].score for i in (2, 3, 4)] == [0.0] * 3
    assert got[5].lang_pred == "ru" and got[7].lang_pred == "en" and got[6].lang_pred in model.languages
    assert (got[1].lang_pred, got[1].score) == (got[8].lang_pred, got[8].score)
    assert predict(df.limit(0), model).count() == 0


@pytest.mark.parametrize("codes", [0, 1 << 22])
def test_words_of_many_texts_by_the_rule(spark, monkeypatch, codes):
    """Words are scored from code points, as if each were cut out and scored alone."""
    monkeypatch.setattr(language, "MOST_CODES", codes)
    model = fit(training(spark))
    rng = random.Random(5)
    odd = "aehtsAEΣσςİıé\u0301²½ⅷ_09 .-\n|дом漢字𝔘ﬁ\U0001F600"
    texts = ["", "the house und дом", "²a b² ΑΣ Σ", "İstanbul"] + ["".join(rng.choices(odd, k=rng.randint(0, 40))) for _ in range(300)]
    scores, letters, sizes = Labeller(model, PENALTY).words(texts)
    words = [WORD.findall(text.lower()) for text in texts]
    assert sizes.tolist() == [len(own) for own in words]
    want = []
    for word in itertools.chain(*words):
        own = model.scores[[model.grams.get(gram, len(model.grams)) for gram in trigrams(word)]].sum(axis=0)
        allowed = model.scripts.get(script_of(word), np.zeros(3, dtype=bool))
        own = np.where(allowed, own, -1e6) if allowed.any() else own * 0
        want.append(own - own.max())
    assert np.allclose(scores, want, atol=1e-4)
    assert letters.tolist() == [sum(map(str.isalpha, word)) for word in itertools.chain(*words)]


def test_nothing_to_learn(spark):
    df = training(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    got = predict(df, fit_outside_fold(df)).select("lang_pred", "score").distinct().collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
