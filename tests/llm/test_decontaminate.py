import random
import re

from voxelherd.llm import decontaminate
from voxelherd.llm.decontaminate import contamination, find_items, build_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(doc, items, size):
    own = words(doc)
    hit, names = set(), set()
    for name, text in items:
        test = words(text)
        if not test:
            continue
        n = min(size, len(test))
        windows = {tuple(test[i : i + n]) for i in range(len(test) - n + 1)}
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(own), len(hit), sorted(names)


def sample():
    rng = random.Random(1)
    vocabulary = ["the", "of", "Ça", "été", "a1", "x", "b", "cat", "dog", "sun"]
    items = [("7", " ".join(rng.choice(vocabulary) for _ in range(14))), ("10", "Rare WORDS here"), ("11", "rare words"),
             ("12", ""), ("13", None), ("14", "..."), ("10", "dog dog"), (None, "lonely item")]
    docs = [None, "", "!!", "Rare words, here!", "rare", "a Lonely; item", "x " * 3000 + items[0][1] + " dog dog dog"]
    docs += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    docs += ["the " + items[0][1] + " " + items[0][1]] * 3
    return docs, items


def frames(spark):
    docs, items = sample()
    rows = [(i, d, "z") for i, d in enumerate(docs)]
    d = spark.createDataFrame(rows, "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame([(n, t, 1) for n, t in items], "item_id string, text string, doc_id int")
    return docs, [(n or "", t) for n, t in items], d, b


def check(spark, size):
    docs, items, d, b = frames(spark)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in contamination(d, b, size).collect()}
    assert got == {i: brute(t, items, size) for i, t in enumerate(docs)}


def test_equal_to_brute_force(spark):
    check(spark, 3)
    check(spark, 10)


def test_several_passes_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "QUERY_WORDS", 10)
    check(spark, 3)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red big fox ran home"), (2, "red fox"), (3, "fox red and nothing")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "red fox ran")], "item_id long, text string")
    index = build_index(d)
    exact = {r.doc_id: list(r["items"]) for r in find_items(index, b, 3).collect()}
    near = {r.doc_id: list(r["items"]) for r in find_items(index, b, 3, slop=1).collect()}
    assert exact == {1: [], 2: [], 3: []}
    assert near == {1: ["5"], 2: [], 3: []}


def test_empty_tables(spark):
    docs, items, d, b = frames(spark)
    assert contamination(d.limit(0), b).count() == 0
    got = contamination(d, b.limit(0)).where("n_hit > 0 OR contaminated")
    assert got.count() == 0
