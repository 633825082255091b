import random
import zlib
from collections import Counter
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import differences
from voxelherd.llm.q_variants import OP12_SQL, op12_spelling_variants
from voxelherd.llm.variants import FIRST, LAST, PositionIndex, group_variants, misspelt, near_words, runs, vocabulary


def one_edit(a, b):
    """Whether b comes from a by exactly one inserted, deleted or replaced code point, by trying all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(words):
    """Near words by trying all pairs, forms and roots by the definition."""
    out = {}
    for a, n in words.items():
        near = sorted(((-words[b], b) for b in words if one_edit(a, b)))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        out[a] = (n, len(near), form, words.get(form))
    roots = {}
    for a in words:
        root = a
        while out[root][2]:
            root = out[root][2]
        roots[a] = root
    return {a: (*out[a], roots[a]) for a in words}


def made_up(seed, size, letters="abc"):
    random.seed(seed)
    words = {}
    while len(words) < size:
        word = "".join(random.choice(letters) for _ in range(random.randint(7, 10)))
        words[word] = random.choice([2, 3, 5, 40, 41, 900])
    return words


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def got(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("side", [FIRST, LAST])
def test_index_against_all_pairs(side):
    for m in (7, 8, 11):
        random.seed(m)
        words = sorted({"".join(random.choice("abé") for _ in range(random.choice([m, m + 1]))) for _ in range(300)})
        index = PositionIndex(words, [random.randint(2, 5) for _ in words], m)
        number, first = index.near(words, side)
        for word, n, place in zip(words, number, first):
            near = [i for i, x in enumerate(index.words) if one_edit(word, x) and min(len(word), len(x)) == m]
            near = [i for i in near if (index.words[i][: m // 2] == word[: m // 2]) == (side == FIRST)]
            assert n == len(near) and place == (near[0] if near else -1)


def test_groups_against_all_pairs(spark):
    words = made_up(1, 700) | {"aaaaaaa": 10**12, "aaaaaab": 10**10, "aaaaabb": 10**8, "aaaabbb": 10**6, "aaabbbb": 10**4, "aabbbbb": 10**2}
    assert got(group_variants(frame(spark, words))) == expected(words)


def test_large_cells_in_parts(spark):
    words = made_up(2, 500, "ab")
    want = {a: x[:2] for a, x in expected(words).items()}
    assert {r.word: (r.n, r.n_near) for r in near_words(frame(spark, words), 7).collect()} == want
    assert got(group_variants(frame(spark, words), 7)) == expected(words)


def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert differences(op12_spelling_variants(spark, folder), con, OP12_SQL) is None


def test_runs_damage_and_edges(spark):
    long = "ab" * 500_000
    texts = {1: "Grünlich GRÜNLICH, schön-grünlich2grünlichst", 2: None, 3: "", 4: "kurz", 5: "÷×ßÀÁabcÿ " * 40, 6: long + " " + long, None: "Wörterbuch"}
    rows = [(i, t, "w", 1, "r") for i, t in texts.items()] + [(1, texts[1], "w", 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, run string")
    made = runs(df).select(misspelt(F.col("owner"), F.col("run")).alias("word"))
    want = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in vocabulary(made).collect()} == want
    assert long in want and got(group_variants(vocabulary(made)))[long] == (2, 0, None, None, long)
    assert vocabulary(runs(df.limit(0)).select(F.col("run").alias("word"))).count() == 0


def test_no_words(spark):
    assert got(group_variants(frame(spark, {"aaaaaaa": 2}).limit(0))) == {}


def test_long_near_words(spark):
    words = {"x" * 3000: 2, "x" * 3001: 50, "x" * 2999 + "y": 3}
    assert got(group_variants(frame(spark, words))) == expected(words)
