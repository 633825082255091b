import hashlib
import random
import re

import pytest

from voxelherd.llm import blocks
from voxelherd.llm.q_substrings import op10_substring_dedup
from voxelherd.llm.substrings import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    least = {}
    split = [(key, WORD.findall(text or "")) for key, text in rows]
    for key, words in split:
        if key is not None:
            for i in range(len(words) - window + 1):
                run = tuple(words[i : i + window])
                least[run] = min(least.get(run, key), key)
    out = []
    for key, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if key is not None and least[tuple(words[i : i + window])] < key:
                gone |= set(range(i, i + window))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(6)
    new = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    passage, other = new(70), new(55)
    rows = [(5, None), (6, ""), (7, "é 🙂 \t x"), (None, " ".join(passage)), (8, "Nd, " * 400), (9, "Nd, " * 60), (10, "a b " * 100)]
    for i in range(20, 60):
        rows.append((i, " ".join(new(rng.randint(0, 120)) + passage + new(rng.randint(0, 120)))))
    for i in range(60, 70):
        words = new(30) + other + passage[:49] + new(5) + passage[10:62]
        rows.append((i, " ".join(words)))
    rows += [(rng.randint(20, 69), rows[k][1]) for k in range(10, 40)] + [rows[12]] * 3
    near = new(400)
    for i in range(100, 130):
        words = list(near)
        words[rng.randrange(400)] = "edit"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [50, 7])
def test_equal_to_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 10_000)
    rows = sample()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in remove_repeats(df, window).collect()), key=str)
    assert got == brute(rows, window)


def test_whole_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = [(k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in brute(rows, 50)]
    got = [tuple(r) for r in op10_substring_dedup(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tables_are_dropped(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert remove_repeats(docs).count() == 1
    assert blocks.drop_tables(spark) >= 1 and blocks.drop_tables(spark) == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("voxelherd_blocks_")]


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
