import hashlib
import random

import numpy as np
import pytest
import zstandard

from voxelherd.llm import blocks, suffixes
from voxelherd.llm.bwt import insert_columns
from voxelherd.llm.q_suffixes import op1_suffix_dedup
from voxelherd.llm.suffixes import remove_repeats


def brute(rows, window):
    least = {}
    raw = [(key, (text or "").encode()) for key, text in rows]
    for key, text in raw:
        if key is not None:
            for i in range(len(text) - window + 1):
                run = text[i : i + window]
                least[run] = min(least.get(run, key), key)
    out = []
    for key, text in raw:
        gone = bytearray(len(text))
        for i in range(len(text) - window + 1):
            if key is not None and least[text[i : i + window]] < key:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((key, len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone) if not g)))
    return sorted(out, key=str)


def test_transform_and_prefixes():
    rng = random.Random(3)
    documents = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(40)] + [b"abab"] * 3
    got = insert_columns(documents)
    every = sorted(((d[len(d) - n :], n) for d in documents for n in range(len(d) + 1)), key=lambda x: x[0])
    suffix = [documents[o][len(documents[o]) - n :] for o, n in zip(got["owner"], got["length"])]
    assert suffix == [s for s, _ in every]

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert got["shared"][1:].tolist() == [shared(a, b) for a, b in zip(suffix, suffix[1:])]
    for owner, n, before in zip(got["owner"], got["length"], got["before"]):
        text = documents[owner]
        assert before == (256 if n == len(text) else text[len(text) - n - 1])


def sample():
    rng = random.Random(6)
    new = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, other = new(90), new(55)
    rows = [(5, None), (6, ""), (7, "é 🙂 \t x"), (None, passage), (8, "Nd, " * 400), (9, "Nd, " * 60), (10, "a b " * 100)]
    for i in range(20, 80):
        rows.append((i, new(rng.randint(0, 120)) + passage + new(rng.randint(0, 120))))
    for i in range(80, 90):
        rows.append((i, new(30) + other + passage[:49] + new(5) + passage[10:62]))
    rows += [(rng.randint(20, 89), rows[k][1]) for k in range(10, 40)] + [rows[12]] * 3
    near = new(600)
    for i in range(100, 150):
        at = rng.randrange(600)
        rows.append((i, near[:at] + "#" + near[at:]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [50, 24])
def test_equal_to_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 10_000)
    rows = sample()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, window).collect()), key=str)
    assert got == brute(rows, window)


def test_blocks_and_buckets_grow_with_the_table(spark, monkeypatch):
    """Rows sent at a level are blocks times buckets; documents of 3,000 bytes."""
    for n, rows, bits in ((250_000, 1024, 8), (3_000_000, 2048, 11), (15_000_000, 2048, 13)):
        assert blocks.sizes_for(n, 3000 * n) == (rows, bits)
    # Long documents do not make larger blocks.
    assert blocks.sizes_for(100_000, 100_000 * 1_000_000)[0] == blocks.BLOCK_ROWS
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 5_000)
    monkeypatch.setattr(blocks, "MOST_SENT", 0)
    rows = sample()
    assert blocks.sizes_for(len(rows), 100_000) == (16, 4)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df).collect()), key=str)
    assert got == brute(rows, 50)


def test_whole_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows, 50)]
    got = [tuple(r) for r in op1_suffix_dedup(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_pieces_with_a_shared_window_are_sorted(monkeypatch):
    """Pieces that share an anchor, but no window, stay out of the transform."""
    rng, anchor, passage = random.Random(9), b"a phrase of 20 bytes", b"these thirty bytes go with it."
    around = lambda: bytes(rng.choice(b"etaoinshr") for _ in range(30))
    pieces = [around() + anchor + around() for _ in range(50)] + [around() + anchor + passage, around() + anchor + passage]
    ids = np.arange(len(pieces), dtype="<i8")
    head = np.array([len(pieces)], dtype="<i4").tobytes() + ids.tobytes() + np.full(len(pieces), 7, dtype="<u4").tobytes()
    row = head + np.full(len(pieces), 80, dtype=np.uint8).tobytes() + b"".join(pieces)
    sorted_pieces, insert = [], suffixes.insert_columns
    monkeypatch.setattr(suffixes, "insert_columns", lambda texts: sorted_pieces.extend(texts) or insert(texts))
    reply = suffixes.reply_pieces([zstandard.ZstdCompressor().compress(row)], 50)
    assert sorted_pieces == pieces[-2:]
    # Only the last window, anchor and passage, of the later of the two has a smaller document.
    assert np.frombuffer(reply[0], dtype="<u4").tolist() == [0] * 51 + [1 << 30]
