import base64
import hashlib
import random

import public_tokenizers as tokens
import pytest
import tiktoken

from voxelherd.llm import bpe, common
from voxelherd.llm.bpe import decode_ids, encode_texts, engine, load_tokenizer, round_trip
from voxelherd.llm.q_bpe import op5_bpe_round_trip
from voxelherd.llm.words import in_blocks

PATH = tokens.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return load_tokenizer(PATH, tokens.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    letters = "".join(rng.choice("etaoin") for _ in range(3000))
    return [
        None, "", " ", "a", "a" * 20_000, " " * 500, "=" * 333, letters, "ab" * 5000, "the" * 700, "a b\n\n  c\t",
        "it's we'll 12345 x_y", "Ünïcödé ß 漢字 🙂🙂", "漢字" * 50, "\x00\x01", "line\r\nline", letters[:31], letters[:33],
    ]


def ids_of(reference, text):
    return reference.encode_ordinary(text or "")


def test_equal_to_library_and_back(spark, tokenizer, reference):
    rows = [(i, t, "x") for i, t in enumerate(texts() + texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: list(r.ids) for r in encode_texts(df, tokenizer).collect()}
    assert got == {i: ids_of(reference, t) for i, t, _ in rows}
    raw = {r.doc_id: bytes(r.raw) for r in decode_ids(encode_texts(df, tokenizer), tokenizer).collect()}
    assert raw == {i: (t or "").encode() for i, t, _ in rows}


def test_random_short_and_long_words(tokenizer, reference):
    rng = random.Random(5)
    words = ["".join(rng.choice("abth ine") for _ in range(rng.randint(1, 120))) for _ in range(300)]
    own = engine(tokenizer)
    for word, ids in zip(words, own.encode(words), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in ids_of(reference, word))


def test_words_of_any_length(tokenizer, reference, monkeypatch):
    """Pieces of a long word, whose borders fall anywhere, give the tokens of the whole."""
    rng = random.Random(11)
    words = ["a" * 1001, "ab" * 300, "".join(rng.choice("aab") for _ in range(600)), "漢字" * 100,
             "".join(rng.choice("etaoinshrdlu") for _ in range(800)), "e" * 300 + "a" * 300]
    for piece in (7, 64):
        monkeypatch.setattr(bpe, "PIECE", piece)
        own = bpe.Engine(tokenizer)
        for word, ids in zip(words, own.encode(words), strict=True):
            assert ids == b"".join(i.to_bytes(4, "little") for i in ids_of(reference, word))


def test_a_word_of_millions_of_letters(tokenizer, reference):
    """More letters than one query holds in memory; the tokens of the beginning are the library's."""
    word = "a" * 2_500_000
    own = bpe.Engine(tokenizer)
    ids = own.encode([word])[0]
    want = ids_of(reference, word[:100_000])
    assert ids[: 4 * len(want)] == b"".join(i.to_bytes(4, "little") for i in want)
    assert own.decode([ids])[0] == word.encode()


def test_words_met_lately_stay(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 200)
    own = bpe.Engine(tokenizer)
    fresh = bpe.Engine(tokenizer)
    for i in range(30):
        texts = [" ".join(f"w{i * 40 + j}" for j in range(60)), "the house and the garden"]
        assert own.encode(texts) == [fresh.encode([t])[0] for t in texts]
        assert len(own.known) + len(own.older) <= 400


def test_new_words_of_a_batch_share_a_query(tokenizer, reference, monkeypatch):
    """A query has a cost of its own, whatever its words; the texts of an Arrow batch make one."""
    rng = random.Random(7)
    batch = [" ".join("".join(rng.choice("etaoin") for _ in range(9)) for _ in range(1000)) for _ in range(20)] * 10
    own, sizes = bpe.Engine(tokenizer), []
    contract = own._contract
    monkeypatch.setattr(own, "_contract", lambda raw, query: sizes.append(len(raw)) or contract(raw, query))
    ids = [x for part in in_blocks(batch, len, bpe.TEXT_AT_ONCE) for x in own.encode(batch[part])]
    assert len(sizes) == 1 and sizes[0] > 15_000
    assert own.encode(batch[:3]) == ids[:3] and len(sizes) == 1
    for text, found in zip(batch[:20], ids, strict=False):
        assert found == b"".join(i.to_bytes(4, "little") for i in ids_of(reference, text))


def test_whole_table(spark, folder, reference):
    got = {r.doc_id: r for r in op5_bpe_round_trip(spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = ids_of(reference, row.text)
        digest = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        found = got[row.doc_id]
        assert (found.n_tokens, found.ids_sha256) == (len(ids), digest)
        assert found.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_empty_table(spark, tokenizer):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip(empty, tokenizer).count() == 0


def held():
    with open("/proc/self/status") as file:
        return next(int(line.split()[1]) for line in file if line.startswith("RssAnon")) // 1024


def test_memory_is_given_back():
    """What a task has freed does not stay with the worker for the next stage."""

    def run(batches):
        waste = [bytearray(2000) for _ in range(100_000)]
        last = bytearray(2000)
        yield len(waste)
        del waste
        kept.append(last)

    kept, before = [], held()
    assert list(common.lean(run)(None)) == [100_000]
    assert held() - before < 60
