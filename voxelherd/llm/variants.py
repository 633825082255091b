"""Spelling variants: words that differ by one code point, grouped under the frequent form.

The vocabulary is counted over all texts. Two words that differ by one inserted, deleted or
replaced code point agree in the first or in the last half of the shorter one. So each word
goes to *cells*, by side, length of the shorter word and half, and pairs are looked for
within cells only. A pair that agrees in both halves counts on the first side alone.

In a cell the words form a bit-sliced position index: per place and letter, the set of words
that have this letter there, one bit a word. Each word is then read letter by letter against
all others at once. Sets of words that agreed so far, that differed in one place, that have one
letter more, or one less, are carried along, the last two by looking one place ahead or
behind; a step is a few operations on 64 words each. Bits are in the order of (count
descending, word), so the lowest bit of a result is the form and its bits are the near words:
no pair is ever a row. Small cells share an index. Cells of more than ``CELL`` words are
divided: each part is indexed apart and read by all words of the cell.

Defined results: a null text has no words; a null id counts as an empty text in the checksum;
repeated rows count as often as they stand; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelherd.session import materialize

# Letters of a word, least code points and occurrences, and how much more
# frequent a form has to be.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10

# Words of one index, words of a shared index, bytes of letters in one, and 64-bit sets of
# one step.
CELL = 16_384
SHARED = 1_024
LETTER_BYTES = 16 * 1024 * 1024
STEP_SETS = 32_768
FIRST, LAST = 0, 1


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``owner`` and lower-cased ``run`` of every run of letters that may become a word."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    owner = F.coalesce(F.col(key).cast("string"), F.lit(""))
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return docs.select(owner.alias("owner"), F.explode(found).alias("run")).select(
        "owner", F.translate("run", upper, upper.lower()).alias("run")
    )


def misspelt(owner: Column, run: Column) -> Column:
    """The run, without one code point for one in 31 checksums of owner and run."""
    h = F.crc32(F.encode(F.concat(owner, F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % 31 == 0, cut).otherwise(run)


def vocabulary(words: DataFrame) -> DataFrame:
    """``word`` and ``n`` of the words that are long and frequent enough, from a column ``word``."""
    counts = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _cells(words: DataFrame, most: int) -> DataFrame:
    """Rows (side, m, key, part, guest, word, n): each word in its cells, large cells in parts.

    A word belongs to part ``part`` where ``guest`` is false, and only reads it otherwise.
    """
    n = F.length("word")
    shorter = F.filter(F.array(n, n - 1), lambda m: m >= LEAST_LENGTH)
    half = F.floor(F.col("m") / 2).cast("int")
    keys = F.array(
        F.struct(F.lit(FIRST).alias("side"), F.substring(F.col("word"), F.lit(1), half).alias("key")),
        F.struct(F.lit(LAST).alias("side"), F.substring(F.col("word"), n - half + 1, half).alias("key")),
    )
    rows = words.select("word", "n", F.explode(shorter).alias("m")).select("*", F.explode(keys).alias("cell"))
    rows = rows.select("cell.side", "m", "cell.key", "word", "n")
    large = rows.groupBy("side", "m", "key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > most)
    found = rows.join(large, ["side", "m", "key"], "left")
    parts = F.ceil(F.coalesce("words", F.lit(1)) / most).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    return found.withColumn("parts", parts).withColumn("own", own).select(
        "side", "m", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "own", "word", "n"
    ).select("side", "m", "key", "part", (F.col("own") != F.col("part")).alias("guest"), "word", "n")


class PositionIndex:
    """Bit sets of the words that have a letter at a place, for words of m or m + 1 letters."""

    def __init__(self, words: list[str], counts: list[int], m: int) -> None:
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words = [words[i] for i in order]
        self.counts = [counts[i] for i in order]
        self.m = m
        self.width = -(-len(words) // 64)
        codes = letter_codes(self.words, m + 1)
        letters = np.unique(codes)
        # The last code stands for letters that no word here has.
        self.code_of = np.full(256, len(letters), dtype=np.uint8)
        self.code_of[letters] = np.arange(len(letters), dtype=np.uint8)
        self.codes = self.code_of[codes]
        self.n_codes = len(letters) + 1
        self.longer = self._sets(codes[:, m] != 0)
        self.whole = self._sets(np.ones(len(words), dtype=bool))

    def _sets(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros((*flags.shape[:-1], self.width * 64), dtype=bool)
        padded[..., : flags.shape[-1]] = flags
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    def place(self, at: int) -> np.ndarray:
        """Set of words per letter at one place; none before the first and after the last."""
        flags = np.zeros((self.n_codes, len(self.words)), dtype=bool)
        if 0 <= at <= self.m:
            flags[self.codes[:, at], np.arange(len(self.words))] = True
        return self._sets(flags)

    def near(self, queries: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of near words, place of the first or -1) of each query of m or m + 1 letters."""
        codes = self.code_of[letter_codes(queries, self.m + 1)]
        long = np.array([len(q) > self.m for q in queries])
        number = np.zeros(len(queries), dtype=np.int64)
        first = np.full(len(queries), -1, dtype=np.int64)
        at_once = max(1, STEP_SETS // self.width)
        for rows, read in ((np.flatnonzero(~long), self._same_or_longer), (np.flatnonzero(long), self._shorter)):
            starts = [rows[i : i + at_once] for i in range(0, len(rows), at_once)]
            for part, found in zip(starts, read([codes[part] for part in starts], side)):
                number[part] = np.bitwise_count(found).sum(axis=1)
                hit = np.flatnonzero(number[part])
                some = found[hit]
                word = np.argmax(some != 0, axis=1)
                bits = some[np.arange(len(hit)), word]
                lowest = bits & (~bits + np.uint64(1))
                first[part[hit]] = word * 64 + np.log2(lowest.astype(np.float64)).astype(np.int64)
        return number, first

    def _halves(self, exact: np.ndarray, side: int) -> np.ndarray:
        return exact if side == FIRST else ~exact

    def _same_or_longer(self, parts: list[np.ndarray], side: int) -> list[np.ndarray]:
        """Words of m letters with one other letter, and of m + 1 with one more."""
        m, half = self.m, self.m // 2
        exact = [np.repeat(self.whole[None], len(p), axis=0) for p in parts]
        other = [np.zeros_like(e) for e in exact]
        more = [np.zeros_like(e) for e in exact]
        scope = [None] * len(parts)
        here = self.place(0)
        for i in range(m):
            ahead = self.place(i + 1)
            for k, codes in enumerate(parts):
                same, shifted = here[codes[:, i]], ahead[codes[:, i]]
                more[k] = (more[k] | exact[k]) & shifted
                other[k] = (other[k] & same) | (exact[k] & ~same)
                exact[k] &= same
                if i + 1 == half:
                    scope[k] = self._halves(exact[k], side).copy()
            here = ahead
        return [
            ((o & ~self.longer) | ((a | e) & self.longer)) & s & self.whole
            for o, a, e, s in zip(other, more, exact, scope)
        ]

    def _shorter(self, parts: list[np.ndarray], side: int) -> list[np.ndarray]:
        """Words of m letters that lack one of the query."""
        m, half = self.m, self.m // 2
        exact = [np.repeat(self.whole[None], len(p), axis=0) for p in parts]
        less = [np.zeros_like(e) for e in exact]
        scope = [None] * len(parts)
        behind, here = self.place(-1), self.place(0)
        for i in range(m + 1):
            for k, codes in enumerate(parts):
                less[k] = (less[k] & behind[codes[:, i]]) | exact[k]
                exact[k] &= here[codes[:, i]]
                if i + 1 == half:
                    scope[k] = self._halves(exact[k], side).copy()
            behind, here = here, self.place(i + 1)
        return [found & ~self.longer & s & self.whole for found, s in zip(less, scope)]


def letter_codes(words: list[str], width: int) -> np.ndarray:
    """One byte a letter (all letters are below U+0100), zero after the end."""
    flat = "".join(w.ljust(width, "\0") for w in words).encode("latin-1")
    return np.frombuffer(flat, dtype=np.uint8).reshape(len(words), width)


def _read_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, list]]:
    """(cell, its own words, guests) as far as one batch goes; a cell's own words come first.

    A cell comes again for guests of later batches, with its own words as before.
    """
    cell, own = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        guests: list = []
        for side, m, key, part, guest, word, n in zip(*columns):
            if (side, m, key, part) != cell:
                if cell is not None:
                    yield cell, own, guests
                cell, own, guests = (side, m, key, part), [], []
            (guests if guest else own).append((word, n))
        if guests:
            yield cell, own, guests
    if cell is not None and not guests:
        yield cell, own, []


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(side: int, m: int, own: list, guests: list, ask_own: bool) -> pa.RecordBatch | None:
        queries = [word for word, _ in (own if ask_own else [])] + [word for word, _ in guests]
        if not own or not queries:
            return None
        index = PositionIndex([w for w, _ in own], [n for _, n in own], m)
        number, first = index.near(queries, side)
        hit = np.flatnonzero(number)
        return pa.RecordBatch.from_pydict({
            "word": pa.array([queries[i] for i in hit], pa.string()),
            "n_near": pa.array(number[hit]),
            "near": pa.array([index.words[first[i]] for i in hit], pa.string()),
            "near_n": pa.array([index.counts[first[i]] for i in hit], pa.int64()),
        })

    shared: list = []
    held, asked = None, None
    for (side, m, key, part), own, guests in _read_cells(batches):
        if guests:
            # A part of a large cell; its own words are asked with the first guests.
            made = solve(side, m, own, guests, asked != (side, m, key, part))
            asked = (side, m, key, part)
            if made is not None:
                yield made
            continue
        if asked == (side, m, key, part) or len(own) < 2:
            continue
        if held != (side, m) or len(shared) + len(own) > SHARED or (len(shared) + len(own)) * (m + 1) > LETTER_BYTES:
            if shared and (made := solve(*held, shared, [], True)) is not None:
                yield made
            held, shared = (side, m), []
        shared = shared + own
    if shared and (made := solve(*held, shared, [], True)) is not None:
        yield made


def near_words(words: DataFrame, most: int = CELL) -> DataFrame:
    """``word``, ``n``, ``n_near`` and the most frequent near word (``near``, ``near_n``; null if none)."""
    cells = _cells(words, most)
    place = ["side", "m", "key", "part"]
    sent = cells.repartition(*place).sortWithinPartitions(*place, "guest")
    found = sent.mapInArrow(_results, "word string, n_near bigint, near string, near_n bigint")
    # The first in the order of (count descending, word).
    best = F.struct((-F.col("near_n")).alias("rank"), F.col("near"))
    parts = found.select("word", F.lit(None).cast("bigint").alias("n"), "n_near", best.alias("best")).unionByName(
        words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"),
                     F.lit(None).cast("struct<rank: bigint, near: string>").alias("best"))
    )
    merged = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return merged.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.rank")).alias("near_n"))


def group_variants(words: DataFrame, most: int = CELL) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of a vocabulary.

    A form is more frequent by a factor, so chains of forms end; their ends are found by
    doubling the steps until no chain goes on.
    """
    near = near_words(words, most)
    frequent = F.col("near_n") >= TIMES * F.col("n")
    formed = materialize(near.select(
        "word", "n", "n_near", F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n")
    ))
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            break
        roots = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
