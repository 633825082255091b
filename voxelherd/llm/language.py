"""Language identification of mixed-language text.

The script of a word, by Unicode ranges, narrows the candidate languages to those whose
training texts use it. Each candidate scores the word by its character trigrams. Viterbi
over the words of a text, with a penalty for changing the language, labels spans; the
language with the most letters is the prediction, its share of the letters the score.

The model is fitted on a bounded sample, SAMPLE_ROWS labelled rows per language in
expectation, chosen by a hash, and keeps the GRAMS most frequent trigrams. Everything
else covers all rows and whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no
spans, and so is every text if there is nothing to learn from; ties go to the language
that is first by name; words of a script no language uses have no preference and follow
their neighbours; repeated rows are labelled one by one; an empty table gives no rows;
other columns are ignored. A null key counts as the empty text in the split.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelherd.llm.common import lean
from voxelherd.llm.words import in_blocks, ranges
from voxelherd.session import materialize

UNKNOWN = "und"
FOLDS = 5
SAMPLE_ROWS = 2000
GRAMS = 200_000
MOST_LANGUAGES = 1000
PENALTY = 6.0
# A language is a candidate for a script that has this share of its letters.
SCRIPT_SHARE = 0.005
SMOOTHING = 0.5
# Characters of text labelled together (for up to four languages).
TEXT_AT_ONCE = 1_500_000
# Code points, and the most codes of trigrams that a table has an entry for each of.
CODE_POINTS = 0x110000
MOST_CODES = 1 << 22

# First and last code point of the ranges of common scripts.
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x2FFFF),
]
_STARTS = [low for _, low, _ in SCRIPT_RANGES]
SCRIPTS = [*dict.fromkeys(name for name, *_ in SCRIPT_RANGES), "other"]

WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> str:
    """Script of the first letter of a word, or ``other``."""
    for char in word:
        if char.isalpha():
            at = bisect.bisect_right(_STARTS, ord(char)) - 1
            if at >= 0 and ord(char) <= SCRIPT_RANGES[at][2]:
                return SCRIPT_RANGES[at][0]
            return "other"
    return "other"


def trigrams(word: str) -> list[str]:
    """Trigrams of a word with its borders marked."""
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def held_out(key: Column) -> Column:
    """Whether a row belongs to the fold that is never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Model:
    """Languages in order, trigram scores per language, scripts per language."""

    languages: list[str]
    grams: dict[str, int]
    scores: np.ndarray
    scripts: dict[str, np.ndarray]


def fit(labelled: DataFrame, key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``text`` and ``lang`` of the rows given; ``key`` only picks the sample."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, np.zeros((1, 0), dtype=np.float32), {})
    shares = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, sample_rows / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.where(draw < shares[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            for lang, own in words.items():
                for word, n in own.items():
                    found[lang, "script", script_of(word)] += n * len(word)
                    for gram in trigrams(word):
                        found[lang, "gram", gram] += n
            if len(found) > GRAMS:
                yield _counts(found)
                found = Counter()
        yield _counts(found)

    totals = sample.mapInArrow(count, "lang string, kind string, name string, n bigint")
    totals = materialize(totals.groupBy("kind", "name", "lang").agg(F.sum("n").alias("n")))
    # What is kept is bounded by GRAMS and goes to every worker.
    kept = totals.where("kind = 'script'").collect()
    grams = totals.where("kind = 'gram'").orderBy(F.desc("n"), "name", "lang").limit(GRAMS).collect()
    place = {lang: i for i, lang in enumerate(languages)}
    names = {name: i for i, name in enumerate(dict.fromkeys(r["name"] for r in grams))}
    counts = np.zeros((len(names) + 1, len(languages)))
    for r in grams:
        counts[names[r["name"]], place[r["lang"]]] = r["n"]
    norm = np.log(counts.sum(axis=0) + SMOOTHING * (len(names) + 1))
    scores = np.log(counts + SMOOTHING) - norm
    letters = np.zeros(len(languages))
    scripts: dict[str, np.ndarray] = {}
    for r in kept:
        scripts.setdefault(r["name"], np.zeros(len(languages)))[place[r["lang"]]] = r["n"]
        letters[place[r["lang"]]] += r["n"]
    used = {name: n >= SCRIPT_SHARE * np.maximum(letters, 1) for name, n in scripts.items()}
    return Model(languages, names, scores.astype(np.float32), used)


def _counts(found: Counter) -> pa.RecordBatch:
    lang, kind, name = zip(*found, strict=True) if found else ((), (), ())
    columns = [pa.array(c, pa.string()) for c in (lang, kind, name)]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(list(found.values()), pa.int64())], names=["lang", "kind", "name", "n"]
    )


@functools.cache
def char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point, whether it belongs to words, whether it is a letter, and the number of its script."""
    chars = list(map(chr, range(CODE_POINTS)))
    inside = np.zeros(CODE_POINTS, dtype=bool)
    for match in WORD.finditer("".join(chars)):
        inside[match.start() : match.end()] = True
    letter = np.fromiter(map(str.isalpha, chars), dtype=bool, count=CODE_POINTS)
    script = np.full(CODE_POINTS, len(SCRIPTS) - 1, dtype=np.uint8)
    for name, low, high in SCRIPT_RANGES:
        script[low : high + 1] = SCRIPTS.index(name)
    return inside, letter, script


class Labeller:
    """Scores of all words of many texts at once, from the code points, and Viterbi over them."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.inside, self.letter, self.script = char_tables()
        none = np.zeros(len(model.languages), dtype=bool)
        self.allowed = np.array([model.scripts.get(name, none) for name in SCRIPTS])
        # Characters of trigrams have numbers from 1; what is in no word is a border, as a blank.
        parts = np.frombuffer("".join(model.grams).encode("utf-32-le"), dtype="<u4").reshape(-1, 3)
        chars = np.union1d(parts, [ord(" ")])
        self.slots = np.zeros(CODE_POINTS, dtype=np.int64)
        self.slots[chars] = np.arange(1, len(chars) + 1)
        self.slots[~self.inside] = self.slots[ord(" ")]
        self.base = len(chars) + 1
        codes = self._codes(*self.slots[parts.T])
        numbers = np.fromiter(model.grams.values(), dtype=np.int64, count=len(model.grams))
        self.table = None
        if self.base**3 <= MOST_CODES:
            self.table = np.full(self.base**3, len(model.grams), dtype=np.int32)
            self.table[codes] = numbers
        order = np.argsort(codes)
        self.codes, self.numbers = codes[order], numbers[order]

    def _codes(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (a * self.base + b) * self.base + c

    def _grams(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the trigrams with these codes; those that the model does not have share the last number."""
        if self.table is not None:
            return self.table[codes]
        if not len(self.codes):
            return np.zeros(len(codes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.numbers[at], len(self.codes))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and letters of each word, and the number of words of each text."""
        lowered = [text.lower() for text in texts]
        chars = np.frombuffer("".join([" ", *(text + " " for text in lowered)]).encode("utf-32-le"), dtype="<u4")
        inside = self.inside[chars]
        at = np.flatnonzero(inside)
        if not len(at):
            return np.zeros(self.allowed[:0].shape, dtype=np.float32), at, np.zeros(len(texts), dtype=np.int64)
        first = np.flatnonzero(~inside[at - 1])
        # A word has a trigram around each of its characters.
        slots = self.slots[chars]
        grams = self._grams(self._codes(slots[at - 1], slots[at], slots[at + 1]))
        scores = np.add.reduceat(self.model.scores[grams], first, axis=0)
        own = chars[at]
        letter = self.letter[own]
        lead = np.minimum.reduceat(np.where(letter, np.arange(len(at)), len(at)), first)
        script = np.where(lead < len(at), self.script[own[np.minimum(lead, len(at) - 1)]], len(SCRIPTS) - 1)
        allowed = self.allowed[script]
        some = allowed.any(axis=1)
        scores[~some] = 0
        scores[some[:, None] & ~allowed] = -1e6
        # Keep sums small: only differences between languages matter.
        scores -= scores.max(axis=1, keepdims=True)
        ends = np.cumsum([len(text) + 1 for text in lowered])
        sizes = np.diff(np.searchsorted(at[first], ends), prepend=0)
        return scores, np.add.reduceat(letter.astype(np.int64), first), sizes

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Language number and letters of each word of each text."""
        scores, letters, sizes = self.words(texts)
        starts = np.cumsum(sizes) - sizes
        labels = viterbi(scores, starts, sizes, self.penalty)
        return [(labels[a : a + n], letters[a : a + n]) for a, n in zip(starts, sizes, strict=True)]


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of several sequences laid end to end; step t handles word t of all."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    # Sequences that have a word t come first. Words lie by step here: all first ones, then all second ones.
    active = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")
    first = np.cumsum(active) - active
    own = ranges(np.zeros(len(active), dtype=np.int64), active)
    at = starts[own] + np.repeat(np.arange(len(active)), active)
    value = np.ascontiguousarray(scores[at].T, dtype=np.float64)
    for a, b, n in zip(first[:-1].tolist(), first[1:].tolist(), active[1:].tolist(), strict=True):
        before = value[:, a : a + n]
        value[:, b : b + n] += np.maximum(before, before.max(axis=0) - penalty)
    # The label before is the same one, or the best one if that is better by more than the penalty.
    best = value.argmax(axis=0)
    stay = value >= value.max(axis=0, initial=-np.inf) - penalty
    for a, b, n in zip(first[-2::-1].tolist(), first[:0:-1].tolist(), active[:0:-1].tolist(), strict=True):
        now = best[b : b + n]
        best[a : a + n] = np.where(stay[now, np.arange(a, a + n)], now, best[a : a + n])
    labels = np.zeros(len(scores), dtype=np.int64)
    labels[at] = best
    return labels


def predict(
    docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = True, prefix: str = ""
) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``spans`` added.

    The new names start with ``prefix``; columns that have them are replaced. A span is (``lang``, ``first``, ``stop``) in words of the text. Nothing but ``text``
    is an input; other columns do not pass through the workers' prediction.
    """
    most = TEXT_AT_ONCE * 4 // max(4, len(model.languages))
    names = model.languages
    kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("stop", pa.int32())]))]
    added = [prefix + name for name in ("lang_pred", "score", "spans")[: 3 if spans else 2]]
    base = docs.drop(*added)

    def row(labels: np.ndarray, letters: np.ndarray) -> tuple:
        total = int(letters.sum())
        if not total:
            return UNKNOWN, 0.0, []
        share = np.bincount(labels, weights=letters, minlength=len(names))
        best = int(share.argmax())
        runs = []
        if spans:
            edges = np.flatnonzero(np.diff(labels)) + 1
            cuts = [0, *edges.tolist(), len(labels)]
            runs = [{"lang": names[labels[a]], "first": a, "stop": b} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return names[best], float(share[best] / total), runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in in_blocks(texts, len, most):
                found = [row(*x) for x in labeller.label(texts[part])] if names else [(UNKNOWN, 0.0, [])] * len(texts[part])
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)][: len(added)]
                kept = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*batch.schema.names, *added])

    types = ["string", "double", "array<struct<lang: string, first: int, stop: int>>"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema]
    schema = ", ".join([*fields, *(f"{name} {kind}" for name, kind in zip(added, types, strict=False))])
    return base.mapInArrow(lean(run), schema)


def fit_outside_fold(docs: DataFrame, key: str = "doc_id") -> Model:
    """A model of the documents that are not held out."""
    return fit(docs.where(~held_out(F.col(key))).select(key, "text", "lang"), key)
