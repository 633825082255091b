"""Substring dedup by level-wise doubling of repeated word windows.

Windows repeated at one length alone are extended to twice that length: 13, 26 and 50
words for windows of 50. At the first length it is enough to look at anchors, the windows
whose hash is the smallest within some run of 50 words: equal runs have equal anchors. A
run of 50 words with a repeated anchor also holds the anchor's extension to 26 words, to
the right or to the left, and that is repeated too if the run is. Runs of 50 words around
what survives are the last candidates; the doubling ends there, or as soon as nothing
survives. Windows are compared by hashes of 64 bits, in the last level by 96.

Words covered by a window that also starts in a document with a smaller id are removed.

Defined results: null and empty texts have no words; documents with a null id are
neither cut nor a reason to cut others; rows with the same id do not cut each other;
texts of fewer than 50 words stay whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelherd.llm.blocks import (
    ASK_SCHEMA, Blocks, anchors, answer, ask, bits_of, distinct_with_docs, shared_by_several,
    smaller_elsewhere,
)
from voxelherd.llm.words import SECOND, SPACED, Words, in_blocks, mix, split_words, window_hashes

WINDOW = 50
TEXT_AT_ONCE = 2_000_000

RESULT_SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"


class Part:
    """Words of one block, and the windows that are candidates at each length."""

    def __init__(self, own: dict, window: int, bits: int):
        self.window, self.bits = window, bits
        self.answers = own["answers"]
        self.ids = own["doc_ids"]
        split = [split_words(own["texts"][part], SPACED, lower=False) for part in in_blocks(own["texts"], len, TEXT_AT_ONCE)]
        self.split = split
        self.values = np.concatenate([words.hashes for words in split])
        counts = np.concatenate([np.diff(words.first) for words in split])
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.doc = np.repeat(np.arange(len(counts)), counts)
        # Documents in the order of their ids; -1 marks those without.
        known = sorted({i for i in self.ids if i is not None})
        rank = {i: k for k, i in enumerate(known)}
        self.known = np.array(known, dtype=np.int64)
        self.rank = np.array([rank.get(i, -1) for i in self.ids], dtype=np.int64)[self.doc] if len(self.doc) else self.doc
        # Words from each place to the end of its document.
        self.left = self.first[1:][self.doc] - np.arange(len(self.doc))
        self.lengths = [-(-window // 4), -(-window // 4) * 2, window]

    def usable(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Starts of windows inside one document that has an id."""
        starts = starts[(starts >= 0) & (starts < len(self.values))]
        return starts[(self.left[starts] >= size) & (self.rank[starts] >= 0)]

    def level(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the candidates of a level, given the answers before."""
        size = self.lengths[number]
        hashes = window_hashes(self.values, size)
        if number == 0:
            valid = np.zeros(len(self.values), dtype=bool)
            valid[self.usable(np.arange(len(self.values)), self.window)] = True
            starts = self.usable(anchors(hashes, valid, self.window - size + 1), size)
        else:
            before = self.survivors(number - 1)
            if number == 1:
                reach = self.lengths[1] - self.lengths[0]
                starts = np.unique(np.concatenate([before, before - reach]))
            else:
                mark = np.zeros(len(self.values) + 1, dtype=np.int32)
                np.add.at(mark, np.maximum(before - (size - self.lengths[1]), 0), 1)
                np.add.at(mark, before + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            starts = self.usable(starts, size)
        # Anchors have small hashes, so bits are mixed again before they name a bucket.
        return starts, mix(hashes[starts])

    def survivors(self, number: int) -> np.ndarray:
        """Starts of candidates that several documents have."""
        starts, hashes = self.level(number)
        entries, at = np.unique(hashes, return_inverse=True)
        return starts[bits_of(self.answers.get(number, []), entries, self.bits)[at]]

    def final_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the last candidates; distinct hashes, place of each start in them, smallest document."""
        starts, hashes = self.level(2)
        entries, at = np.unique(hashes, return_inverse=True)
        least = np.full(len(entries), len(self.known), dtype=np.int64)
        np.minimum.at(least, at, self.rank[starts])
        return starts, entries, at, least


def _kept_words(words: Words, flat: bytes, doc: int, keep: np.ndarray) -> bytes:
    own = slice(words.first[doc], words.first[doc + 1])
    places = zip(words.starts[own][keep].tolist(), words.ends[own][keep].tolist(), strict=True)
    return b" ".join(flat[a:b] for a, b in places)


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words left joined by blanks.

    Without ``texts``, ``kept`` is the lowercase hexadecimal SHA-256 of them.
    """
    blocks = Blocks(docs)
    bits = blocks.bucket_bits
    replies = None
    for level in (0, 1):

        def send(own: dict, level=level) -> Iterator[pa.RecordBatch]:
            part = Part(own, window, bits)
            starts, hashes = part.level(level)
            entries, several = distinct_with_docs(hashes, part.rank[starts])
            yield from ask(own["block"], entries, bits, [entries, several])

        got = answer(blocks.map(send, ASK_SCHEMA, replies), level, lambda sent: shared_by_several(sent, "<u8"))
        replies = got if replies is None else replies.unionByName(got)

    def send_last(own: dict) -> Iterator[pa.RecordBatch]:
        part = Part(own, window, bits)
        _, entries, at, least = part.final_entries()
        starts, _ = part.level(2)
        second = mix(window_hashes(part.values * SECOND + np.uint64(1), window))
        checks = np.zeros(len(entries), dtype=np.uint64)
        checks[at] = second[starts] >> np.uint64(32)
        yield from ask(own["block"], entries, bits, [entries, checks.astype("<u4"), part.known[least]])

    got = answer(blocks.map(send_last, ASK_SCHEMA, replies), 2, smaller_elsewhere)
    replies = replies.unionByName(got)

    def cut(own: dict) -> Iterator[pa.RecordBatch]:
        part = Part(own, window, bits)
        starts, entries, at, least = part.final_entries()
        elsewhere = bits_of(part.answers.get(2, []), entries, bits)
        hit = starts[elsewhere[at] | (part.rank[starts] > least[at])]
        edges = np.zeros(len(part.values) + 1, dtype=np.int32)
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + window, -1)
        keep = np.cumsum(edges)[:-1] == 0
        rows, doc = [], 0
        for words in part.split:
            flat = words.flat.tobytes()
            for local in range(len(words.first) - 1):
                own_keep = keep[part.first[doc] : part.first[doc + 1]]
                kept = _kept_words(words, flat, local, own_keep)
                rows.append((part.ids[doc], len(own_keep), int((~own_keep).sum()), kept if texts else hashlib.sha256(kept).hexdigest().encode()))
                doc += 1
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )

    return blocks.map(cut, RESULT_SCHEMA, replies)
