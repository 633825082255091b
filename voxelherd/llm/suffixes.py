"""Suffix-array dedup of byte strings that several documents share.

Every 50-byte window has an anchor, the smallest hash of the 20-byte strings in it. Runs
of windows with one anchor form pieces of up to 80 bytes, and equal windows lie in pieces
with equal anchors. Blocks of texts ask which anchors occur in several documents; only
pieces with such anchors are sent to the bucket of their anchor, each distinct piece once
per block. Pieces without a window whose hash another one has are left out there. For the others
the bucket builds the transform and the common prefixes column by
column (see ``bwt``); suffixes that share 50 bytes with the one above are equal windows,
and the smallest document of each group decides.

An anchor that very many documents have, such as one at the edge of a passage found in a
third of all texts, comes with as many different surroundings. Its windows are first
asked for by hash, one by one, and its pieces are cut to those that several documents
have; what is left of them is alike, and few pieces per block are distinct.

Texts that equal the whole text of a document with a smaller id are told apart before:
they go as a whole, and have no string that the other has not.

Hashes only narrow the search; windows are equal by their bytes. (Within a block, equal
pieces are recognized by 64 bits of hash.)

Defined results: null and empty texts have no bytes; documents with a null id are neither
cut nor a reason to cut others; rows with the same id do not cut each other; texts of
fewer than 50 bytes stay whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from voxelherd.llm.blocks import ASK_SCHEMA, Blocks, answer, ask, bits_of, slide, smaller_elsewhere
from voxelherd.llm.bwt import insert_columns
from voxelherd.llm.words import in_blocks, mix, prefix, ranges, stretch, window_hashes

WINDOW = 50
GRAM = 20
# Documents or blocks from which on an anchor's windows are handled one by one.
MANY = 16
TEXT_AT_ONCE = 700_000
# Number of the question for whole texts, next to 0, 1 and 2 for anchors, windows and pieces.
COPIES = 3
# Pieces of one bucket sorted together hold about this many bytes.
SORTED_BYTES = 1_000_000

RESULT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes cut to the bucket's bits and 32 more."""
    rest = np.uint64(32 - bits)
    return hashes >> rest << rest


def entry(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's."""
    return (hashes >> np.uint64(32 - bits)).astype("<u4")


def count_docs(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the number of documents of each."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return np.unique(hashes[new], return_counts=True)


def packed_counts(counts: np.ndarray) -> list[np.ndarray]:
    """Flags for two documents or more, and for many."""
    return [counts >= 2, counts >= MANY]


def send_counted(block: int, hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Entries of 4 bytes, then two packed rows of flags."""
    if not len(hashes):
        return
    to = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), dtype=np.uint64)
    names, first = np.unique(to, return_index=True)
    stops = np.append(first[1:], len(hashes))
    packed = []
    for a, b in zip(first, stops, strict=True):
        flags = [np.packbits(f).tobytes() for f in packed_counts(counts[a:b])]
        packed.append(entry(hashes[a:b], bits).tobytes() + b"".join(flags))
    yield pa.RecordBatch.from_arrays(
        [pa.array([block] * len(names), pa.int64()), pa.array(names.astype(np.int64)), pa.array(packed, pa.binary())],
        names=["block", "bucket", "packed"],
    )


def reply_counted(sent: list[bytes]) -> list[bytes]:
    """For each entry, whether several documents have it, and whether many do."""
    entries, flags = [], []
    for row in sent:
        # n entries of 4 bytes and two rows of n bits, filled up to bytes.
        n = 4 * len(row) // 17
        entries.append(np.frombuffer(row, dtype="<u4", count=n))
        bits = np.frombuffer(row, dtype=np.uint8, offset=4 * n).reshape(2, -1)
        flags.append(np.unpackbits(bits, axis=1, count=n).astype(bool))
    names, at, blocks = np.unique(np.concatenate(entries), return_inverse=True, return_counts=True)
    several, many = np.concatenate(flags, axis=1)
    repeated, hot = blocks >= 2, blocks >= MANY
    repeated[at[several]] = True
    hot[at[many]] = True
    out, stop = [], 0
    for own in entries:
        part = at[stop : stop + len(own)]
        stop += len(own)
        out.append(np.packbits(repeated[part]).tobytes() + np.packbits(hot[part]).tobytes())
    return out


def flags_of(parts: list[bytes], hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both flags of sorted hashes, from the answers of their buckets in order."""
    to = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), dtype=np.uint64)
    _, sizes = np.unique(to, return_counts=True)
    found = [
        np.unpackbits(np.frombuffer(p, dtype=np.uint8).reshape(2, -1), axis=1, count=n)
        for p, n in zip(parts, sizes, strict=True)
    ]
    both = np.concatenate(found, axis=1).astype(bool) if found else np.zeros((2, 0), dtype=bool)
    return both[0], both[1]


class Part:
    """Bytes of one block with its runs of windows that share an anchor."""

    def __init__(self, own: dict, window: int, bits: int):
        self.window, self.bits, self.answers = window, bits, own["answers"]
        self.ids, self.texts = own["doc_ids"], own["texts"]
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        known = sorted({i for i in self.ids if i is not None})
        place = {i: k for k, i in enumerate(known)}
        self.known = np.array(known, dtype=np.int64)
        self.rank = np.array([place.get(i, -1) for i in self.ids], dtype=np.int64)
        self.copy = self._copies() if COPIES in self.answers else np.zeros(len(self.ids), dtype=bool)
        self.chunks = list(in_blocks(self.texts, len, TEXT_AT_ONCE))
        gram = min(GRAM, window)
        self.span = window - gram + 1
        runs = [self._runs(chunk, gram) for chunk in self.chunks]
        self.start, self.count, self.key, self.doc = (np.concatenate(c) for c in zip(*runs, strict=True))

    def texts_asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of whole texts, second hashes, smallest documents, and each document's place."""
        digests = b"".join(xxhash.xxh3_128_digest(t) for t in self.texts)
        both = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)[self.rank >= 0]
        names, first, at = np.unique(both[:, 0], return_index=True, return_inverse=True)
        least = np.full(len(names), len(self.known), dtype=np.int64)
        np.minimum.at(least, at, self.rank[self.rank >= 0])
        return names, both[first, 1].astype("<u4"), least, at

    def _copies(self) -> np.ndarray:
        """Documents whose whole text a document with a smaller id has."""
        names, _, least, at = self.texts_asked()
        elsewhere = bits_of(self.answers[COPIES], names, self.bits)
        out = np.zeros(len(self.ids), dtype=bool)
        out[self.rank >= 0] = elsewhere[at] | (self.rank[self.rank >= 0] > least[at])
        return out

    def _flat(self, chunk: slice) -> np.ndarray:
        return np.frombuffer(b"".join(self.texts[chunk]), dtype=np.uint8)

    def _sums(self, flat: np.ndarray) -> np.ndarray:
        return prefix(flat.astype(np.uint64) + np.uint64(1))

    def _runs(self, chunk: slice, gram: int) -> tuple[np.ndarray, ...]:
        """Starts, numbers of windows, anchor hashes and documents of the runs of a chunk."""
        base = self.first[chunk.start]
        docs = np.arange(chunk.start, chunk.stop)
        docs = docs[(self.sizes[docs] >= self.window) & (self.rank[docs] >= 0) & ~self.copy[docs]]
        none = np.zeros(0, dtype=np.int64)
        if not len(docs):
            return none, none, none.astype(np.uint64), none
        least = slide(window_hashes(self._flat(chunk).astype(np.uint64) + np.uint64(1), gram), self.span, np.minimum)
        # Windows of one document each, all documents of the chunk one after the other.
        n = self.sizes[docs] - self.window + 1
        places = ranges(self.first[docs] - base, n)
        keys = least[places]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        new[np.cumsum(n) - n] = True
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(keys)))
        # Longer runs, of texts that repeat themselves, are cut.
        pieces = -(-size // self.span)
        inner = ranges(np.zeros(len(size), dtype=np.int64), pieces) * self.span
        begin = np.repeat(first, pieces) + inner
        count = np.minimum(np.repeat(size, pieces) - inner, self.span)
        owner = np.searchsorted(np.cumsum(n), begin, side="right")
        # Anchors have small hashes, so bits are mixed again before they name a bucket.
        return places[begin] + base, count, mix(keys[begin]), docs[owner]

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hash of the bytes at each start (sorted), chunk by chunk."""
        out = np.zeros(len(starts), dtype=np.uint64)
        for chunk in self.chunks:
            low, high = self.first[chunk.start], self.first[chunk.stop]
            own = slice(*np.searchsorted(starts, [low, high]))
            if own.stop > own.start:
                at = starts[own] - low
                out[own] = stretch(self._sums(self._flat(chunk)), at, at + sizes[own])
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, cut, and the number of documents of each."""
        return count_docs(short(self.key, self.bits), self.rank[self.doc])

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of runs with a repeated anchor, and of those with a hot one."""
        cut = short(self.key, self.bits)
        names, at = np.unique(cut, return_inverse=True)
        repeated, hot = flags_of(self.answers.get(0, []), names, self.bits)
        return np.flatnonzero((repeated & ~hot)[at]), np.flatnonzero(hot[at])

    def single(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of hot runs, and the run of each."""
        starts = ranges(self.start[hot], self.count[hot])
        return starts, self.hashes(starts, np.full(len(starts), self.window)), np.repeat(hot, self.count[hot])

    def trimmed(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, numbers of windows and runs of what several documents have of hot runs."""
        starts, hashes, run = self.single(hot)
        names, at = np.unique(short(hashes, self.bits), return_inverse=True)
        repeated, _ = flags_of(self.answers.get(1, []), names, self.bits)
        kept = repeated[at] if len(names) else np.zeros(0, dtype=bool)
        starts, run = starts[kept], run[kept]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (run[1:] != run[:-1])
        first = np.flatnonzero(new)
        return starts[first], np.diff(np.append(first, len(starts))), run[first]

    def pieces(self) -> dict[str, np.ndarray]:
        """All pieces of the block, sorted by key and content."""
        normal, hot = self.split()
        start, count, run = self.trimmed(hot)
        start, run = np.concatenate([self.start[normal], start]), np.concatenate([normal, run])
        size = np.concatenate([self.count[normal], count]) + self.window - 1
        order = np.argsort(start, kind="stable")
        start, size, run = start[order], size[order], run[order]
        key, doc, content = self.key[run], self.doc[run], self.hashes(start, size)
        order = np.lexsort((start, content, key))
        start, size, key, doc, content = (c[order] for c in (start, size, key, doc, content))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (size[1:] != size[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.rank[doc], first) if len(first) else first
        return {"start": start, "size": size, "key": key, "doc": doc, "same": np.cumsum(new) - 1, "first": first, "least": least}


def send_pieces(own: dict, window: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Distinct pieces of a block: number, ids, parts of keys, sizes, bytes; packed."""
    part = Part(own, window, bits)
    found = part.pieces()
    first, least = found["first"], found["least"]
    if not len(first):
        return
    pack = zstandard.ZstdCompressor(level=1).compress
    text = b"".join(own["texts"])
    key, start, size = found["key"][first], found["start"][first], found["size"][first]
    to = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), dtype=np.uint64)
    names, begin = np.unique(to, return_index=True)
    stops = np.append(begin[1:], len(key))
    packed = []
    for a, b in zip(begin, stops, strict=True):
        body = b"".join(text[s : s + n] for s, n in zip(start[a:b].tolist(), size[a:b].tolist(), strict=True))
        head = np.array([b - a], dtype="<i4").tobytes() + part.known[least[a:b]].astype("<i8").tobytes()
        packed.append(pack(head + entry(key[a:b], bits).tobytes() + size[a:b].astype(np.uint8).tobytes() + body))
    yield pa.RecordBatch.from_arrays(
        [pa.array([own["block"]] * len(names), pa.int64()), pa.array(names.astype(np.int64)), pa.array(packed, pa.binary())],
        names=["block", "bucket", "packed"],
    )


def smallest_of_windows(texts: list[bytes], ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each piece, the smallest id of all pieces that have it; and each piece's number of windows."""
    records = insert_columns(texts)
    whole = np.flatnonzero(records["length"] >= window)
    # Only these can share a window's bytes with the record above.
    new = records["shared"][whole] < window
    new[:1] = True
    owner = records["owner"][whole]
    first = np.flatnonzero(new)
    sizes = np.array([len(t) for t in texts])
    counts = np.maximum(sizes - window + 1, 0)
    flat = np.zeros(int(counts.sum()), dtype=np.int64)
    if len(first):
        least = np.minimum.reduceat(ids[owner], first)[np.cumsum(new) - 1]
        offset = sizes[owner] - records["length"][whole]
        flat[(np.cumsum(counts) - counts)[owner] + offset] = least
    return flat, counts


def may_share(texts: list[bytes], window: int) -> np.ndarray:
    """Which pieces have a window whose hash occurs again. The others share no window with any piece."""
    sizes = np.array([len(text) for text in texts], dtype=np.int64)
    counts = np.maximum(sizes - window + 1, 0)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    hashes = window_hashes(flat.astype(np.uint64) + np.uint64(1), window)[ranges(np.cumsum(sizes) - sizes, counts)]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(hashes), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    out = np.zeros(len(texts), dtype=bool)
    out[np.repeat(np.arange(len(texts)), counts)[again]] = True
    return out


def reply_pieces(sent: list[bytes], window: int) -> list[bytes]:
    """For each piece sent, 32 bits: which of its windows a smaller document has."""
    unpack = zstandard.ZstdDecompressor().decompress
    place: dict[bytes, int] = {}
    texts: list[bytes] = []
    keys, asked = [], []
    for row in sent:
        raw = unpack(row)
        n = int(np.frombuffer(raw, dtype="<i4", count=1)[0])
        own = np.frombuffer(raw, dtype="<i8", count=n, offset=4)
        code = np.frombuffer(raw, dtype="<u4", count=n, offset=4 + 8 * n)
        size = np.frombuffer(raw, dtype=np.uint8, count=n, offset=4 + 12 * n)
        ends = 4 + 13 * n + np.cumsum(size, dtype=np.int64)
        numbers, new = [], len(texts)
        for at, end in zip((ends - size).tolist(), ends.tolist(), strict=True):
            number = place.setdefault(raw[at:end], len(place))
            numbers.append(number)
            if number == len(texts):
                texts.append(raw[at:end])
        numbers = np.array(numbers, dtype=np.int64)
        # The first piece of each new number, in order.
        keys.append(code[np.unique(numbers, return_index=True)[1][-(len(texts) - new) or n :]])
        asked.append((numbers, own))
    keys = np.concatenate(keys)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, *(np.concatenate(c) for c in zip(*asked, strict=True)))
    # By piece and window, the smallest id of all pieces that have the window. If no other piece
    # has the anchor, or a window with one of its hashes, none has these windows.
    found = np.repeat(least[:, None], 32, axis=1)
    by_key = np.argsort(keys, kind="stable")
    _, at, members = np.unique(keys[by_key], return_inverse=True, return_counts=True)
    by_key, at = by_key[members[at] > 1], at[members[at] > 1]
    sizes = np.array([len(text) for text in texts], dtype=np.int64)[by_key]
    # Groups of one key stay together, and so many of them are sorted at once.
    before = np.cumsum(sizes) - sizes
    batch = before[np.searchsorted(at, at)] // SORTED_BYTES
    for own in np.split(by_key, np.flatnonzero(np.diff(batch)) + 1) if len(by_key) else []:
        own = own[may_share([texts[i] for i in own.tolist()], window)]
        if not len(own):
            continue
        flat, counts = smallest_of_windows([texts[i] for i in own.tolist()], least[own], window)
        found[own] = np.iinfo(np.int64).max
        found[np.repeat(own, counts), ranges(np.zeros(len(own), dtype=np.int64), counts)] = flat
    weights = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return [((found[numbers] < own[:, None]) * weights).sum(axis=1, dtype=np.uint32).astype("<u4").tobytes() for numbers, own in asked]


def removed_bytes(part: Part) -> np.ndarray:
    """Which bytes of a block go."""
    found = part.pieces()
    parts = part.answers.get(2, [])
    flags = np.frombuffer(b"".join(parts), dtype="<u4")[found["same"]] if parts else np.zeros(0, dtype="<u4")
    later = part.rank[found["doc"]] > found["least"][found["same"]] if len(found["same"]) else np.zeros(0, dtype=bool)
    flags = np.where(later, np.uint32(0xFFFFFFFF), flags)
    edges = np.zeros(part.first[-1] + 1, dtype=np.int32)
    copies = np.flatnonzero(part.copy & (part.sizes >= part.window))
    edges[part.first[copies]] += 1
    np.add.at(edges, part.first[copies + 1], -1)
    some = np.flatnonzero(flags)
    for offset in range(part.span):
        hit = some[(flags[some] >> np.uint32(offset) & np.uint32(1) > 0) & (found["size"][some] - part.window >= offset)]
        np.add.at(edges, found["start"][hit] + offset, 1)
        np.add.at(edges, found["start"][hit] + offset + part.window, -1)
    return np.cumsum(edges)[:-1] > 0


def whole_characters(raw: bytes) -> bytes:
    """UTF-8 without the bytes of characters that were cut in part."""
    return raw.decode("utf-8", errors="ignore").encode()


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, texts: bool = True, keep: list[str] | None = None
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes left.

    Without ``texts``, ``kept`` is the lowercase hexadecimal SHA-256 of them. Columns to
    ``keep`` follow as the struct ``rest``; ``kept`` then has whole characters only.
    """
    if window - min(GRAM, window) + 1 > 32 or window > 127:
        raise ValueError("windows of 127 bytes at most, and 31 longer than an anchor at most")
    blocks = Blocks(docs, keep)
    bits = min(blocks.bucket_bits, 32)

    def send_anchors(own: dict) -> Iterator[pa.RecordBatch]:
        yield from send_counted(own["block"], *Part(own, window, bits).anchors(), bits)

    def send_single(own: dict) -> Iterator[pa.RecordBatch]:
        part = Part(own, window, bits)
        _, hashes, run = part.single(part.split()[1])
        yield from send_counted(own["block"], *count_docs(short(hashes, bits), part.rank[part.doc[run]]), bits)

    def send_texts(own: dict) -> Iterator[pa.RecordBatch]:
        part = Part({**own, "texts": [t[:0] for t in own["texts"]]}, window, bits)
        part.texts = own["texts"]
        names, checks, least, _ = part.texts_asked()
        yield from ask(own["block"], names, bits, [names, checks, part.known[least]])

    replies = answer(blocks.map(send_texts, ASK_SCHEMA), COPIES, smaller_elsewhere)
    replies = replies.unionByName(answer(blocks.map(send_anchors, ASK_SCHEMA, replies), 0, reply_counted))
    replies = replies.unionByName(answer(blocks.map(send_single, ASK_SCHEMA, replies), 1, reply_counted))
    pieces = blocks.map(lambda own: send_pieces(own, window, bits), ASK_SCHEMA, replies)
    replies = replies.unionByName(answer(pieces, 2, lambda sent: reply_pieces(sent, window)))

    def cut(own: dict) -> Iterator[pa.RecordBatch]:
        part = Part(own, window, bits)
        gone = removed_bytes(part)
        rows = []
        for doc, text in enumerate(part.texts):
            mask = gone[part.first[doc] : part.first[doc + 1]]
            edges = np.diff(np.concatenate([[False], mask]).astype(np.int8))
            kept = np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()
            if keep:
                kept = whole_characters(kept)
            kept = kept if texts else hashlib.sha256(kept).hexdigest().encode()
            rows.append((part.ids[doc], len(text), int(mask.sum()), int((edges == 1).sum()), kept))
        kinds = [*[pa.int64()] * 4, pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        if keep:
            columns, names = [*columns, own["rest"]], [*names, "rest"]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.map(cut, RESULT_SCHEMA + blocks.rest, replies)
