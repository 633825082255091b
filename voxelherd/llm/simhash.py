"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value is within r bits of
both. So every distinct fingerprint has its ball of radius r (for r = 2: 1 + 64 + 2016
variants); variants are shuffled and equal ones bring their fingerprints together.

The shuffle is packed. A variant goes to the bucket given by a hash that is linear over
bits, ``h(x ^ flips) = h(x) ^ h(flips)``. A fingerprint is therefore sent once to each
bucket that holds any of its variants, 8 bytes each, and the bucket makes just those
variants again from a table of flips by hash. The number of buckets follows the number
of fingerprints, so a bucket's work stays the same at any size. A bit of the hash is the
parity of a part of the fingerprint's bits, so two flips change two bits of it at most: of
2,048 buckets, 67 hold variants of a fingerprint.

Within a bucket, fingerprints with a variant in common are linked to the smallest of
them, and each link is verified; links of one bucket are thinned to one per fingerprint
and component. A group of any size gives links in proportion to its size.

Defined results: null and empty texts and texts of blanks have fingerprint 0 and are
linked like others; equal fingerprints are one node; repeated rows keep their rows; null
keys never name a component, which is null if it has no other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.llm.common import lean, text_bytes
from voxelherd.llm.components import components, forest
from voxelherd.session import materialize

SHINGLE = 4
SEED = 42
RADIUS = 2
BITS = 64
# Variants made in one bucket, fingerprints in one packed row, hashes summed at once.
BUCKET_VARIANTS = 4_000_000
PACKED = 50_000
AT_ONCE = 100_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits over XXH64 of all word shingles of a text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = min(size, len(words)) - 1
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, AT_ONCE):
        pairs = zip(starts[at : min(at + AT_ONCE, n)].tolist(), ends[at + last : last + min(at + AT_ONCE, n)].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in pairs]), dtype=np.uint8)
        counts += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``key``, columns to carry and ``simhash`` (64 bits as a long) of each document."""
    names = [key, *also]
    kinds = ", ".join(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column("raw").to_pylist()], dtype=np.uint64)
            columns = [*(batch.column(name) for name in names), pa.array(made.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "simhash"])

    return docs.select(*names, text_bytes(text).alias("raw")).mapInArrow(lean(run), f"{kinds}, simhash bigint")


class Flips:
    """Changes of up to ``radius`` bits, grouped by the linear hash that names the bucket."""

    def __init__(self, bucket_bits: int, radius: int = RADIUS):
        single = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
        masks, groups = [np.zeros(1, dtype=np.uint64)], np.zeros(1, dtype=np.uint64)
        for _ in range(radius):
            groups = np.unique((groups[:, None] ^ single[None, :]).ravel())
            masks.append(groups)
        flips = np.unique(np.concatenate(masks))
        self.codes = np.array([1 << bit % bucket_bits if bucket_bits else 0 for bit in range(BITS)], dtype=np.uint64)
        hashes = self.hash(flips)
        order = np.argsort(hashes, kind="stable")
        self.flips = flips[order]
        self.offsets, self.first = np.unique(hashes[order], return_index=True)
        self.stop = np.append(self.first[1:], len(flips))

    def hash(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.uint64)
        for bit in range(BITS):
            out ^= np.where(x >> np.uint64(bit) & np.uint64(1), self.codes[bit], np.uint64(0))
        return out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """One row per fingerprint: every bucket that holds a variant of it."""
        return self.hash(x)[:, None] ^ self.offsets[None, :]

    def variants(self, x: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Variants in a bucket and the place in ``x`` of the fingerprint of each."""
        target = self.hash(x) ^ np.uint64(bucket)
        at = np.searchsorted(self.offsets, target)
        values, owners = [], []
        for group in np.unique(at):
            own = np.flatnonzero(at == group)
            flips = self.flips[self.first[group] : self.stop[group]]
            values.append((x[own][:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(own, len(flips)))
        return np.concatenate(values), np.concatenate(owners)


def bucket_links(x: np.ndarray, bucket: int, flips: Flips, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of the fingerprints that meet in a bucket, thinned to a forest."""
    values, owners = flips.variants(x, bucket)
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return x[:0], x[:0]
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    met = np.flatnonzero(twice[at] == values)
    own = x[owners[met]]
    order = np.lexsort((own, at[met]))
    group, own = at[met][order], own[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    leader = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
    near = (np.bitwise_count(own ^ leader) <= 2 * radius) & (own != leader)
    return forest(own[near], leader[near])


def near_links(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct ``simhash`` within 2 * radius bits."""
    balls = 1 + BITS + BITS * (BITS - 1) // 2
    bits = max(0, int(np.ceil(np.log2(max(1, count * balls / BUCKET_VARIANTS)))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = Flips(bits, radius)
        for batch in batches:
            all_x = batch.column("simhash").to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(all_x), PACKED):
                x = all_x[start : start + PACKED]
                to = flips.buckets(x).ravel()
                order = np.argsort(to, kind="stable")
                sent = np.repeat(x, len(flips.offsets))[order]
                names, first = np.unique(to[order], return_index=True)
                packed = [part.tobytes() for part in np.split(sent, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.astype(np.int64)), pa.array(packed, pa.binary())], names=["bucket", "packed"]
                )

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        x = np.unique(np.frombuffer(b"".join(table.column("packed").to_pylist()), dtype="<u8"))
        a, b = bucket_links(x, bucket, Flips(bits, radius), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = distinct.select("simhash").mapInArrow(spread, "bucket bigint, packed binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, also: tuple[str, ...] = ()
) -> DataFrame:
    """``key``, columns to carry, ``simhash`` and ``component_id``, the smallest key reachable by links."""
    made = materialize(fingerprints(docs, key, text, also))
    distinct = materialize(made.groupBy("simhash").agg(F.min(key).alias("first_key")))
    linked = components(near_links(distinct, distinct.count(), radius))
    rooted = distinct.join(linked, distinct.simhash == linked.node, "left")
    rooted = materialize(rooted.select("simhash", "first_key", F.coalesce("root", "simhash").alias("root")))
    named = materialize(rooted.groupBy("root").agg(F.min("first_key").alias("component_id")))
    by_print = materialize(rooted.join(named, "root").select("simhash", "component_id"))
    return made.join(by_print, "simhash").select(key, *also, "simhash", "component_id")
