"""Texts in fixed blocks, and questions that blocks put to buckets of hashes.

Finding strings that several documents share needs every occurrence of a string in one
place. Here the texts stay where they are. They are written once, as a table bucketed by
block, and each block sends the distinct hashes of its candidates, packed, to buckets by
leading bits. A bucket sees every block's entries and answers each block in the order
asked, a few bits an entry. A block asks for each hash once, whatever the number of its
documents, so neither a hot string nor a hot document makes a bucket uneven.

Blocks meet their answers without a shuffle of texts, as both are partitioned by block.
Entries follow from the texts alone, so a lost task is simply done again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxelherd.llm.common import give_back, parts_for, text_bytes
from voxelherd.session import materialize, scratch_folder

# Documents in a block, bytes of text for each bucket of hashes.
BLOCK_ROWS = 1024
BUCKET_BYTES = 4_000_000
# Every block sends a row to every bucket. From so many rows on, blocks and buckets are up to
# LARGEST times as large, blocks as long as documents of mean length fill so many bytes at most.
MOST_SENT = 4_000_000
LARGEST = 2
BLOCK_BYTES = 16_000_000
MOST_BUCKETED = 50_000
# Row number within a partition, in the low bits of monotonically_increasing_id.
INDEX_BITS = 33

_tables: list[str] = []

ASK_SCHEMA = "block bigint, bucket bigint, packed binary"
REPLY_SCHEMA = "block bigint, bucket bigint, level int, packed binary"


def sizes_for(n: int, size: int) -> tuple[int, int]:
    """Documents in a block (a power of two) and leading bits that name a bucket, for a table of ``n`` and its bytes."""
    rows, spread = BLOCK_ROWS, BUCKET_BYTES
    for _ in range(int(math.log2(LARGEST))):
        if parts_for(n, rows) * (size / spread) <= MOST_SENT:
            break
        spread *= 2
        if 2 * rows * size <= BLOCK_BYTES * n:
            rows *= 2
    return rows, max(0, math.ceil(math.log2(max(1.0, size / spread))))


class Blocks:
    """The stored texts: ``block``, ``slot``, ``doc_id``, ``raw``, and ``rest``, a struct of columns to keep."""

    def __init__(self, docs: DataFrame, keep: list[str] | None = None):
        spark = docs.sparkSession
        rest = [F.struct(*[F.col(name) for name in keep]).alias("rest")] if keep else []
        rows = docs.select("doc_id", text_bytes().alias("raw"), *rest)
        # DDL of the kept columns, to be added to the schema of a result.
        self.rest = f", rest {rows.schema['rest'].dataType.simpleString()}" if keep else ""
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("bytes")).first()
        block_rows, self.bucket_bits = sizes_for(size["n"], size["bytes"] or 0)
        number = F.monotonically_increasing_id()
        index = number.bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
        part = F.shiftright(number, INDEX_BITS)
        per_block = int(math.log2(block_rows))
        block = F.shiftleft(part, INDEX_BITS - per_block) + F.shiftright(index, per_block)
        placed = rows.select(
            block.alias("block"), index.bitwiseAND(F.lit(block_rows - 1)).cast("int").alias("slot"), "doc_id", "raw",
            *(["rest"] if keep else []),
        )
        name = f"voxelherd_blocks_{uuid.uuid4().hex}"
        buckets = min(MOST_BUCKETED, parts_for(size["n"], block_rows))
        writer = placed.write.format("parquet").bucketBy(buckets, "block").option("path", scratch_folder(spark))
        writer.saveAsTable(name)
        _tables.append(name)
        self.table = spark.table(name)

    def map(self, function: Callable[[dict], Iterable[pa.RecordBatch]], schema: str, replies: DataFrame | None = None) -> DataFrame:
        """Apply a function to each block, with the answers it has got so far.

        It gets a dict of ``block``, ``doc_ids``, ``texts`` (in order), ``rest`` (an Arrow
        column or None) and ``answers``, by level the answers of all buckets in order.
        """

        def texts_of(rows: pa.Table) -> dict:
            order = np.argsort(rows.column("slot").to_numpy(), kind="stable")
            own = rows.take(pa.array(order))
            return {
                "block": own.column("block")[0].as_py(),
                "doc_ids": own.column("doc_id").to_pylist(),
                "texts": own.column("raw").to_pylist(),
                "rest": own.column("rest").combine_chunks() if "rest" in own.column_names else None,
                "answers": {},
            }

        kinds = to_arrow_schema(StructType.fromDDL(schema))
        names = kinds.names

        def table_of(batches: list[pa.RecordBatch]) -> pa.Table:
            return pa.Table.from_batches(batches).select(names) if batches else kinds.empty_table()

        if replies is None:

            def run(rows: pa.Table) -> pa.Table:
                try:
                    return table_of(list(function(texts_of(rows))))
                finally:
                    give_back()

            return self.table.groupBy("block").applyInArrow(run, schema)

        def run_both(rows: pa.Table, answers: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return kinds.empty_table()
            own = texts_of(rows)
            found: dict[int, list] = {}
            for level, bucket, packed in zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "packed")), strict=True):
                found.setdefault(level, []).append((bucket, packed))
            own["answers"] = {level: [p for _, p in sorted(parts)] for level, parts in found.items()}
            try:
                return table_of(list(function(own)))
            finally:
                give_back()

        return self.table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run_both, schema)


def drop_tables(spark: SparkSession) -> int:
    """Forget the tables of all blocks, once their results are written; returns how many.

    Their files lie in the shared folder and are deleted by ``session.release``.
    """
    count = len(_tables)
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    return count


def ask(block: int, hashes: np.ndarray, bits: int, columns: list[np.ndarray]) -> list[pa.RecordBatch]:
    """Rows that send sorted, distinct ``hashes`` with further columns to their buckets.

    A row's columns follow each other in its bytes; the bucket is the leading bits.
    """
    if not len(hashes):
        return []
    to = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), dtype=np.uint64)
    names, first = np.unique(to, return_index=True)
    stops = np.append(first[1:], len(hashes))
    packed = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(first, stops, strict=True)]
    return [
        pa.RecordBatch.from_arrays(
            [pa.array([block] * len(names), pa.int64()), pa.array(names.astype(np.int64)), pa.array(packed, pa.binary())],
            names=["block", "bucket", "packed"],
        )
    ]


def answer(asked: DataFrame, level: int, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Let each bucket answer all blocks; written to the shared folder.

    ``reply`` gets what the blocks sent and returns one answer for each, in order.
    """

    def run(rows: pa.Table) -> pa.Table:
        answers = reply(rows.column("packed").to_pylist())
        return pa.table({
            "block": rows.column("block"), "bucket": rows.column("bucket"),
            "level": pa.array([level] * rows.num_rows, pa.int32()), "packed": pa.array(answers, pa.binary()),
        })

    return materialize(asked.groupBy("bucket").applyInArrow(run, REPLY_SCHEMA))


def shared_by_several(sent: list[bytes], kind: str) -> list[bytes]:
    """Answer bits: which entries occur in two documents or more.

    A row has its distinct entries, then a byte for each that tells whether two documents
    of the block have it.
    """
    parts, flags = [], []
    width = np.dtype(kind).itemsize
    for row in sent:
        n = len(row) // (width + 1)
        parts.append(np.frombuffer(row, dtype=kind, count=n))
        flags.append(np.frombuffer(row, dtype=np.uint8, offset=n * width))
    entries, twice = np.concatenate(parts), np.concatenate(flags)
    ordered = np.sort(np.concatenate([entries, entries[twice > 0]]))
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return [np.packbits(_member(part, repeated)).tobytes() for part in parts]


def smaller_elsewhere(sent: list[bytes]) -> list[bytes]:
    """Answer bits: whether a document with a smaller id has the entry.

    Entries are a hash, a second hash of 4 bytes and the smallest id in the block.
    """
    parts = []
    for row in sent:
        n = len(row) // 20
        hashes = np.frombuffer(row, dtype="<u8", count=n)
        checks = np.frombuffer(row, dtype="<u4", count=n, offset=8 * n)
        ids = np.frombuffer(row[12 * n :], dtype="<i8")
        parts.append((hashes, checks, ids))
    hashes, checks, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
    least = np.minimum.reduceat(ids[order], first)
    found = np.empty(len(ids), dtype=bool)
    found[order] = np.repeat(least, np.diff(np.append(first, len(ids)))) < ids[order]
    stops = np.cumsum([len(p[0]) for p in parts])
    return [np.packbits(found[b - len(p[0]) : b]).tobytes() for p, b in zip(parts, stops, strict=True)]


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def bits_of(parts: list[bytes], hashes: np.ndarray, bits: int) -> np.ndarray:
    """Answer bits of a block's sorted hashes, from the answers of its buckets in order."""
    if not len(hashes):
        return np.zeros(0, dtype=bool)
    to = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), dtype=np.uint64)
    _, sizes = np.unique(to, return_counts=True)
    found = [np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n) for p, n in zip(parts, sizes, strict=True)]
    return np.concatenate(found).astype(bool)


def distinct_with_docs(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and for each whether two different documents have it."""
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
    if not len(first):
        return hashes, np.zeros(0, dtype=np.uint8)
    low, high = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
    return hashes[first], (low != high).astype(np.uint8)


def slide(values: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` over each run of ``size`` consecutive values, by doubling."""
    if len(values) < size:
        return values[:0]
    out, have = values, 1
    while have * 2 <= size:
        out, have = op(out[:-have], out[have:]), have * 2
    rest = size - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(keys: np.ndarray, valid: np.ndarray, span: int) -> np.ndarray:
    """Places whose key is the smallest of some valid run of ``span`` keys.

    ``valid`` tells for each run whether it counts. Equal runs have their anchors at
    equal places, and every valid run has one.
    """
    if len(keys) < span:
        return np.zeros(0, dtype=np.int64)
    least = slide(keys, span, np.minimum)
    least = np.where(valid[: len(least)], least, np.uint64(0))
    # The largest minimum of all runs over a place is its own key if it is one's anchor.
    padded = np.concatenate([np.zeros(span - 1, dtype=np.uint64), least, np.zeros(span - 1, dtype=np.uint64)])
    return np.flatnonzero(slide(padded, span, np.maximum) == keys)
