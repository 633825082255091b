"""Benchmark decontamination by a positional inverted index.

The index is partitioned by documents: each row of the stored table holds the postings
of one block of texts, for every term the sorted word positions in the block. Test
windows are the query set, taken in blocks of bounded size; a block of windows goes to
all rows of the index. A window starts from the postings of its rarest term in the
index row, moved back by the term's place in the window, and is intersected with the
lists of its other terms, moved likewise, from rare to common. What is left are the
places of the exact phrase, or, with ``slop``, of all terms near their places.

No text is shuffled: the index is built where texts are read and searched where it lies.
Terms are 64-bit hashes of words.

Defined results: null and empty texts have no words; an item of fewer words than a
window, but not none, is one window; rows that repeat a document are judged one by one;
items sharing an id count once, an item without an id is named by the empty text; empty
tables give no rows, or documents without hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelherd.llm.common import lean, parts_for, text_bytes
from voxelherd.llm.words import ALNUM, in_blocks, ranges, split_words
from voxelherd.session import materialize

# Bytes of text in an index row, and words of test items searched in one pass.
BLOCK_BYTES = 1_500_000
QUERY_WORDS = 300_000

INDEX_SCHEMA = (
    "block bigint, doc_ids array<bigint>, doc_words array<int>, terms binary, sizes binary, postings binary"
)
HITS_SCHEMA = (
    "block bigint, doc int, doc_id bigint, n_words bigint, "
    "hits array<struct<start: int, stop: int>>, items array<string>"
)


def _postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, sorted terms, postings per term, positions by term."""
    words = split_words(texts, ALNUM, lower=True)
    order = np.argsort(words.hashes, kind="stable")
    ordered = words.hashes[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, int)
    sizes = np.diff(np.concatenate([new, [len(ordered)]]))
    return np.diff(words.first), ordered[new], sizes.astype(np.int32), order.astype(np.int32)


def build_index(docs: DataFrame) -> DataFrame:
    """Positional index of ``doc_id``, ``text``, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("raw").to_pylist()
            for part in in_blocks(texts, len, BLOCK_BYTES):
                counts, terms, sizes, places = _postings(texts[part])
                # Differences within and across lists: small numbers, undone by one running sum.
                steps = np.diff(places, prepend=np.int32(0)).astype("<i4")
                planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes()
                columns = [
                    [number],
                    [batch.column("doc_id")[part.start : part.stop].to_pylist()],
                    [counts.astype(np.int32)],
                    [pack(terms.astype("<u8").tobytes())],
                    [pack(sizes.astype("<i4").tobytes())],
                    [pack(planes)],
                ]
                number += 1
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 3]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["block", "doc_ids", "doc_words", "terms", "sizes", "postings"]
                )

    return materialize(docs.select("doc_id", text_bytes().alias("raw")).mapInArrow(lean(run), INDEX_SCHEMA))


def test_windows(items: list[tuple[str, bytes]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By window length: the windows' terms, and the number of the item of each window."""
    words = split_words([text for _, text in items], ALNUM, lower=True)
    counts = np.diff(words.first)
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    long = np.flatnonzero(counts >= size)
    if len(long):
        n = counts[long] - size + 1
        starts = ranges(words.first[long], n)
        found[size] = words.hashes[starts[:, None] + np.arange(size)], np.repeat(long, n)
    for length in np.unique(counts[(counts > 0) & (counts < size)]):
        own = np.flatnonzero(counts == length)
        found[int(length)] = words.hashes[words.first[own][:, None] + np.arange(length)], own
    return found


class IndexRow:
    """Postings of one block, ready for intersections."""

    def __init__(self, row: dict):
        unpack = zstandard.ZstdDecompressor().decompress
        self.doc_words = np.array(row["doc_words"], dtype=np.int64)
        self.doc_first = np.concatenate([[0], np.cumsum(self.doc_words)])
        self.n_words = int(self.doc_first[-1])
        self.terms = np.frombuffer(unpack(row["terms"]), dtype="<u8")
        self.sizes = np.frombuffer(unpack(row["sizes"]), dtype="<i4").astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        planes = np.frombuffer(unpack(row["postings"]), dtype=np.uint8).reshape(4, -1)
        steps = np.ascontiguousarray(planes.T).view("<i4").ravel()
        self.places = np.cumsum(steps, dtype=np.int64)
        # Lists are sorted one after the other, so (term, place) is sorted as a whole.
        self.keys = np.repeat(np.arange(len(self.terms)), self.sizes) * (self.n_words + 1) + self.places

    def _near(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term's list has a place within ``slop`` of the one asked for."""
        low = np.clip(place - slop, 0, self.n_words)
        high = np.clip(place + slop, -1, self.n_words)
        at = np.searchsorted(self.keys, term * (self.n_words + 1) + low)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (high >= low) & (key <= term * (self.n_words + 1) + high)

    def search(self, windows: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of windows that occur, and where they start; one pair per occurrence."""
        none = np.empty(0, dtype=np.int64)
        if not len(self.terms) or not len(windows):
            return none, none
        size = windows.shape[1]
        at = np.minimum(np.searchsorted(self.terms, windows), len(self.terms) - 1)
        possible = np.flatnonzero((self.terms[at] == windows).all(axis=1))
        if not len(possible):
            return none, none
        at = at[possible]
        by_rarity = np.argsort(self.sizes[at], axis=1, kind="stable")
        pick = np.arange(len(possible))
        rarest = at[pick, by_rarity[:, 0]]
        n = self.sizes[rarest]
        window = np.repeat(pick, n)
        start = self.places[ranges(self.first[rarest], n)] - np.repeat(by_rarity[:, 0], n)
        doc = np.searchsorted(self.doc_first, start, side="right") - 1
        stop = self.doc_first[np.minimum(doc + 1, len(self.doc_words))]
        inside = (start >= 0) & (start + size <= stop)
        window, start = window[inside], start[inside]
        for step in range(1, size):
            if not len(window):
                break
            offset = by_rarity[window, step]
            kept = self._near(at[window, offset], start + offset, slop)
            window, start = window[kept], start[kept]
        return possible[window], start


def _search_row(row: dict, items: list, windows: dict, slop: int) -> Iterator[tuple]:
    index = IndexRow(row)
    edges = np.zeros(index.n_words + 1, dtype=np.int64)
    docs, names = [], []
    for size, (terms, owner) in windows.items():
        window, start = index.search(terms, slop)
        np.add.at(edges, start, 1)
        np.add.at(edges, start + size, -1)
        docs.append(np.searchsorted(index.doc_first, start, side="right") - 1)
        names.append(owner[window])
    covered = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    # Runs end at the borders of documents too.
    change = covered[1:] != covered[:-1]
    opened = np.flatnonzero(change & covered[1:])
    closed = np.flatnonzero(change & covered[:-1])
    pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(names)]), axis=1) if docs else np.empty((2, 0), int)
    by_doc: dict[int, set] = {}
    for doc, item in pairs.T.tolist():
        by_doc.setdefault(doc, set()).add(items[item][0])
    runs: dict[int, list] = {}
    for a, b in zip(opened.tolist(), closed.tolist(), strict=True):
        doc = int(np.searchsorted(index.doc_first, a, side="right")) - 1
        while a < b:
            stop = min(b, int(index.doc_first[doc + 1]))
            if stop > a:
                base = int(index.doc_first[doc])
                runs.setdefault(doc, []).append({"start": a - base, "stop": stop - base})
            a, doc = max(a, stop), doc + 1
    for doc, (doc_id, n) in enumerate(zip(row["doc_ids"], index.doc_words.tolist(), strict=True)):
        yield row["block"], doc, doc_id, n, runs.get(doc, []), sorted(by_doc.get(doc, ()))


def _hit_words(hits: Column) -> Column:
    """Words covered by runs that may overlap."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(state: Column, hit: Column) -> Column:
        begin = F.greatest(hit["start"], state["end"])
        end = F.greatest(hit["stop"], state["end"])
        return F.struct(end.alias("end"), (state["n"] + F.greatest(end - begin, F.lit(0))).alias("n"))

    return F.aggregate(F.sort_array(hits), start, step, lambda s: s["n"])


def find_items(index: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``hits`` (runs of words), ``items``.

    ``benchmark`` has ``item_id`` and ``text``. It is searched in blocks of about
    QUERY_WORDS words (80 bytes of windows each), each in one pass over the stored index.
    """
    spark = index.sparkSession
    raw = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("raw")
    ).distinct()
    total = raw.agg(F.sum(F.length("raw"))).first()[0] or 0
    passes = parts_for(total, QUERY_WORDS * 5)
    found = None
    for number in range(passes):
        own = raw.where(F.pmod(F.xxhash64("item", "raw"), F.lit(passes)) == number)
        items = [(row["item"], bytes(row["raw"])) for row in own.collect()]
        windows = test_windows(items, size)
        named = spark.sparkContext.broadcast(([(name, b"") for name, _ in items], windows))

        def run(batches: Iterator[pa.RecordBatch], named=named) -> Iterator[pa.RecordBatch]:
            names, queries = named.value
            schema = pa.schema([
                ("block", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                ("hits", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                ("items", pa.list_(pa.string())),
            ])
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                    columns = list(zip(*_search_row(row, names, queries, slop), strict=True))
                    if columns:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                        )

        part = index.mapInArrow(lean(run), HITS_SCHEMA)
        found = part if found is None else found.unionByName(part)
    if passes > 1:
        found = found.groupBy("block", "doc", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("hits")).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    return found.select("doc_id", "n_words", "hits", F.array_sort("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """Index the documents, search the items, and add ``n_hit`` and ``contaminated``."""
    found = find_items(build_index(docs), benchmark, size, slop)
    n_hit = _hit_words(F.col("hits"))
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)
