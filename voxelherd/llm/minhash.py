"""MinHash fingerprints, neighbours in key order, and banded near-duplicate pairs.

A text is the set of its runs of five words (lower case; a shorter text is one run, a
text without words has none). Each of PERMUTATIONS universal hash functions
``(a * x + b) mod 2**64`` gives one minimum; its bits are mixed, as minima of long texts
are small, and the fingerprint keeps 16 of them.
The share of equal places estimates the Jaccard similarity of two sets.

Defined results: a null text is empty; texts without words share one fingerprint;
repeated rows are handled one by one; documents are ordered by key, descending, null
last, ties by the digest of the text; a lone document is its own neighbour; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.llm.common import parts_for, text_bytes
from voxelherd.llm.components import components
from voxelherd.llm.words import ALNUM, SECOND, in_blocks, mix, ranges, split_words, stretch, prefix
from voxelherd.session import materialize

SHINGLE = 5
PERMUTATIONS = 128
# At similarity 0.8, 32 bands of 4 miss 5 pairs in 10**8.
BANDS = 32
THRESHOLD = 0.8
# Bytes of text hashed together, documents of neighbouring keys in one task.
TEXT_AT_ONCE = 1_500_000
SLICE_ROWS = 1000
# Pairs for each member of a band that are compared without a second round.
PAIRS_AT_ONCE = 20
# Shingles whose hashes a task keeps while it compares pairs.
SETS_HELD = 4_000_000
# Members from which a band is hot, parts of the shingles for which a text's shared ones are
# counted, and bytes of hot texts whose shingles meet in one bucket.
HOT_BAND = 64
PARTS = 16
BUCKET_BYTES = 32 << 20

_random = np.random.RandomState(20240229)
FACTORS = _random.randint(0, 1 << 62, PERMUTATIONS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.randint(0, 1 << 62, PERMUTATIONS).astype(np.uint64)


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of words, and the number of runs of each text."""
    words = split_words(texts, ALNUM, lower=True)
    counts = np.diff(words.first)
    runs = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    starts = ranges(words.first[:-1], runs)
    sizes = np.repeat(np.minimum(counts, SHINGLE), runs)
    return stretch(prefix(words.hashes), starts, starts + sizes), runs


def signatures(texts: list[bytes]) -> np.ndarray:
    """One row of PERMUTATIONS minima, 16 mixed bits of each, for each text."""
    values, runs = shingle_hashes(texts)
    out = np.full((len(texts), PERMUTATIONS), 0xFFFF, dtype=np.uint16)
    own = np.flatnonzero(runs)
    if len(own):
        first = (np.cumsum(runs) - runs)[own]
        for p in range(PERMUTATIONS):
            least = np.minimum.reduceat(values * FACTORS[p] + SHIFTS[p], first)
            out[own, p] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (a == b).mean(axis=1)


def brief(minima: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, two in a byte."""
    bits = (minima & np.uint16(15)).astype(np.uint8)
    return bits[:, 0::2] | (bits[:, 1::2] << 4)


def brief_likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places of two tables of :func:`brief`; a sixteenth of the others agree by chance."""
    differ = a ^ b
    return ((differ & 15 == 0).sum(axis=1) + (differ >> 4 == 0).sum(axis=1)) / (2 * a.shape[1])


def fingerprint_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` (bytes of the minima) of each document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("raw").to_pylist()
            for part in in_blocks(texts, len, TEXT_AT_ONCE):
                rows = [row.tobytes() for row in signatures(texts[part])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key)[part.start : part.stop], pa.array(rows, pa.binary())], names=[key, "fingerprint"]
                )

    return docs.select(key, text_bytes(text).alias("raw")).mapInArrow(run, f"`{key}` {kind}, fingerprint binary")


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_key_order(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """Packed texts, one partition per range of keys, with the neighbour beyond each range.

    Range borders are existing keys, so the first document beyond a range is known by
    its key and is sent to both ranges as texts are read: they are shuffled once, packed.
    Rows come sorted by (``guest``, key descending); guests follow the range's own rows.
    Rows of ``groups`` (:func:`near_groups`) come as rows without a text before the documents
    of their key, so that only keys and nodes are shuffled for them.
    """
    bounds = docs.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("most")).first()
    slices = parts_for(bounds["n"], SLICE_ROWS)
    shares = [i / slices for i in range(1, slices)]
    cuts = docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * slices)).alias("cuts")).first()["cuts"] if shares else []
    cuts = np.unique(np.array([c for c in cuts or [] if c != bounds["most"]], dtype=np.int64))
    most = bounds["most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            keys = batch.column("key").to_pylist()
            packed = [pack(t) for t in batch.column("raw").to_pylist()]
            rows = []
            for i, own in enumerate(keys):
                at = 0 if own is None else int(np.searchsorted(cuts, own))
                rows.append((at, False, i))
                if own is not None and at < len(cuts) and cuts[at] == own:
                    rows.append((at + 1, True, i))
                if own == most:
                    rows.append((0, True, i))
            where, guest, index = (np.array(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(where, pa.int32()), pa.array(guest, pa.bool_()),
                    pa.array([keys[i] for i in index], pa.int64()), pa.array([packed[i] for i in index], pa.binary()),
                ],
                names=["slice", "guest", "key", "packed"],
            )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("key")
            at = np.searchsorted(cuts, own.fill_null(0).to_numpy(zero_copy_only=False))
            where = np.where(own.is_null().to_numpy(zero_copy_only=False), 0, at)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *batch.columns], names=["slice", *batch.schema.names])

    named = docs.select(F.col(key).cast("bigint").alias("key"), text_bytes(text).alias("raw"))
    rows = named.mapInArrow(run, "slice int, guest boolean, key bigint, packed binary")
    if groups is not None:
        grouped = named.select("key", F.xxhash64("raw").alias("node")).join(groups, "node").select("key", "node", "group_id", "group_rows")
        placed = grouped.distinct().mapInArrow(place, "slice int, key bigint, node bigint, group_id bigint, group_rows bigint")
        rows = rows.unionByName(placed.withColumn("guest", F.lit(False)), allowMissingColumns=True)
    else:
        rows = rows.withColumns({c: F.lit(None).cast("bigint") for c in ("node", "group_id", "group_rows")})
    spread = rows.repartitionById(len(cuts) + 1, "slice")
    return spread.sortWithinPartitions("slice", "guest", F.col("key").desc_nulls_last(), F.md5("packed"))


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text takes its second half from the next document in descending key order;
    ``node`` names the text, see :func:`text_node`; ``group_id`` and ``group_rows`` are those
    of its row in ``groups``, if there is one.
    """
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, node bigint, group_id bigint, group_rows bigint"
    )

    def compare(keys: list, texts: list[str], first: np.ndarray | None, known: dict) -> tuple[pa.RecordBatch, np.ndarray]:
        """All rows but the last, which is only the neighbour; also the last one's fingerprint."""
        new = texts if first is None else texts[1:]
        made = signatures([t.encode() for t in new])
        own = made if first is None else np.concatenate([first[None], made])
        edited = [edited_text(a, b).encode() for a, b in zip(texts[:-1], texts[1:], strict=True)]
        changed = signatures(edited)
        nodes = [text_node(t.encode()) for t in texts[:-1]]
        found = [known.get(place, (None, None)) for place in zip(keys[:-1], nodes, strict=True)]
        columns = [
            pa.array(keys[:-1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
            pa.array([row.tobytes().hex() for row in own[:-1]], pa.string()),
            pa.array([row.tobytes().hex() for row in changed], pa.string()),
            pa.array(likeness(own[:-1], changed), pa.float64()),
            pa.array(likeness(own[:-1], own[1:]), pa.float64()),
            pa.array(nodes, pa.int64()),
            pa.array([g for g, _ in found], pa.int64()),
            pa.array([n for _, n in found], pa.int64()),
        ]
        names = [field.split()[0] for field in schema.split(", ")]
        return pa.RecordBatch.from_arrays(columns, names=names), own[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        keys: list = []
        texts: list[str] = []
        first, size, at, closed = None, 0, None, False
        known: dict = {}
        for batch in batches:
            for slice_no, guest, own, packed, node, *group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slice_no != at:
                    keys, texts, first, size, at, closed, known = [], [], None, 0, slice_no, False, {}
                if packed is None:
                    known[own, node] = tuple(group)
                    continue
                if closed:
                    continue  # further guests with the same key
                content = unpack(packed).decode()
                keys.append(own)
                texts.append(content)
                size += len(content)
                closed = guest
                if len(texts) > 1 and (guest or size >= TEXT_AT_ONCE):
                    done, first = compare(keys, texts, first, known)
                    yield done
                    keys, texts, size = keys[-1:], texts[-1:], 0
                    if guest:
                        keys, texts = [], []

    return in_key_order(docs, key, text, groups).mapInArrow(run, schema)


def _sketches(texts: DataFrame) -> DataFrame:
    """``node`` (hash of a text), ``minima`` and ``brief`` of each distinct text with words, from ``raw``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            for part in in_blocks(raw, len, TEXT_AT_ONCE):
                own = [i for i in range(part.start, part.stop) if ALNUM[np.frombuffer(raw[i], dtype=np.uint8)].any()]
                rows = [row.tobytes() for row in signatures([raw[i] for i in own])] if own else []
                nodes = [text_node(raw[i]) for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(rows, pa.binary())], names=["node", "minima"])

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), dtype=np.uint16).reshape(-1, PERMUTATIONS)
            rows = pa.array([row.tobytes() for row in brief(minima)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("minima"), rows], names=["node", "minima", "brief"])

    made = texts.select("raw").mapInArrow(run, "node bigint, minima binary").groupBy("node").agg(F.first("minima").alias("minima"))
    return made.mapInArrow(shorten, "node bigint, minima binary, brief binary")


def text_node(raw: bytes) -> int:
    """The hash that stands for a text, as ``xxhash64`` gives it."""
    return int(np.uint64(xxhash.xxh64_intdigest(raw, 42)).view(np.int64))


def _members(sketches: DataFrame, bands: int) -> DataFrame:
    """``band`` and ``node``: one row for each text and band."""
    width = PERMUTATIONS // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = b"".join(batch.column("minima").to_pylist())
            rows = np.frombuffer(packed, dtype=np.uint16).reshape(-1, bands, width).astype(np.uint64)
            sums = np.zeros(rows.shape[:2], dtype=np.uint64)
            for i in range(width):
                sums = mix((sums + rows[:, :, i] + np.uint64(1)) * SECOND)
            sums = mix(sums + np.arange(bands, dtype=np.uint64))
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(sums.ravel().view(np.int64)), pa.array(nodes)], names=["band", "node"])

    return sketches.select("node", "minima").mapInArrow(run, "band bigint, node bigint")


def _parted(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of texts, the leading bits being the part, and the text of each."""
    values, runs = shingle_hashes(raw)
    owners = np.repeat(np.arange(len(raw)), runs)
    values = mix(values)
    order = np.lexsort((owners, values))
    values, owners = values[order], owners[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[first], owners[first]


def shared_shingles(texts: DataFrame) -> DataFrame:
    """``node``, ``runs`` (distinct shingles) and ``shared``: by part of the shingles, those that another text has too.

    A batch of texts sends a shingle once to its bucket, with the text if it has just one. A
    bucket tells how many shingles of a text nobody else has sent.
    """
    total = texts.agg(F.sum(F.length("raw"))).first()[0] or 0
    bits = PARTS.bit_length() - 1 + (parts_for(total, PARTS * BUCKET_BYTES) - 1).bit_length()
    part_of = np.uint64(64 - PARTS.bit_length() + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, nodes = batch.column("raw").to_pylist(), batch.column("node").to_numpy(zero_copy_only=False)
            for part in in_blocks(raw, len, TEXT_AT_ONCE):
                values, owners = _parted(raw[part])
                values, at, times = np.unique(values, return_index=True, return_counts=True)
                own = nodes[part][owners[at]]
                buckets, first = np.unique(values >> np.uint64(64 - bits), return_index=True)
                stops = np.append(first[1:], len(values))
                packed = [
                    [values[a:b].tobytes(), own[a:b].tobytes(), (times[a:b] > 1).tobytes()] for a, b in zip(first, stops, strict=True)
                ]
                columns = [pa.array([row[i] for row in packed], pa.binary()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), *columns], names=["bucket", "hashes", "nodes", "several"])

    def meet(rows: pa.Table) -> pa.Table:
        values, nodes, several = (
            np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("hashes", "<u8"), ("nodes", "<i8"), ("several", "?"))
        )
        _, at, times = np.unique(values, return_index=True, return_counts=True)
        lone = at[(times == 1) & ~several[at]]
        part = int(values[0] >> part_of)
        owners, counts = np.unique(nodes[lone], return_counts=True)
        return pa.table({"node": owners, "part": pa.array([part] * len(owners), pa.int32()), "n": counts.astype(np.int64)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            for part in in_blocks(raw, len, TEXT_AT_ONCE):
                values, owners = _parted(raw[part])
                cells = owners * PARTS + (values >> part_of).astype(np.int64)
                sizes = np.bincount(cells, minlength=len(raw[part]) * PARTS).reshape(-1, PARTS)
                rows = pa.array(list(sizes), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node")[part.start : part.stop], rows], names=["node", "sizes"])

    sent = texts.select("node", "raw").mapInArrow(send, "bucket bigint, hashes binary, nodes binary, several binary")
    lone = sent.groupBy("bucket").applyInArrow(meet, "node bigint, part int, n bigint")
    lone = lone.groupBy("node").agg(*[F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(f"lone{p}") for p in range(PARTS)])
    made = texts.select("node", "raw").mapInArrow(count, "node bigint, sizes array<bigint>").join(materialize(lone), "node", "left")
    shared = [F.col("sizes")[p] - F.coalesce(f"lone{p}", F.lit(0)) for p in range(PARTS)]
    return made.select("node", sum(F.col("sizes")[p] for p in range(PARTS)).alias("runs"), F.array(*shared).alias("shared"))


def _may_reach(common, sizes, threshold: float):
    """Whether texts of ``sizes`` shingles together can be as alike as ``threshold`` with ``common`` ones at most."""
    return common * (1 + threshold) >= sizes * threshold - 1e-6


def _bounded(members: DataFrame, texts: DataFrame, bands_now: DataFrame, threshold: float) -> DataFrame:
    """Members with ``runs``, ``shared`` and ``lone`` if their text is in a hot band, else null.

    Left out of a hot band is who cannot reach the threshold with any text of its least size.
    """
    hot = bands_now.where(F.col("all") >= HOT_BAND).select("band", F.lit(True).alias("hot"))
    nodes = materialize(members.join(hot, "band", "left_semi").select("node").distinct())
    own = materialize(texts.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("raw").alias("raw")))
    known = materialize(shared_shingles(own))
    made = materialize(members.join(known, "node", "left").join(hot, "band", "left"))
    least = materialize(made.where("hot").groupBy("band").agg(F.min("runs").alias("least")))
    common = sum(F.col("shared")[p] for p in range(PARTS))
    sizes = F.col("runs") + F.greatest("least", F.col("runs") * threshold)
    stay = F.col("least").isNull() | _may_reach(common, sizes, threshold)
    columns = [*members.columns, "runs", "shared"]
    return materialize(made.join(least, "band", "left").where(stay).select(*columns, (F.col("runs") - common).alias("lone")))


def _verified(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (``a``, ``b``) of texts whose exact Jaccard similarity reaches ``threshold``.

    Pairs whose brief minima are five standard deviations below the threshold are not read.
    """
    agree = threshold + (1 - threshold) / 16
    least = agree - 5 * float(np.sqrt(agree * (1 - agree) / PERMUTATIONS))
    schema = "a bigint, b bigint, similarity double"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, PERMUTATIONS // 2) for c in ("one", "two")
            )
            keep = pa.array(brief_likeness(left, right) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = []
            for pair in zip(a, b, batch.column("one"), batch.column("two"), strict=True):
                sets = []
                for node, body in zip(pair[:2], pair[2:], strict=True):
                    own = known.get(node)
                    if own is None:
                        own = np.unique(shingle_hashes([unpack(body.as_py())])[0])
                        if held + len(own) > SETS_HELD:
                            known, held = {}, 0
                        known[node] = own
                        held += len(own)
                    sets.append(own)
                one, two = sets
                common = len(np.intersect1d(one, two, assume_unique=True))
                found.append(common / (len(one) + len(two) - common))
            keep = [i for i, value in enumerate(found) if value >= threshold]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()),
                 pa.array([found[i] for i in keep], pa.float64())],
                names=["a", "b", "similarity"],
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = [pack(t) for t in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rows, pa.binary())], names=["node", "packed"])

    def joined(values: DataFrame, what: DataFrame, column: str) -> DataFrame:
        one = values.select(F.col("node").alias("a"), F.col(column).alias("one"))
        two = values.select(F.col("node").alias("b"), F.col(column).alias("two"))
        return what.join(one, "a").join(two, "b").select("a", "b", "one", "two")

    close = materialize(joined(sketches, pairs, "brief").mapInArrow(near, "a bigint, b bigint"))
    asked = materialize(close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct())
    bodies = texts.join(asked, "node", "left_semi").mapInArrow(packed, "node bigint, packed binary")
    bodies = materialize(bodies.groupBy("node").agg(F.first("packed").alias("packed")))
    return materialize(joined(bodies, close, "packed").mapInArrow(exact, schema))


def near_links(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """Links (``a`` < ``b``, ``similarity``) of distinct texts, named by :func:`text_node`.

    Their components are those of all pairs that share a band and reach ``threshold``.
    Each round compares the members of a band with one leader. Links join texts to
    components, and only pairs of different components are left to compare: in a band,
    those of every text outside its largest component. When these are no more than
    PAIRS_AT_ONCE for each member they are compared at once; until then the leader,
    which has met all others, leaves, and a text of the smallest component leads. The
    limit grows tenfold each round, so the rounds are few; no pair is left out.

    Before the first leader of hot bands, the shingles of their texts are counted that
    another of these texts has too. Two texts have no more in common than the smaller counts
    of each part of the shingles, so pairs that cannot reach the threshold are not made, and
    texts that cannot with any other leave their band. The leader is a text with few of its own.
    """
    texts = docs.select(text_bytes().alias("raw")).withColumn("node", F.xxhash64("raw"))
    sketches = materialize(_sketches(texts))
    members = _members(sketches, bands)
    shared = materialize(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"))
    # Bands with the same members say the same.
    members = materialize(members.join(shared, "band"))
    sums = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"))
    once = materialize(sums.groupBy("n", "all").agg(F.min("band").alias("band")).select("band"))
    members = materialize(members.join(once, "band").withColumn("root", F.col("node")))
    none = {"runs": "bigint", "shared": "array<bigint>", "lone": "bigint"}
    plain, members = members, members.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()})
    common = sum(F.least(F.col("shared")[p], F.col("one_shared")[p]) for p in range(PARTS))
    reach = F.col("shared").isNull() | F.col("one_shared").isNull() | _may_reach(common, F.col("runs") + F.col("one_runs"), threshold)
    other = ["band", F.col("node").alias("one"), F.col("root").alias("part"), F.col("runs").alias("one_runs"), F.col("shared").alias("one_shared")]
    links, limit, bounded = None, PAIRS_AT_ONCE, False
    while True:
        first = F.min(F.struct(F.coalesce("lone", F.lit(0)).alias("lone"), "node"))
        parts = materialize(members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), first.alias("node")))
        bands_now = parts.groupBy("band").agg(
            F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most"), F.min(F.struct("n", "node")).alias("least"), F.count(F.lit(1)).alias("parts")
        ).where("parts > 1")
        bands_now = materialize(bands_now.select("band", "all", F.col("most.root").alias("main"), F.col("most.n").alias("most"), F.col("least.node.node").alias("leader")))
        size = bands_now.agg(F.sum("all").alias("members"), F.sum((F.col("all") - F.col("most")) * F.col("all")).alias("pairs")).first()
        if size["members"] is None:
            break
        last = size["pairs"] <= limit * size["members"]
        if not (last or bounded):
            members, bounded = _bounded(plain, texts, bands_now, threshold), True
            continue
        members = members.join(bands_now, "band")
        limit *= 10
        if last:
            strays = materialize(members.where("root <> main").select(*other))
            pairs = members.join(strays, "band").where("root <> part AND (root = main OR node < one)").where(reach).select("node", "one")
        else:
            members = materialize(members)
            led = materialize(members.where("node = leader").select(*other))
            pairs = members.join(led, "band").where("root <> part").where(reach).select("node", "one")
        pairs = materialize(pairs.select(F.least("node", "one").alias("a"), F.greatest("node", "one").alias("b")).distinct())
        found = _verified(texts, sketches, pairs, threshold)
        links = found if links is None else links.unionByName(found)
        if last:
            break
        roots = materialize(components(links))
        left = members.where("node <> leader").select("band", "node", *none).join(roots, "node", "left")
        members = materialize(left.select("band", "node", F.coalesce("root", "node").alias("root"), *none))
    return links.distinct() if links is not None else docs.sparkSession.createDataFrame([], "a bigint, b bigint, similarity double")


def near_groups(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """``node``, ``group_id`` (smallest key) and ``group_rows`` of texts with copies or near copies.

    A text that is not listed is alone. Texts without words have exact copies only.
    """
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text_bytes()).alias("node"))
    classes = materialize(texts.groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")))
    roots = materialize(components(near_links(docs, threshold, bands)))
    rooted = materialize(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = rooted.groupBy("root").agg(F.min("key").alias("group_id"), F.sum("n").alias("group_rows")).where("group_rows > 1")
    return materialize(rooted.join(materialize(named), "root").select("node", "group_id", "group_rows"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """Links of texts with their verified Jaccard similarity; see :func:`near_links`.

    Equal texts are one class, named by its smallest ``doc_id``; result rows are
    ``doc_id`` (a class), ``leader`` (a smaller class) and ``similarity``. Documents
    without an id are left out. Membership of every document is in :func:`near_groups`.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    texts = docs.select("doc_id", F.xxhash64(text_bytes()).alias("node"))
    classes = materialize(texts.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    links = near_links(docs, threshold, bands)
    one = classes.select(F.col("node").alias("a"), F.col("doc_id").alias("one"))
    two = classes.select(F.col("node").alias("b"), F.col("doc_id").alias("two"))
    named = links.join(one, "a").join(two, "b")
    return named.select(F.greatest("one", "two").alias("doc_id"), F.least("one", "two").alias("leader"), "similarity")


def with_groups(docs: DataFrame) -> DataFrame:
    """:func:`compare_edits`, with ``near_group`` and ``near_group_rows`` of each document.

    The group is named by its smallest ``doc_id``, null if it has none.
    """
    groups = near_groups(docs)
    made = compare_edits(docs, groups=groups)
    group = F.when(F.col("group_rows").isNull(), F.col("doc_id")).otherwise(F.col("group_id"))
    return made.select(
        *[c for c in made.columns if c not in groups.columns], group.alias("near_group"), F.coalesce("group_rows", F.lit(1)).alias("near_group_rows")
    )
