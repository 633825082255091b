"""Byte-level BPE by recursive DuckDB queries inside each Spark task.

Texts are split by the tokenizer's pattern. Each worker keeps the merge table (token
pair to merged token) in a DuckDB connection of its own. Words the worker has not met
yet are given to a recursive query, all new words of a batch at once, as a query costs a
fixed time besides that of its words. A word is one row with the list of its tokens, each with the
rank of the pair that it makes with the next one. A round contracts the leftmost pair of minimum
rank of each word and joins the two pairs around it with the merge table, until
no pair is left. Ids are decoded by an aggregation over token bytes ordered by position.

Words of more than SHORT bytes would need as many rounds as they have bytes. For them a
round contracts all occurrences of the minimum rank from the left, up to and including
the first one after which a pair of still lower rank appears. Contracting one at a time
would do the same steps in the same order, so both queries give the same tokens; a run
of n equal bytes takes about log n rounds. Their state is keyed, so it does not grow
with the rounds. Words of more than PIECE bytes are encoded in pieces, whose borders are
encoded anew until all neighbouring tokens fit, so a query stays small for words of any length.

Defined results: a null text is empty and has no tokens; repeated rows and ties are
encoded one by one; an empty table gives no rows; other columns are ignored. Texts are
decoded in slices, so their length is not limited by the query's memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voxelherd.llm.common import give_back, lean
from voxelherd.llm.words import in_blocks, ranges

# Words up to this many bytes take one contraction a round.
SHORT = 32
# Words in one query, bytes in one query (a word counts as some more), words kept by a worker.
WORDS_AT_ONCE = 40_000
BYTES_AT_ONCE = 2_000_000
KNOWN_WORDS = 500_000
# Longest piece of a word, bytes of long words in one query, and pairs kept by a worker.
PIECE = 32_768
LONG_AT_ONCE = 262_144
KNOWN_PAIRS = 200_000
# Texts tokenized together (an Arrow batch, as a rule), and tokens decoded together.
TEXT_AT_ONCE = 4_000_000
SLICE = 150_000
SLICES_AT_ONCE = 150_000

# Bits of an id and of a rank, and the rank of no pair.
ID_BITS = 24
ID = (1 << ID_BITS) - 1

# A token of a short word as one number: rank of its pair, place in the word (8 bits), id. So the
# smallest number of a word is its leftmost pair of minimum rank.
ENCODE_SHORT = f"""
WITH RECURSIVE state AS (
  SELECT w, tokens, list_min(tokens) AS low FROM start
  UNION ALL
  (WITH found AS (
     SELECT w, tokens, low, low >> 32 AS made, list_position(tokens, low) AS k FROM state WHERE low >> 32 < {ID}
   ), sides AS (
     SELECT *, tokens[k - 1] AS before, tokens[k + 2] AS after FROM found
   ), joined AS (
     SELECT w, tokens, k, (coalesce(a.merged, {ID}) << 32) | (before & {(1 << 32) - 1}) AS before,
            (coalesce(b.merged, {ID}) << 32) | (low & {255 << ID_BITS}) | made AS made
     FROM sides LEFT JOIN pairs a ON a.pair = ((before & {ID}) << {ID_BITS}) | made
     LEFT JOIN pairs b ON b.pair = (made << {ID_BITS}) | (after & {ID})
   ), contracted AS (
     SELECT w, CASE WHEN k > 1 THEN tokens[1 : k - 2] || [before, made] || tokens[k + 2 :]
                    ELSE [made] || tokens[k + 2 :] END AS tokens
     FROM joined
   )
   SELECT w, tokens, list_min(tokens) FROM contracted)
)
SELECT w, tokens AS ids FROM state WHERE low >> 32 = {ID}"""

ENCODE_LONG = """
WITH RECURSIVE state(w, pos, id, step) USING KEY (w, pos) AS (
  SELECT w, pos, id, 0 FROM start
  UNION
  (WITH placed AS (
     SELECT w, pos, id, step, row_number() OVER o AS k, lag(id) OVER o AS before, lead(id) OVER o AS next_id,
            lead(id, 2) OVER o AS after
     FROM state WHERE id >= 0 WINDOW o AS (PARTITION BY w ORDER BY pos)
   ), ranked AS (
     SELECT p.*, merged, min(merged) OVER (PARTITION BY w) AS low
     FROM placed p LEFT JOIN merges ON l = id AND r = next_id
   ), live AS (
     SELECT * FROM ranked WHERE low IS NOT NULL
   ), hits AS (
     SELECT *, k - row_number() OVER (PARTITION BY w ORDER BY k) AS run FROM live WHERE merged = low
   ), turns AS (
     SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY k) AS n FROM hits
   ), checked AS (
     SELECT t.w, t.k, t.low, coalesce(a.merged < t.low, false) OR coalesce(b.merged < t.low, false) AS stop
     FROM (SELECT * FROM turns WHERE n % 2 = 1) t
     LEFT JOIN merges a ON a.l = CASE WHEN n > 1 THEN low ELSE before END AND a.r = low
     LEFT JOIN merges b ON b.l = low AND b.r = after
   ), chosen AS (
     SELECT w, k, low
     FROM (SELECT *, min(k) FILTER (stop) OVER (PARTITION BY w) AS until FROM checked)
     WHERE until IS NULL OR k <= until
   )
   SELECT v.w, v.pos, CASE WHEN c.k = v.k THEN c.low WHEN g.k IS NOT NULL THEN -1 ELSE v.id END, v.step + 1
   FROM live v LEFT JOIN chosen c ON c.w = v.w AND c.k = v.k
   LEFT JOIN chosen g ON g.w = v.w AND g.k + 1 = v.k)
)
SELECT w, list(id ORDER BY pos) AS ids FROM state WHERE id >= 0 GROUP BY w"""

DECODE = "SELECT list(token ORDER BY pos) AS raw FROM flat LEFT JOIN vocabulary USING (id)"


@dataclass(frozen=True)
class Tokenizer:
    """Contents of a rank file (base64 token, rank) and the pattern that splits texts."""

    ranks: bytes
    pattern: str


def load_tokenizer(path: str, pattern: str, most_bytes: int = 64 << 20) -> Tokenizer:
    """Read a rank file. It goes to every worker, so its size is checked."""
    with open(path, "rb") as file:
        ranks = file.read(most_bytes + 1)
    if len(ranks) > most_bytes:
        raise ValueError(f"{path} has more than {most_bytes} bytes")
    return Tokenizer(ranks, pattern)


class Words(dict):
    """Numbers of words, and their ids. Looking up a new word gives it the next number; its ids follow with ``add``."""

    def __init__(self):
        self.fresh: list[str] = []
        self.ids = np.zeros(0, dtype="<u4")
        self.ends = np.zeros(1, dtype=np.int64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def add(self, encoded: list[bytes]) -> None:
        """Ids of all fresh words, in order."""
        sizes = np.array([len(ids) // 4 for ids in encoded], dtype=np.int64)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(encoded), dtype="<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.fresh = []

    def joined(self, numbers: np.ndarray) -> bytes:
        """Ids of the words with these numbers, one after the other."""
        first = self.ends[numbers]
        return self.ids[ranges(first, self.ends[numbers + 1] - first)].tobytes()


class Engine:
    """Merge table, vocabulary and the words met so far, in one worker."""

    def __init__(self, tokenizer: Tokenizer):
        rows = (line.split() for line in tokenizer.ranks.splitlines() if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        merges = [
            (ranks[token[:cut]], ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.tokens = {rank: token for token, rank in ranks.items()}
        if max(self.tokens) >= ID:
            raise ValueError(f"ids of {ID_BITS} bits at most")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.find = regex.compile(tokenizer.pattern).findall
        # Ranks of the pairs of two bytes, with which a short word begins.
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), ID) for b in range(256)] for a in range(256)], dtype=np.int32)
        # Words met since the last turn, words of the turn before, and pairs that stand as they are.
        self.known, self.older = Words(), Words()
        self.stable: dict[tuple[int, int], bool] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        left, right, merged = (pa.array(column, pa.int32()) for column in zip(*merges, strict=True))
        self._put("merges_in", pa.table({"l": left, "r": right, "merged": merged}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.con.execute(f"CREATE TABLE pairs AS SELECT (l::BIGINT << {ID_BITS}) | r AS pair, merged::BIGINT AS merged FROM merges")
        self._put("vocabulary_in", pa.table({"id": pa.array(ranks.values(), pa.int32()), "token": pa.array(ranks, pa.binary())}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")
        for name in ("merges_in", "vocabulary_in"):
            self.con.unregister(name)

    def _put(self, name: str, rows: pa.Table) -> None:
        self.con.register(name, rows)

    def _contract(self, raw: list[bytes], query: str) -> list[bytes]:
        """Ids of each word, contracted by a query."""
        sizes = np.array([len(word) for word in raw])
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(sizes)
        pos, ids = np.arange(len(flat)) - np.repeat(ends - sizes, sizes), self.byte_ids[flat]
        if query == ENCODE_SHORT:
            ranks = np.append(self.byte_pairs[flat[:-1], flat[1:]], ID).astype(np.int64)
            ranks[ends - 1] = ID
            tokens = ranks << 32 | pos << ID_BITS | ids
            start = {"w": np.arange(len(raw), dtype=np.int32), "tokens": pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), tokens)}
        else:
            start = {"w": np.repeat(np.arange(len(raw), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "id": ids}
        self._put("start", pa.table(start))
        found = self.con.sql(query).to_arrow_table().combine_chunks()
        ids = found.column("ids").combine_chunks()
        flat_ids = (ids.flatten().to_numpy(zero_copy_only=False) & ID).astype("<u4").tobytes()
        ends = (ids.offsets.to_numpy() - ids.offsets[0].as_py()) * 4
        out = [b""] * len(raw)
        for i, w in enumerate(found.column("w").to_numpy()):
            out[w] = flat_ids[ends[i] : ends[i + 1]]
        return out

    def _pieces(self, raw: list[bytes], query: str, most: int = BYTES_AT_ONCE) -> list[bytes]:
        """As :meth:`_contract`, in queries of bounded size."""
        out: list[bytes] = []
        for part in in_blocks(raw, lambda word: len(word) + most // WORDS_AT_ONCE, most):
            out += self._contract(raw[part], query)
        return out

    def _fits(self, pairs: set[tuple[int, int]]) -> None:
        """Learn which pairs of tokens stand as they are when their bytes are encoded."""
        new = sorted(pairs.difference(self.stable))
        if len(self.stable) + len(new) > KNOWN_PAIRS:
            self.stable.clear()
            new = sorted(pairs)
        encoded = self._pieces([self.tokens[a] + self.tokens[b] for a, b in new], ENCODE_LONG, LONG_AT_ONCE)
        for pair, ids in zip(new, encoded, strict=True):
            self.stable[pair] = ids == np.array(pair, dtype="<u4").tobytes()

    def _long_word(self, raw: bytes) -> bytes:
        """Ids of a word of any length, from pieces of bounded size.

        A sequence of tokens is the encoding of its bytes exactly if every two neighbours are
        the encoding of theirs. So pieces are encoded apart, and where two neighbours are
        not, the tokens around them are encoded anew as one piece, in widening windows,
        until all neighbours fit.
        """
        cuts = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in self._pieces(cuts, ENCODE_LONG, LONG_AT_ONCE)])
        reach = 16
        while True:
            places = np.flatnonzero(~self._stable_places(ids))
            if not len(places):
                return ids.astype("<u4").tobytes()
            # Windows of tokens around the places, joined where they meet.
            windows: list[list[int]] = []
            for place in places.tolist():
                low, high = max(0, place + 1 - reach), min(len(ids), place + 1 + reach)
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = high
                else:
                    windows.append([low, high])
            texts = [b"".join(self.tokens[i] for i in ids[low:high].tolist()) for low, high in windows]
            made = [np.frombuffer(x, "<u4") for x in self._pieces(texts, ENCODE_LONG, LONG_AT_ONCE)]
            parts, at = [], 0
            for (low, high), new in zip(windows, made, strict=True):
                parts += [ids[at:low], new]
                at = high
            ids = np.concatenate([*parts, ids[at:]])
            reach *= 2

    def _stable_places(self, ids: np.ndarray) -> np.ndarray:
        """For each two neighbours whether they fit."""
        codes = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:]
        kinds, where = np.unique(codes, return_inverse=True)
        pairs = [(int(code >> np.uint64(32)), int(code & np.uint64(0xFFFFFFFF))) for code in kinds]
        out = np.zeros(len(pairs), dtype=bool)
        for at in range(0, len(pairs), KNOWN_PAIRS):
            part = pairs[at : at + KNOWN_PAIRS]
            self._fits(set(part))
            out[at : at + len(part)] = [self.stable[pair] for pair in part]
        return out[where]

    def learn(self) -> None:
        """Encode the words of ``known`` that are new. Words of the turn before are taken from there."""
        words, older = self.known.fresh, self.older
        encoded = [b""] * len(words)
        groups: dict[str, tuple[list[int], list[bytes]]] = {ENCODE_SHORT: ([], []), ENCODE_LONG: ([], [])}
        for i, word in enumerate(words):
            number = older.get(word)
            if number is not None:
                encoded[i] = older.ids[older.ends[number] : older.ends[number + 1]].tobytes()
                continue
            raw = word.encode()
            if len(raw) > PIECE:
                encoded[i] = self._long_word(raw)
                continue
            places, bodies = groups[ENCODE_SHORT if len(raw) <= SHORT else ENCODE_LONG]
            places.append(i)
            bodies.append(raw)
        for query, (places, bodies) in groups.items():
            most = BYTES_AT_ONCE if query == ENCODE_SHORT else LONG_AT_ONCE
            for i, ids in zip(places, self._pieces(bodies, query, most), strict=True):
                encoded[i] = ids
        self.known.add(encoded)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KNOWN_WORDS // 2:
            self.known, self.older = Words(), self.known
        number = self.known.__getitem__
        split = [np.fromiter(map(number, self.find(text)), dtype=np.int64) for text in texts]
        self.learn()
        return [self.known.joined(numbers) for numbers in split]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        out: list[list[bytes]] = [[] for _ in encoded]
        waiting, owners, size = [], [], 0
        for i, ids in enumerate(encoded):
            tokens = np.frombuffer(ids, dtype="<u4")
            for at in range(0, len(tokens), SLICE):
                piece = tokens[at : at + SLICE]
                waiting.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= SLICES_AT_ONCE:
                    self._decode(waiting, owners, out)
                    waiting, owners, size = [], [], 0
        if waiting:
            self._decode(waiting, owners, out)
        return [b"".join(pieces) for pieces in out]

    def _decode(self, pieces: list[np.ndarray], owners: list[int], out: list[list[bytes]]) -> None:
        flat = np.concatenate(pieces).astype(np.int32)
        self._put("flat", pa.table({"pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        found = self.con.sql(DECODE).to_arrow_table().column("raw").combine_chunks()
        # The tokens lie one after the other in the bytes of the list.
        tokens = found.flatten().cast(pa.large_binary())
        _, places, raw = tokens.buffers()
        ends = np.frombuffer(places, dtype=np.int64)[tokens.offset : tokens.offset + len(flat) + 1]
        at = 0
        for piece, owner in zip(pieces, owners, strict=True):
            low, high = int(ends[at]), int(ends[at + len(piece)])
            out[owner].append(raw[low:high].to_pybytes() if high > low else b"")
            at += len(piece)


_engines: dict[bytes, Engine] = {}


def engine(tokenizer: Tokenizer) -> Engine:
    """The worker's engine for a tokenizer, made once."""
    key = hashlib.sha256(tokenizer.ranks + tokenizer.pattern.encode()).digest()
    if key not in _engines:
        _engines.clear()
        _engines[key] = Engine(tokenizer)
    return _engines[key]


def encode_texts(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of each document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = engine(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for part in in_blocks(texts, len, TEXT_AT_ONCE):
                ids = [np.frombuffer(x, dtype="<i4") for x in own.encode(texts[part])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key)[part.start : part.stop], pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"]
                )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: Tokenizer, key: str = "doc_id") -> DataFrame:
    """``key`` and ``raw`` (bytes of the text) of rows with ``ids``; null ids are none."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = engine(tokenizer)
        for batch in batches:
            ids = [np.array(x or [], dtype="<u4").tobytes() for x in batch.column("ids").to_pylist()]
            for part in in_blocks(ids, len, TEXT_AT_ONCE):
                raw = pa.array(own.decode(ids[part]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(key)[part.start : part.stop], raw], names=[key, "raw"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, raw binary")


def round_trip(
    docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode, decode the ids, and give counts and digests of both, and the ids if asked for.

    One pass of the workers: ids and decoded bytes are not sent back to the JVM.
    """
    kind = docs.schema[key].dataType.simpleString()
    hexed = lambda raw: hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = engine(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for part in in_blocks(texts, len, TEXT_AT_ONCE):
                ids = own.encode(texts[part])
                raw = own.decode(ids)
                columns = [
                    batch.column(key)[part.start : part.stop],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hexed(x) for x in ids]),
                    pa.array([hexed(x) for x in raw]),
                ]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
            give_back()

    more = ", ids array<int>" if with_ids else ""
    return docs.select(key, text).mapInArrow(
        lean(run), f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}"
    )
