"""Burrows-Wheeler transform and common prefixes of many short documents, column by column.

Round j puts the suffixes of length j of all documents into the sorted collection: one
symbol per document, the one before its suffix of the round before. The collection is a
sequence of records in the order of the suffixes: first symbol, symbol before (the
transform), length of the prefix shared with the record above, length, document, and the
place of the suffix without its first symbol. A round reads the records of the round
before from one sequential file and writes the next file; only places of insertion are
searched, as suffixes with one first symbol lie in the order of their rests.

The files belong to one task, are kept in memory up to SPOOL bytes, have no name and are
gone with the task, like spill files; a lost task starts anew.
"""

from __future__ import annotations

import tempfile

import numpy as np

SPOOL = 64 << 20
LONGEST = 254
# Mark of a suffix that is a whole document.
WHOLE = 256

COLUMNS = {"first": np.int16, "before": np.int16, "shared": np.uint8, "length": np.uint8, "owner": np.int32, "rest": np.int32}


class Records:
    """Records of one round in a sequential file, one column after the other."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL)
        self.size = 0

    def write(self, columns: dict[str, np.ndarray]) -> Records:
        self.file.seek(0)
        for name, kind in COLUMNS.items():
            self.file.write(np.ascontiguousarray(columns[name], dtype=kind).data)
        self.size = len(columns["owner"])
        return self

    def read(self) -> dict[str, np.ndarray]:
        self.file.seek(0)
        return {n: np.frombuffer(self.file.read(self.size * np.dtype(k).itemsize), dtype=k) for n, k in COLUMNS.items()}


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of values[low..high], both included, for each pair with low <= high."""
    sizes = high - low + 1
    level = np.frexp(sizes)[1] - 1
    out = np.empty(len(low), dtype=values.dtype)
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def insert_columns(documents: list[bytes]) -> dict[str, np.ndarray]:
    """Records of all suffixes of all documents, in order; the empty suffixes come first."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    if sizes.max(initial=0) > LONGEST:
        raise ValueError(f"documents of more than {LONGEST} bytes")
    m = len(documents)
    flat = np.frombuffer(b"".join(documents), dtype=np.uint8)
    ends = np.cumsum(sizes)

    def symbol(own: np.ndarray, j: int) -> np.ndarray:
        """Symbol before the suffix of length j."""
        out = np.full(len(own), WHOLE, dtype=np.int64)
        longer = sizes[own] > j
        out[longer] = flat[ends[own[longer]] - j - 1]
        return out

    every = np.arange(m)
    files = Records().write({
        "first": np.full(m, -1), "before": symbol(every, 0), "shared": np.zeros(m), "length": np.zeros(m),
        "owner": every, "rest": np.full(m, -1),
    }), Records()
    place = every.copy()
    for j in range(1, int(sizes.max(initial=0)) + 1):
        old = files[0].read()
        n = len(old["owner"])
        own = np.flatnonzero(sizes >= j)
        at = place[own]
        wanted = old["before"][at].astype(np.int64) * (n + 1) + at
        order = np.argsort(wanted)
        own, at, wanted = own[order], at[order], wanted[order]
        keys = old["first"][m:].astype(np.int64) * (n + 1) + old["rest"][m:]
        insert = m + np.searchsorted(keys, wanted)
        new_at = insert + np.arange(len(own))
        old_at = np.arange(n) + np.cumsum(np.bincount(insert, minlength=n + 1))[:n]
        fresh = {
            "first": old["before"][at], "before": symbol(own, j), "shared": np.zeros(len(own)),
            "length": np.full(len(own), j), "owner": own, "rest": at,
        }
        now = {}
        for name, kind in COLUMNS.items():
            column = np.empty(n + len(own), dtype=kind)
            column[old_at] = old[name]
            column[new_at] = fresh[name]
            now[name] = column
        # Shared prefixes change at the new records and right below them.
        near = np.unique(np.concatenate([new_at, new_at + 1]))
        near = near[near < n + len(own)]
        same = near[now["first"][near] == now["first"][near - 1]]
        now["shared"][near] = 0
        low, high = now["rest"][same - 1].astype(np.int64) + 1, now["rest"][same].astype(np.int64)
        now["shared"][same] = least_between(old["shared"], low, high) + 1
        now["rest"][m:] = old_at[now["rest"][m:]]
        place[own] = new_at
        files = files[1].write(now), files[0]
    return files[0].read()
