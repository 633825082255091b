"""Conversation structure repair by depth-first branch and bound.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Edits make
it so: keep a row (0), give it the role that is due (1), delete it (2), insert an empty row
of the role that is due (5); a truncated row that is not deleted costs 5 more, blank and
duplicate rows have to be deleted. Of all cheapest sequences of edits, the one whose
initials (K, R, D, I) come first in ASCII order is taken. These initials, the *audit*, say
everything: the due role follows from what stands before.

Spark numbers the rows of each conversation in ranges, so that no task holds a whole one,
finds repeated rows by digest, and reduces a row to one letter (initial and fault). The
letters of a conversation are as long as its audit and meet in one cell; texts never do.
The search reads these letters. It goes depth first with an explicit stack. A node is the
number of rows read and the last initial put out; a table per node keeps the best (cost,
audit) that reached it and eliminates worse ones; a bound on the cost of the remaining rows
prunes against the best complete sequence so far, until the stack is empty and the
optimum proved. Long conversations are searched in windows of ``WINDOW`` rows: each window
starts from the best prefix per node and proves the best one for each node at its end. That
loses nothing: of two prefixes of equal cost at one node, neither is the beginning of the
other (it would be cheaper by the insertions that follow), so the order of the prefixes is
the order of the whole audits.

Defined results: rows are ordered by (turn, role, text), null turns first; a null conversation
id is a conversation of its own; a null role or text is one space; roles count by their
first character alone; gaps beyond 64 bits are 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxelherd.operators.ordering import ordered_prefix
from voxelherd.session import materialize

# Costs of the edits, and what a truncated row adds that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# White space of ASCII, and the ends of a complete text.
SPACES = "\\x20\\x09-\\x0D"
ENDS = "[.!?]"

# Rows that one search sees at once, and rows whose letters are put together first.
WINDOW = 64
CHUNK = 4096

# States: nothing put out yet, then the last initial that was.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
DUE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
# A row as one letter: its initial (x: any other), in the case or the place of its fault.
FINE, CUT, GONE = "suax", "SUAX", "1234"


def _cheapest(letter: str, started: bool) -> int:
    """What a row costs at least, whatever stands around it."""
    if letter in GONE or letter in CUT:
        return DELETE
    return REROLE if letter == "x" or letter == "s" and started else KEEP


def suffix_bounds(letters: str, started: bool) -> list[int]:
    """Lower bound of the cost of the rows from each place on.

    Rows cost their cheapest edit. Two kept rows of one role with only deleted rows between
    them are no sequence, so each such pair costs one more; pairs share no row.
    """
    n = len(letters)
    bounds = [0] * (n + 1)
    # The next row that need not be deleted, and the cost of the deletions before it.
    follower, between = n, 0
    for i in range(n - 1, -1, -1):
        own = _cheapest(letters[i], started)
        bounds[i] = own + bounds[i + 1]
        if letters[i] in GONE:
            between += own
            continue
        if follower < n and letters[i] in "ua" and letters[follower] == letters[i]:
            bounds[i] = max(bounds[i], own + between + REROLE + bounds[follower + 1])
        follower, between = i, 0
    return bounds


def _branches(letter: str, state: int) -> list[tuple[int, str, int]]:
    """Edits of one row: (cost, initial, state after it)."""
    out = [(DELETE, "D", state)]
    if letter in GONE:
        return out
    more = TRUNCATED if letter in CUT else 0
    after = AFTER.get((state, letter.lower()))
    if after is not None:
        out.append((KEEP + more, "K", after))
    return [*out, (REROLE + more, "R", DUE[state])]


def search(letters: str, entries: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """Best (cost, audit) at each state after the rows, from the best at each state before.

    With ``last`` only complete conversations count, and only the best is returned.
    """
    n = len(letters)
    bounds = (suffix_bounds(letters, False), suffix_bounds(letters, True))
    tables: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    found: dict[int, tuple[int, str]] = {}
    # Complete conversations share one incumbent, other windows have one per state at the end.
    slot = [START] * 4 if last else list(range(4))
    wanted = {START, ASSISTANT} if last else set(range(4))
    systems = SYSTEM in entries or START in entries and not set("sS").isdisjoint(letters)
    inner = {USER, ASSISTANT}
    ends = {SYSTEM: {SYSTEM} | inner, USER: inner, ASSISTANT: inner, START: {START} | inner | ({SYSTEM} if systems else set())}
    ends = {state: {slot[end] for end in reach} for state, reach in ends.items()}

    def beaten(at: int, state: int, cost: int, audit: str) -> bool:
        bound = cost + bounds[state != START][at]
        for end in ends[state]:
            best = found.get(end)
            if best is None or bound < best[0] or bound == best[0] and audit <= best[1][: len(audit)]:
                return False
        return True

    stack = []
    for state, best in sorted(entries.items(), key=lambda e: e[1], reverse=True):
        tables[0][state] = best
        stack.append((0, state, *best))
    while stack:
        at, state, cost, audit = stack.pop()
        if tables[at][state] != (cost, audit) or beaten(at, state, cost, audit):
            continue
        if at == n and state in wanted:
            if slot[state] not in found or (cost, audit) < found[slot[state]]:
                found[slot[state]] = (cost, audit)
        children = [(INSERT, "I", DUE[state], at)]
        if at < n:
            children += [(c, e, s, at + 1) for c, e, s in _branches(letters[at], state)]
        # The child of the lowest bound is looked at first, so it is pushed last.
        children.sort(key=lambda x: (x[0] + bounds[x[2] != START][x[3]], x[1]), reverse=True)
        for more, edit, after, place in children:
            reached = (cost + more, audit + edit)
            table = tables[place]
            if after in table and table[after] <= reached or beaten(place, after, *reached):
                continue
            table[after] = reached
            stack.append((place, after, *reached))
    return found


@lru_cache(maxsize=4096)
def repair_letters(letters: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation given as letters."""
    entries, done = {START: (0, "")}, []
    for at in range(0, max(len(letters), 1), WINDOW):
        entries = search(letters[at : at + WINDOW], entries, at + WINDOW >= len(letters))
        # What all prefixes agree on is settled.
        same = len(commonprefix([audit for _, audit in entries.values()]))
        done.append(next(iter(entries.values()))[1][:same])
        entries = {state: (cost, audit[same:]) for state, (cost, audit) in entries.items()}
    (cost, audit), = entries.values()
    return cost, "".join(done) + audit


def illegal_pairs(letters: str) -> int:
    """Neighbouring rows whose initials are not su, ua or au."""
    plain = [(FINE + CUT + GONE).index(letter) % 4 for letter in letters]
    return sum((a, b) not in {(0, 1), (1, 2), (2, 1)} for a, b in zip(plain, plain[1:]))


def edit_rows(letters: str, audit: str) -> Iterator[tuple[int | None, str, str | None]]:
    """(row read or None, edit, role given or None) of each edit of an audit."""
    at, state = 0, START
    for edit in audit:
        if edit in "RI":
            state = DUE[state]
            role = NAMES[state]
        else:
            role = None
            if edit == "K":
                state = AFTER[state, letters[at].lower()]
        yield (None if edit == "I" else at), edit, role
        at += edit != "I"


def _letter() -> Column:
    initial = F.position(F.substring("role", 1, 1), F.lit("sua"))
    known = (F.length("role") > 0) & (initial > 0)
    place = F.when(known, initial).otherwise(F.lit(4))
    row = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE))
    row = row.when(F.col("fault") == "truncated", F.lit(CUT)).otherwise(F.lit(FINE))
    return F.substring(row, place, F.lit(1))


def number_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``position`` in their conversation and ``fault``: blank, duplicate, truncated or null.

    The first fault of a row counts. The result is written once.
    """
    clean = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    placed = ordered_prefix(clean, ["turn", "role", "text"], ["conv_id"])
    owner = F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("n"))
    key = F.concat_ws(":", owner, F.length("role").cast("string"), F.col("role"), F.col("text"))
    marked = materialize(placed.withColumn("digest", F.sha2(key, 256)))
    repeated = (
        marked.groupBy("digest").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select("digest", "first")
    )
    fault = F.when(~F.col("text").rlike(f"[^{SPACES}]"), "blank")
    fault = fault.when(F.col("position") > F.col("first"), "duplicate")
    fault = fault.when(~F.col("text").rlike(f"{ENDS}[{SPACES}]*\\z"), "truncated")
    found = marked.join(repeated, "digest", "left").withColumn("fault", fault)
    return materialize(found.select("conv_id", "position", "turn", "role", "text", "fault"))


def plan_repairs(numbered: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults by kind, illegal neighbours, cost, audit and letters.

    ``numbered`` comes from :func:`number_rows`.
    """
    chunk = F.floor(F.col("position") / CHUNK)
    faults = {kind: F.count(F.when(F.col("fault") == kind, 1)) for kind in ("blank", "duplicate", "truncated")}
    pieces = numbered.select("conv_id", "position", "fault", _letter().alias("letter")).groupBy(
        "conv_id", chunk.alias("chunk")
    ).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("position", "letter")))["letter"], "").alias("piece"),
        *[count.alias(kind) for kind, count in faults.items()],
    )
    whole = pieces.groupBy("conv_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "piece")))["piece"], "").alias("letters"),
        *[F.sum(kind).alias(kind) for kind in faults],
    )
    turns = numbered.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("turn").alias("n")
    )
    wide = "CAST({} AS DECIMAL(38, 0))"
    gaps = F.expr(f"coalesce(try_cast({wide.format('high')} - {wide.format('low')} + 1 - n AS BIGINT), 0)")
    spread = turns.select(F.col("conv_id").alias("owner"), gaps.alias("gaps"))
    joined = whole.join(spread, F.col("conv_id").eqNullSafe(F.col("owner"))).select(
        "conv_id", "gaps", *faults, "letters"
    )
    names = ["conv_id", "gaps", *faults, "letters"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("letters").to_pylist()
            best = [repair_letters(x) for x in letters]
            made = [
                pa.array([illegal_pairs(x) for x in letters], pa.int64()),
                pa.array([cost for cost, _ in best], pa.int64()),
                pa.array([audit for _, audit in best], pa.string()),
            ]
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, "illegal", "cost", "audit"])

    schema = StructType([*joined.schema.fields]).add("illegal", "long").add("cost", "long").add("audit", "string")
    return joined.mapInArrow(run, schema)


def repaired_rows(numbered: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per edit: conv_id, ``place`` in the audit, ``edit``, role and text (null if deleted)."""
    key = plans.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column("conv_id")
            for i, (letters, audit) in enumerate(
                zip(batch.column("letters").to_pylist(), batch.column("audit").to_pylist())
            ):
                made = list(edit_rows(letters, audit))
                yield pa.RecordBatch.from_pydict({
                    "owner": owners.take(pa.array([i] * len(made), pa.int32())),
                    "place": pa.array(range(len(made)), pa.int64()),
                    "row": pa.array([x[0] for x in made], pa.int64()),
                    "edit": pa.array([x[1] for x in made], pa.string()),
                    "given": pa.array([x[2] for x in made], pa.string()),
                })

    schema = StructType().add("owner", key).add("place", "long").add("row", "long").add("edit", "string").add("given", "string")
    edits = plans.select("conv_id", "letters", "audit").mapInArrow(run, schema)
    same = F.col("conv_id").eqNullSafe(F.col("owner")) & (F.col("position") == F.col("row"))
    joined = edits.join(numbered.select("conv_id", "position", "role", "text"), same, "left")
    left = F.col("edit") != "D"
    return joined.select(
        F.col("owner").alias("conv_id"), "place", "edit",
        F.when(left, F.coalesce("given", "role")).alias("role"),
        F.when(left, F.coalesce("text", F.lit(""))).alias("text"),
    )
