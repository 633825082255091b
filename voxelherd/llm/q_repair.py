"""Query of the conversation repair operator."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from voxelherd.llm.common import table
from voxelherd.llm.q_sharding import _CRC_TABLE
from voxelherd.llm.repair import number_rows, plan_repairs, repaired_rows
from voxelherd.session import materialize


def damage(rows: DataFrame) -> DataFrame:
    """Drop, empty, cut, repeat or rerole rows by a checksum of conversation and turn.

    Null values are one space, in the checksum too; a null turn stays null for the order.
    """
    parts = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat_ws(":", *parts), "UTF-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    marked = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def digests(repaired: DataFrame) -> DataFrame:
    """Per conversation the hash of its ``role:text`` lines, read in order and never gathered."""
    key = repaired.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state = None, None
        for batch in batches:
            owners, made = [], []
            for own, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if state is None or own != owner:
                    if state is not None:
                        owners.append(owner)
                        made.append(state.hexdigest())
                    owner, state = own, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_pydict({"owner": pa.array(owners, kind), "digest": pa.array(made, pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict(
                {"owner": pa.array([owner], kind), "digest": pa.array([state.hexdigest()], pa.string())}
            )

    kind = to_arrow_type(key)
    lines = repaired.where("edit <> 'D'").select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")
    return ordered.mapInArrow(run, StructType().add("owner", key).add("digest", "string"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations, then repair them at the least cost."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    numbered = number_rows(damage(rows))
    plans = materialize(plan_repairs(numbered))
    found = digests(repaired_rows(numbered, plans))
    every = rows.select(F.col("conv_id").alias("original")).distinct()
    joined = every.join(plans, F.col("original").eqNullSafe(F.col("conv_id")), "left").join(
        found, F.col("original").eqNullSafe(F.col("owner")), "left"
    )
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        F.col("original").alias("conv_id"),
        *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# A value of the recursion is the cost in six digits and the audit; this one is no value.
_NONE = "'~'"


def _add(value: str, cost: str, edit: str) -> str:
    return f"CASE WHEN {value} = '~' THEN '~' ELSE lpad(((substr({value}, 1, 6))::INT + {cost})::VARCHAR, 6, '0') || substr({value}, 7) || '{edit}' END"


def _inserted(v: str) -> str:
    """Values per state after any useful insertions: a user after start or system or assistant, an assistant after a user."""
    user = f"least({v}[3], {_add(f'least({v}[1], {v}[2], {v}[4])', '5', 'I')})"
    assistant = f"least({v}[4], {_add(f'least({v}[3], {_add(f'least({v}[1], {v}[2])', '5', 'I')})', '5', 'I')})"
    return f"[{v}[1], {v}[2], {user}, {assistant}]"


def _stepped(v: str, row: str) -> str:
    """Values per state after one row, given as [initial, extra cost of a row that stays, or 'x']."""
    stay = f"({row}[2] = 'x')"
    cost = f"(CASE WHEN {stay} THEN '0' ELSE {row}[2] END)::INT"
    deleted = [_add(f"{v}[{i}]", "2", "D") for i in range(1, 5)]
    opened = f"least({v}[1], {v}[2], {v}[4])"
    kept = {
        2: f"CASE WHEN {row}[1] = 's' THEN {_add(f'{v}[1]', cost, 'K')} ELSE '~' END",
        3: f"CASE WHEN {row}[1] = 'u' THEN {_add(opened, cost, 'K')} ELSE '~' END",
        4: f"CASE WHEN {row}[1] = 'a' THEN {_add(f'{v}[3]', cost, 'K')} ELSE '~' END",
    }
    turned = {3: _add(opened, f"1 + {cost}", "R"), 4: _add(f"{v}[3]", f"1 + {cost}", "R")}
    out = [deleted[0]]
    for i in (2, 3, 4):
        ways = [kept[i], *([turned[i]] if i in turned else [])]
        ways = [f"CASE WHEN {stay} THEN '~' ELSE {way} END" for way in ways]
        out.append(f"least({deleted[i - 1]}, {', '.join(ways)})")
    return f"[{', '.join(out)}]"


OP11_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS digits
  FROM conversations
), summed AS (
  SELECT *, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(length(digits) // 2), lambda j:
             (instr('0123456789ABCDEF', digits[2 * j + 1]) * 16 + instr('0123456789ABCDEF', digits[2 * j + 2]) - 17)::BIGINT)),
           lambda c, b: xor(c >> 8, {_CRC_TABLE}[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM summed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         trim(text, {_SPACE}) AS body
  FROM damaged
), known AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen FROM placed
), faulted AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN body = '' THEN 'b' WHEN seen THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM known
), chats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, list(initial ORDER BY place) AS initials,
         list([initial, CASE fault WHEN '' THEN '0' WHEN 't' THEN '5' ELSE 'x' END] ORDER BY place) AS rows
  FROM faulted GROUP BY conv_id
), walked AS (
  SELECT * EXCLUDE (rows, initials),
         len(list_filter(range(1, len(initials)), lambda i: initials[i] || initials[i + 1] NOT IN ('su', 'ua', 'au'))) AS illegal,
         list_reduce(list_prepend(['000000', '~', '~', '~'], rows), lambda v, row: {_stepped(f"({_inserted('v')})", "row")}) AS ends
  FROM chats
), solved AS (
  SELECT * EXCLUDE (ends), least(ends[1], {_inserted("ends")}[4]) AS best FROM walked
), edits AS (
  SELECT conv_id, i, best[6 + i] AS edit FROM (SELECT conv_id, best, unnest(range(1, length(best) - 5)) AS i FROM solved)
), counted AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS place, count(*) FILTER (edit <> 'D') OVER w AS j
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), joined AS (
  SELECT c.conv_id, c.i, c.j, c.edit, f.role, CASE WHEN c.edit = 'I' THEN '' ELSE f.text END AS text,
         bool_or(c.edit = 'K' AND c.j = 1 AND f.initial = 's') OVER (PARTITION BY c.conv_id) AS led
  FROM counted c LEFT JOIN faulted f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.place = f.place
  WHERE c.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user'
                             ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS body
  FROM joined GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(best, 1, 6)::BIGINT, 0) AS cost,
       coalesce(substr(best, 7), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN solved s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN repaired r ON e.conv_id IS NOT DISTINCT FROM r.conv_id"""
