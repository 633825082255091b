import glob
import hashlib
import itertools
import os
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from tests.compare import differences
from voxelherd.llm import repair
from voxelherd.llm.q_repair import OP11_SQL, damage, digests, op11_conversation_repair
from voxelherd.llm.repair import number_rows, plan_repairs, repair_letters, repaired_rows, search, suffix_bounds

ALL = repair.FINE + repair.CUT + repair.GONE


def best_by_states(letters):
    """Best (cost, audit) by going through all states row by row, insertions closed in three turns."""
    def filled(best):
        best = dict(best)
        for _, (state, (cost, audit)) in itertools.product(range(3), list(best.items())):
            for state, (cost, audit) in list(best.items()):
                made = (cost + 5, audit + "I")
                after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                best[after] = min(best.get(after, made), made)
        return best

    best = {0: (0, "")}
    for letter in letters:
        after = {}
        for state, (cost, audit) in filled(best).items():
            for more, edit, to in repair._branches(letter, state):
                made = (cost + more, audit + edit)
                after[to] = min(after.get(to, made), made)
        best = after
    best = filled(best)
    return min(best[s] for s in (0, 3) if s in best)


def best_by_trying(letters, most):
    """All edit sequences up to a cost, by the definition."""
    found = []

    def go(at, roles, cost, audit):
        if cost > most:
            return
        if at == len(letters) and (roles == "" or roles.removeprefix("s") == "ua" * (len(roles.removeprefix("s")) // 2) != ""):
            found.append((cost, audit))
        for role in "ua":
            go(at, roles + role, cost + 5, audit + "I")
        if at < len(letters):
            letter = letters[at]
            go(at + 1, roles, cost + 2, audit + "D")
            if letter not in repair.GONE:
                more = 5 * (letter in repair.CUT)
                go(at + 1, roles + letter.lower(), cost + more, audit + "K")
                for role in "ua":
                    go(at + 1, roles + role, cost + 1 + more, audit + "R")

    go(0, "", 0, "")
    return min(found)


def test_small_conversations_against_all_edits():
    for letters in ["", *("".join(x) for n in (1, 2, 3) for x in itertools.product("suxU1", repeat=n))]:
        assert repair_letters(letters) == best_by_trying(letters, 2 * len(letters)), letters


def test_random_conversations_against_states():
    random.seed(7)
    for k in range(3000):
        n = random.choice([12, 63, 64, 65, 130, 200]) if k % 20 == 0 else random.randint(0, 10)
        letters = "".join(random.choice(random.choice([ALL, "ua", "uaUA1", "u", "suxSUA3"])) for _ in range(n))
        assert repair_letters(letters) == best_by_states(letters), letters


def test_bounds_never_exceed_the_cost():
    random.seed(3)
    for _ in range(500):
        letters = "".join(random.choice(ALL) for _ in range(random.randint(0, 9)))
        for state in range(4):
            reached = search(letters, {state: (0, "")}, False)
            assert suffix_bounds(letters, state != 0)[0] <= min(cost for cost, _ in reached.values())


def test_edits_give_a_well_formed_conversation():
    random.seed(5)
    for _ in range(500):
        letters = "".join(random.choice(ALL) for _ in range(random.randint(0, 12)))
        cost, audit = repair_letters(letters)
        roles = "".join(
            role[0] if role else letters[row].lower() for row, edit, role in repair.edit_rows(letters, audit) if edit != "D"
        )
        rest = roles.removeprefix("s")
        assert roles == "" or rest and rest == "ua" * (len(rest) // 2)
        assert sum(edit != "I" for edit in audit) == len(letters)


def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/conversations.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    assert differences(op11_conversation_repair(spark, folder), con, OP11_SQL) is None


def kind_of(conv, turn):
    return zlib.crc32(f"{conv}:{turn}".encode()) % 20


def test_damage(spark):
    wanted = {k: next(t for t in range(10_000) if kind_of(9, t) == k) for k in (0, 1, 2, 3, 4, 7)}
    rows = [(9, t, "assistant", "A. b! c?", "x") for t in wanted.values()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string")
    got = {}
    for r in damage(df).collect():
        got.setdefault(r.turn, []).append((r.role, r.text))
    full = ("assistant", "A. b! c?")
    assert got == {
        wanted[1]: [("assistant", "")], wanted[2]: [("assistant", "A b c")], wanted[3]: [full, full],
        wanted[4]: [("user", "A. b! c?")], wanted[7]: [full],
    }
    nulls = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert kind_of(" ", " ") > 4 and [tuple(r) for r in damage(nulls).collect()] == [(None, None, " ", " ")]


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int, letters string, owner int")
    numbered = number_rows(df)
    plans = plan_repairs(numbered)
    out = {r.conv_id: r for r in plans.collect()}
    edits = repaired_rows(numbered, plans)
    texts = {}
    for r in edits.where("edit <> 'D'").orderBy("conv_id", "place").collect():
        texts.setdefault(r.conv_id, []).append((r.role, r.text))
    hashes = {r.owner: r.digest for r in digests(edits).collect()}
    for conv, lines in texts.items():
        assert hashes[conv] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return out, texts


def test_nulls_ties_repeats_and_long_conversations(spark):
    more = (0, "", 0)
    rows = [
        (None, 5, "user", "Hi."), (None, 5, "user", "Hi."), (None, None, "assistant", "Yes."),
        (1, 0, None, None), (1, 1, "", "x."), (1, 2, "user", " \t\n"), (1, 2**63 - 1, "tool", "é."), (1, -(2**63), "tool", "é.."),
        *[(2, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(9000)], (2, 8999, "assistant", "y" * 3_000_000),
        *[(3, t, "user", "same.") for t in range(300)],
    ]
    out, texts = run(spark, [(*r, *more) for r in rows])
    null = out[None]
    assert (null.letters, null.gaps, null.duplicate) == ("au2", 0, 1)
    assert (out[1].letters, out[1].blank, out[1].gaps, out[1].audit) == ("x4x2x", 2, 0, "DDRDR")
    assert texts[1] == [("user", "x."), ("assistant", "é.")]
    assert out[2].truncated == 1 and out[2].cost == 2 and len(texts[2]) == 9000 and out[2].letters.count("A") == 1
    assert (out[3].duplicate, out[3].cost, out[3].audit) == (299, 600, "D" * 300)
    empty, _ = run(spark, [])
    assert empty == {}


def test_a_dropped_conversation_is_returned(spark, tmp_path):
    turn = next(t for t in range(1000) if kind_of(4, t) == 0)
    df = spark.createDataFrame([(4, turn, "user", "a."), (4, turn, "user", "a.")], "conv_id long, turn long, role string, text string")
    df.withColumn("audit", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in op11_conversation_repair(spark, str(tmp_path)).collect()]
    assert got == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
