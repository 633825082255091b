import hashlib
import random
import re

from voxelherd.llm import minhash
from voxelherd.llm.minhash import compare_edits, edited_text, likeness, near_duplicates, near_groups, signatures
from voxelherd.llm.q_minhash import op6_minhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    own = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got):
    """Neighbours, digests and estimates against a plain computation."""
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    errors = []
    for (key, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        row, edited = got[key], edited_text(text, following)
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(row.near_edited - jaccard(text, edited)), abs(row.near_next - jaccard(text, following))]
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.05


def test_whole_table(spark, folder, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE_ROWS", 17)
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = op6_minhash(spark, folder).collect()
    check([(r.doc_id, r.text) for r in docs], {r.doc_id: r for r in got})
    by_text = {}
    text = {r.doc_id: r.text for r in docs}
    for r in got:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


def test_edges(spark):
    rows = [(1, None), (2, ""), (5, "one two"), (7, "é🙂 " * 1001), (8, "a b c d e"), (9, "word " * 60_000), (12, "!!!")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, near_next double").repartition(3)
    check(rows, {r.doc_id: r for r in compare_edits(df).collect()})
    lone = compare_edits(df.where("doc_id = 8")).collect()
    assert (lone[0].near_next, lone[0].n_chars) == (1.0, 9)
    assert compare_edits(df.limit(0)).count() == 0


def test_long_texts(spark):
    a, b, c = (" ".join(f"{name}{i}" for i in range(100_000)) for name in "abc")
    made = signatures([a.encode(), b.encode(), (a + " " + c).encode()])
    assert likeness(made[:1], made[1:2])[0] < 0.02
    assert abs(likeness(made[:1], made[2:])[0] - jaccard(a, a + " " + c)) < 0.15


def test_ties_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE_ROWS", 3)
    rows = [(None, "x y z"), (None, "x y z")] + [(4, "same text")] * 9 + [(4, "other text")] * 2 + [(6, "u"), (1, "v")]
    got = compare_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in rows)


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base + f" tail{i}") for i in range(30)] + [(100, base + " tail1"), (200, "quite different words in this text here")]
    rows += [(300, None), (301, ""), (None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).collect()
    linked = {i: {i} for i in range(30)}
    for r in got:
        joined = linked[r.doc_id] | linked[r.leader]
        for i in joined:
            linked[i] = joined
    assert linked[0] == set(range(30))
    assert all(abs(r.similarity - jaccard(rows[r.doc_id][1], rows[0][1])) < 1e-9 for r in got)
    assert near_duplicates(df.limit(0)).count() == 0


def brute_groups(rows):
    """Smallest id of the group of each row, from all pairs."""
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a or "") == (b or "") or (shingles(a or "") and shingles(b or "") and jaccard(a, b) >= 0.8):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (key, _), g in zip(rows, group, strict=True):
        least[g] = min((k for k in (key, least.get(g)) if k is not None), default=None)
    return [least[g] for g in group]


def chain_rows():
    """Windows over one row of words: neighbours are alike (0.85, or 0.80 just so), others are not."""
    rows = []
    for family, step in enumerate([16, 22, 23] * 4):
        for i in (3, 0, 4, 1, 2):
            own = range(i * step, i * step + 202)
            rows.append((len(rows), " ".join(f"f{family}w{n}" for n in own)))
    return rows


def found_groups(df):
    groups = {r.node: r.group_id for r in near_groups(df).collect()}
    return {r.doc_id: groups.get(r.node, r.doc_id) for r in compare_edits(df).collect()}


def test_chains_and_borders(spark, monkeypatch):
    rows = chain_rows()
    assert jaccard(rows[6][1], rows[8][1]) == 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = dict(zip((k for k, _ in rows), brute_groups(rows), strict=True))
    assert len(set(want.values())) < len(rows)
    assert found_groups(df) == want
    monkeypatch.setattr(minhash, "PAIRS_AT_ONCE", 0.1)
    assert found_groups(df) == want


def test_groups_of_the_query(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute_groups(docs)
    got = {r.doc_id: r.near_group for r in op6_minhash(spark, folder).collect()}
    assert got == dict(zip((k for k, _ in docs), want, strict=True))
    assert len(set(want)) < len(docs)


def test_groups_come_in_key_order(spark, monkeypatch):
    """Groups reach their documents as keys and nodes; the result is not joined and shuffled again."""
    monkeypatch.setattr(minhash, "SLICE_ROWS", 3)
    rows = [(i, f"one text of many {i // 2}") for i in range(20)] + [(None, "one text of many 1"), (104, "another"), (104, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = minhash.with_groups(df)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    want = dict(zip(((k, t) for k, t in rows), brute_groups(rows), strict=True))
    got = sorted((str(r.doc_id), r.near_group, r.near_group_rows) for r in made.collect())
    sizes = {}
    for (key, text), group in zip(rows, brute_groups(rows), strict=True):
        sizes[group] = sizes.get(group, 0) + 1
    assert got == sorted((str(k), want[k, t], sizes[want[k, t]]) for k, t in rows)


def test_brief_likeness():
    import numpy as np

    minima = np.random.default_rng(1).integers(0, 1 << 16, (2, 128)).astype(np.uint16)
    mixed = np.where(np.arange(128) < 96, minima[0], minima[0] ^ 5)[None]
    assert minhash.brief_likeness(minhash.brief(minima[:1]), minhash.brief(mixed))[0] == 0.75
    assert minhash.brief_likeness(minhash.brief(minima[:1]), minhash.brief(minima[1:]))[0] < 0.2


def family_rows(texts=150, words=150):
    """Copies of one text with so many changed words that some are alike and most are not, all in the same bands."""
    rng = random.Random(5)
    rows = []
    for i in range(texts):
        own = [f"w{n}" for n in range(words)]
        for k in range(rng.randint(0, 9)):
            own[rng.randrange(words)] = f"x{i}y{k}" if rng.random() < 0.9 else f"x{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    return rows


def test_hot_bands(spark, monkeypatch):
    """Pairs that cannot be links are not made, and no link is lost."""
    rows = family_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compared = []
    verified = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda texts, sketches, pairs, t: compared.append(pairs.count()) or verified(texts, sketches, pairs, t))
    monkeypatch.setattr(minhash, "PAIRS_AT_ONCE", 1)
    assert found_groups(df) == dict(zip((k for k, _ in rows), brute_groups(rows), strict=True))
    after, compared[:] = sum(compared), []
    monkeypatch.setattr(minhash, "HOT_BAND", 1 << 30)
    assert minhash.near_links(df).count()
    assert 0 < 2 * after < sum(compared)


def test_shared_shingles(spark):
    rows = family_rows(40) + [(100, "a b c"), (101, "quite other words in here"), (102, "a b c  ")]
    df = spark.createDataFrame(rows, "node long, text string").selectExpr("node", "encode(text, 'UTF-8') AS raw").repartition(5)
    got = {r.node: (r.runs, sum(r.shared)) for r in minhash.shared_shingles(df).collect()}
    sets = {k: shingles(t) for k, t in rows}
    for k, own in sets.items():
        assert got[k] == (len(own), sum(any(s in other for j, other in sets.items() if j != k) for s in own))
