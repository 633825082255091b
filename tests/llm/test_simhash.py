import random
import re

import numpy as np
import xxhash

from voxelherd.llm import simhash
from voxelherd.llm.components import components, forest
from voxelherd.llm.q_simhash import op7_simhash
from voxelherd.llm.simhash import Flips, bucket_links, fingerprint, near_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, keys):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    own = sorted(set(prints))
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for p, k in zip(prints, keys):
        if k is not None:
            least[find(p)] = min(least.get(find(p), k), k)
    return [least.get(find(p)) for p in prints]


def test_fingerprint_by_rule(monkeypatch):
    texts = ["", " \t", "one", "A b C", "Ünï b c d e É f g", "x y " * 300]
    assert [fingerprint(t.encode()) for t in texts] == [brute_print(t) for t in texts]
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert [fingerprint(t.encode()) for t in texts] == [brute_print(t) for t in texts]


def test_links_find_every_pair():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for p in base:
        for _ in range(6):
            for bit in rng.sample(range(64), rng.randint(1, 7)):
                p ^= 1 << bit
            prints.add(p)
    x = np.array(sorted(prints), dtype=np.uint64)
    for bits in (0, 3, 6):
        flips, links = Flips(bits), []
        sent = flips.buckets(x)
        for bucket in np.unique(sent):
            own = x[(sent == bucket).any(axis=1)]
            links += list(zip(*bucket_links(own, int(bucket), flips)))
        a, b = (np.array(side, dtype=np.uint64) for side in zip(*links))
        child, root = forest(a, b)
        found = dict(zip(child.tolist(), root.tolist()))
        keys = sorted(prints)
        assert [found.get(p, p) for p in keys] == brute_groups(keys, keys)


def test_few_buckets_for_a_fingerprint():
    """What is sent, and made again in a bucket, grows with the logarithm of the buckets, not with their number."""
    for bits in range(17):
        flips = Flips(bits)
        assert len(flips.offsets) == 1 + bits + bits * (bits - 1) // 2
        x = np.random.RandomState(bits).randint(0, 1 << 62, 500).astype(np.uint64)
        hashes = flips.hash(x)
        assert (hashes < 1 << bits).all() and len(np.unique(hashes)) > min(300, (1 << bits) * 8 // 10)
        assert (flips.hash(x ^ x[::-1]) == hashes ^ hashes[::-1]).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randint(5000, 5400), rng.randint(5000, 5400)) for _ in range(300)]
    links += [(7, 7), (1, 0), (-5, -9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    child, root = forest(*(np.array(s) for s in zip(*links)))
    assert got == dict(zip(child.tolist(), root.tolist()))
    assert got[60] == 0 and got[-5] == -9 and components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_and_edges(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(4)]
    rows = [(None, "lonely null key"), (3, None), (2, ""), (9, " \n"), (50, "hot copy of a text"), (51, "short")] + [(i, "hot copy of a text") for i in range(60, 90)]
    for i in range(100, 160):
        words = list(base[i % 4])
        words[rng.randrange(300)] = "edit"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, simhash int").repartition(4)
    got = near_groups(df).collect()
    prints = [brute_print(t) for _, t in rows]
    want = sorted(map(str, zip([k for k, _ in rows], np.array(prints, dtype=np.uint64).view(np.int64).tolist(), brute_groups(prints, [k for k, _ in rows]))))
    assert sorted(map(str, [tuple(r) for r in got])) == want
    assert near_groups(df.limit(0)).count() == 0


def test_whole_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    groups = brute_groups(prints, [r.doc_id for r in rows])
    want = {r.doc_id: (f"{p:016x}", g) for r, p, g in zip(rows, prints, groups)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash(spark, folder).collect()} == want
