import zlib

import numpy as np

from voxelherd.llm.sharding import place_of, row_of, shard_rows


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 17, 1000, 4097):
        place = place_of(np.arange(n), n, seed=9)
        assert sorted(place) == list(range(n))
        assert (row_of(place, n, seed=9) == np.arange(n)).all()
    assert (place_of(np.arange(1000), 1000, 1) != place_of(np.arange(1000), 1000, 2)).any()


def test_edge_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "é" * 9, 1)] + [(7, "hot", 1)] * 500 + [(i, "x" * i, 1) for i in range(8, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = shard_rows(df, shards=8).collect()
    assert len(got) == len(rows)
    sizes = np.bincount([r["shard"] for r in got], minlength=8)
    assert sizes.max() - sizes.min() <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for r in got:
        if r.doc_id == 2:
            assert (r["size"], r.text_crc32) == (19, zlib.crc32(("é" * 9).encode()))
    # The place depends on the rows alone, not on how they are spread.
    again = shard_rows(df.repartition(2), shards=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    assert shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
