"""Epoch orders by permutation: bijective, the same both ways, and without a shuffle."""

import pytest
from pyspark.sql import functions as F

from voxelherd.operators.epochs import epoch_slots, permute, permuted, slot_rows


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97])
def test_permutation_and_its_inverse(n):
    for key in ("a", "b", "7-0"):
        places = [permuted(i, n, key) for i in range(n)]
        assert sorted(places) == list(range(n))
        assert [permuted(p, n, key, back=True) for p in places] == list(range(n))
    assert n < 10 or [permuted(i, n, "a") for i in range(n)] != [permuted(i, n, "b") for i in range(n)]


def test_columns_give_the_same_permutation(spark):
    for tweak in (0, 3, 123_456_789):
        df = spark.range(50).select("id", permute(F.col("id"), F.lit(50), "k", F.lit(tweak)).alias("p"))
        df = df.withColumn("back", permute(F.col("p"), F.lit(50), "k", F.lit(tweak), back=True))
        assert [(r["p"], r["back"]) for r in df.orderBy("id").collect()] == [(permuted(i, 50, "k", tweak), i) for i in range(50)]


def test_places_look_drawn_at_random():
    """Neighbours part, and every place is about as likely for a row over many keys."""
    n, keys = 40, 400
    places = [[permuted(i, n, f"k{k}") for i in range(n)] for k in range(keys)]
    together = sum(abs(a - b) == 1 for row in places for a, b in zip(row, row[1:])) / (keys * (n - 1))
    assert 0.02 < together < 0.09
    for i in (0, 17, 39):
        seen = [row[i] for row in places]
        assert max(map(seen.count, range(n))) < 30 and len(set(seen)) == n


@pytest.mark.parametrize("total, size", [(1, 5), (20, 5), (23, 5), (23, 100), (101, 10)])
def test_slots_keep_blocks_together_and_are_found_again(spark, total, size):
    rows = spark.range(total).withColumnRenamed("id", "position")
    made = epoch_slots(rows, total, seed=1, epoch=2, block_size=size)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["slot"]: r["position"] for r in made.collect()}
    assert sorted(got) == list(range(total)) and sorted(got.values()) == list(range(total))
    order = [got[s] // size for s in range(total)]
    assert len([1 for a, b in zip(order, order[1:]) if a != b]) == -(-total // size) - 1
    back = slot_rows(spark, total, 1, 2, 0, total + 7, size)
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    assert {r["slot"]: r["position"] for r in back.collect()} == got
    # Resuming at a slot gives the rest of the same order.
    middle = total // 2
    rest = {r["slot"]: r["position"] for r in slot_rows(spark, total, 1, 2, middle, total, size).collect()}
    assert rest == {s: p for s, p in got.items() if s >= middle}


def test_epochs_differ_and_an_empty_table_has_none(spark):
    rows = spark.range(200).withColumnRenamed("id", "position")
    one, two = ([r["slot"] for r in epoch_slots(rows, 200, 1, e, 20).orderBy("position").collect()] for e in (0, 1))
    assert one != two
    assert epoch_slots(rows.limit(0), 0, 1, 0).count() == 0 and slot_rows(spark, 0, 1, 0, 0, 10).count() == 0
