"""Global order on distributed rows: positions, running sums, exact quantiles, ranks.

A window without partition keys, or partitioned by a key that may hold a third of all
rows, runs in one task. Everything here works on range slices instead: rows are range
partitioned by (group, order), each slice is summarized, and the few groups that
continue from one slice into the next get an offset. At most one group continues into
any slice and one out of it, so the table of such groups never has more than two rows
per slice; that bound is what makes broadcasting it safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelherd.session import materialize


def ordered_prefix(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    slices: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add ``position`` (from 0, within ``group``) and exclusive running sums.

    With ``totals`` the sums over the whole group follow as ``<name>_total``.

    ``order`` must identify rows within a group, otherwise ties are numbered
    arbitrarily. ``sums`` maps new column names to summed expressions. Pass only the
    columns that are needed: the frame is written once to the checkpoint folder.
    ``slices`` fixes the number of ranges; by default it follows the size of the data.
    """
    group = list(group)
    sums = dict(sums or {})
    summed = {f"_in_{name}": expr for name, expr in sums.items()}
    wide = df.withColumns(summed) if summed else df
    # Without a number, neighbouring ranges are merged until they are worth a task.
    ranged = wide.repartitionByRange(*([slices] if slices else []), *group, *order)
    rows = materialize(ranged.withColumn("_slice", F.spark_partition_id()))
    slices = slices or (rows.agg(F.max("_slice")).first()[0] or 0) + 1

    parts = rows.groupBy(*group, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_in_{name}").alias(f"_sum_{name}") for name in sums],
    )
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    spanning = parts.select(
        *[F.col(name).alias(f"_key_{name}") for name in group],
        F.col("_slice").alias("_key_slice"),
        F.count(F.lit(1)).over(whole).alias("_slices"),
        F.sum("_rows").over(before).alias("_off_rows"),
        *[F.sum(f"_sum_{name}").over(before).alias(f"_off_{name}") for name in sums],
        *[F.sum(f"_sum_{name}").over(whole).alias(f"_all_{name}") for name in sums],
    ).where("_slices > 1")

    same = reduce(
        lambda a, b: a & b,
        [F.col(name).eqNullSafe(F.col(f"_key_{name}")) for name in group],
        F.col("_slice") == F.col("_key_slice"),
    )
    local = Window.partitionBy("_slice", *group).orderBy(*order)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    # One task per slice: slices are even, a hash of their numbers would not be.
    joined = rows.join(F.broadcast(spanning), same, "left").repartitionById(slices, "_slice")
    group_total = Window.partitionBy("_slice", *group)
    return joined.select(
        *df.columns,
        (F.row_number().over(local) - 1 + F.coalesce("_off_rows", F.lit(0)))
        .cast("bigint")
        .alias("position"),
        *[
            (
                F.coalesce(F.sum(f"_in_{name}").over(earlier), F.lit(0))
                + F.coalesce(f"_off_{name}", F.lit(0))
            ).alias(name)
            for name in sums
        ],
        *[
            F.coalesce(f"_all_{name}", F.sum(f"_in_{name}").over(group_total)).alias(f"{name}_total")
            for name in (sums if totals else ())
        ],
    )


def batch_slice(df: DataFrame, order: Sequence[str | Column], batch_id: int, size: int) -> DataFrame:
    """Rows ``[batch_id * size, batch_id * size + size)`` of the ordered frame."""
    start = batch_id * size
    placed = ordered_prefix(df, order)
    return placed.where((F.col("position") >= start) & (F.col("position") < start + size))


def first_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows with ``index`` from 1; fails when there are fewer.

    ``orderBy.limit`` keeps only ``n`` candidates per task, so the final window sees
    exactly ``n`` rows.
    """
    top = df.orderBy(*order).limit(n)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = top.withColumn("index", F.row_number().over(Window.orderBy(*order)))
    found = F.count(F.lit(1)).over(every)
    checked = F.when(found == n, F.col("index")).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {n} rows, found "), found.cast("string"))).cast("int")
    )
    return numbered.withColumn("index", checked)


def dedup_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    null_equal: bool = True,
) -> DataFrame:
    """Keep the first row per key in the given order.

    Spark pushes the ``row_number <= 1`` limit below the shuffle, so a task ships at
    most one row per key however hot that key is. With ``null_equal=False`` rows whose
    keys contain a null are all kept: each is a group of its own, told apart by the
    ``order`` columns, which then have to be plain columns that identify a row.
    """
    parts = [F.col(k) for k in keys]
    if not null_equal:
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        parts.append(F.when(~known, F.struct(*order)))
    rank = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _value_runs(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Distinct values with their count, the number of smaller values, and the total."""
    by = list(by)
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(*by, F.col(column).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    runs = ordered_prefix(counts, ["_value"], by, {"_below": F.col("_count")}, totals=True)
    return runs.withColumnRenamed("_below_total", "_total")


def exact_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per probability.

    Equal values are counted before anything is ordered, and no group is gathered in
    one task: the wanted ranks are looked up in the distributed running count.
    """
    by = list(by)
    names = list(names or [f"p{round(p * 100):02d}" for p in probabilities])
    runs = _value_runs(df, column, by)
    covers = []
    for i, p in enumerate(probabilities):
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            inside = (rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_count"))
            covers.append((f"_{side}{i}", inside))
    wanted = runs.where(reduce(lambda a, b: a | b, [c for _, c in covers]))
    picked = wanted.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[F.max(F.when(inside, F.col("_value"))).cast("double").alias(name) for name, inside in covers],
    )
    out = []
    for i, (p, name) in enumerate(zip(probabilities, names)):
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        step = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        out.append((F.col(f"_lo{i}") + step * (spot - F.floor(spot))).alias(name))
    return picked.select(*by, *out)


def sorted_curve(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """``points`` evenly spaced ranks of the sorted column, smallest and largest included.

    Point ``i`` is the value at rank ``i * (n - 1) div (points - 1)``.
    """
    runs = _value_runs(df, column, ())
    last, span = F.col("_total") - 1, points - 1
    upper = F.least(F.col("_below") + F.col("_count"), F.col("_total"))
    # i * last div span >= rank  <=>  i >= ceil(rank * span / last)
    first_point = F.expr(f"(_below * {span} + _total - 2) div greatest(_total - 1, 1)")
    end_point = F.when(upper > last, F.lit(points)).otherwise(
        F.expr(f"((_below + _count) * {span} + _total - 2) div greatest(_total - 1, 1)")
    )
    first_point = F.when(F.col("_below") == 0, F.lit(0)).otherwise(first_point)
    return (
        runs.select("_value", first_point.alias("_from"), end_point.alias("_to"))
        .where("_from < _to")
        .select(
            F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("point"),
            F.col("_value").alias(column),
        )
    )
