"""Data guards: unique keys, non-empty input, finite metrics, failure tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CohortDataError(ValueError):
    """Input breaks a rule the operator relies on."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


# Distinct values that may become columns.
MOST_COLUMNS = 10_000


def pivot_names(df: DataFrame, column: str, expected: Sequence[str] | None = None) -> list[str]:
    """Distinct values of a column that is to be pivoted, in order, or as expected.

    A pivot over a list drops all other values, so a value that is null or not expected
    is an error, and so are more values than a table may have columns.
    """
    rows = df.select(F.col(column).cast("string").alias("name")).distinct().limit(MOST_COLUMNS + 1).collect()
    found = {row["name"] for row in rows}
    if len(found) > MOST_COLUMNS:
        raise CohortDataError(f"{column} has more than {MOST_COLUMNS} values")
    if None in found:
        raise CohortDataError(f"{column} is null in some rows")
    if expected is None:
        return sorted(found)
    extra = sorted(found - set(expected))
    if extra:
        raise CohortDataError(f"{len(extra)} unexpected values of {column}: {', '.join(extra[:10])}")
    return list(expected)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """Fail when a key repeats; reads only the key columns."""
    examples = duplicate_keys(df.select(*keys), keys).limit(10).collect()
    if examples:
        shown = "; ".join(", ".join(str(row[k]) for k in keys) for row in examples)
        raise CohortDataError(f"duplicate key {tuple(keys)} in {what}: {shown}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail when the frame is empty."""
    if df.isEmpty():
        raise CohortDataError(f"no rows: {what}")
    return df


def many_to_one(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    what: str = "lookup table",
) -> DataFrame:
    """Join rows to a lookup whose key must be unique.

    The key check is its own small job on purpose: an aggregation below the join would
    hide the shuffle from the skew handling, and a hot left key could no longer be
    split. Whether the lookup is broadcast is left to its measured size.
    """
    assert_unique(right, on, what)
    return left.join(right, on=list(on), how=how)


def require_finite(column: Column, what: str) -> Column:
    """The value, or an error when it is NaN or infinite; nulls pass."""
    value = column.cast("double")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value).when(value.isNull(), None).otherwise(
        F.raise_error(F.concat(F.lit(f"{what} is "), value.cast("string"))).cast("double")
    )


def finite_or_null(column: Column) -> Column:
    """NaN and infinities become null, so Spark aggregates skip them."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def failure_report(rejects: DataFrame, stage: str = "stage", reason: str = "reason") -> DataFrame:
    """Failures counted per stage and reason."""
    return rejects.groupBy(stage, reason).agg(F.count(F.lit(1)).alias("n_failed"))


def fail_on_rejects(rejects: DataFrame, show: int = 10) -> None:
    """Raise with up to ``show`` examples when anything was rejected."""
    examples = rejects.limit(show).collect()
    if examples:
        raise CohortDataError(f"{rejects.count()} rejected rows:\n" + "\n".join(f"  {row}" for row in examples))
