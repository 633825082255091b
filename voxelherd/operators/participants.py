"""Participant harmonization: header lookup, units, per-subject checks, wave tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelherd.functions.columns import (
    age_in_years, normalize_age, normalize_category, null_if_na, strip_prefix,
)
from voxelherd.operators.ordering import dedup_first
from voxelherd.session import materialize

# Datasets whose age column has its own name.
AGE_COLUMNS = {
    "ds000144": "ScanAge",
    "ds001486": "age_ses-T1",
    "ds001894": "age_ses-T1_T1w",
    "ds002424": "age_ses-T1",
    "ds002886": "age_ses-T1",
    "ds003425": "Age_Sess1",
    "ds003710": "age_ses-1",
    "ds005027": "ScanAge",
}

# Datasets whose age unit is known.
AGE_UNITS = {"ds006169": "months"}

# Wave name and the column that holds the age at that wave.
WAVE_AGE_COLUMNS = {"wave1": "AgeMRI_W1", "wave2": "AgeMRI_W2", "wave3": "AgeMRI_W3"}

# Fixed value: the longitudinal dataset that gets its own loader.
WAVE_DATASET = "ds004856"

# Columns of the harmonized table, in order.
PARTICIPANT_COLUMNS = ("dataset", "sub", "ses", "sex", "age")

Loader = Callable[[DataFrame], DataFrame]


def literal_lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of ``key`` in a small fixed table, else null."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def find_header(row: Column, names: Sequence[str]) -> Column:
    """Header of the row that equals one of ``names`` ignoring case; earlier names win.

    Lookup is by presence of the column, not of a value. When two headers differ only
    in case, the later one is taken.
    """
    keys = F.map_keys(row)

    def match(name: str) -> Column:
        return F.try_element_at(F.filter(keys, lambda k: F.lower(k) == name), F.lit(-1))

    return F.coalesce(*[match(name) for name in names])


def resolve_columns(df: DataFrame, age_columns: Mapping[str, str] = AGE_COLUMNS, row: str = "row") -> DataFrame:
    """Name the session, sex and age header of every row of a mixed table."""
    cells = F.col(row)
    return df.withColumns({
        "ses_header": find_header(cells, ("session", "session_id")),
        "sex_header": find_header(cells, ("sex", "gender")),
        "age_header": F.coalesce(
            literal_lookup(F.col("dataset"), age_columns), find_header(cells, ("age",))
        ),
    })


def cell(row: Column, header: Column) -> Column:
    """Cell under ``header`` with missing-value spellings as null."""
    return null_if_na(F.try_element_at(row, header))


def left_out(rows: DataFrame, age_columns: Mapping[str, str] = AGE_COLUMNS) -> DataFrame:
    """Datasets that :func:`harmonize` leaves out, as rejects with the reason."""
    found = resolve_columns(rows.where("map_contains_key(row, 'participant_id')"), age_columns)
    missing = found.where("age_header IS NOT NULL AND NOT map_contains_key(row, age_header)")
    reason = F.concat(F.lit("no age column "), F.min("age_header"))
    return missing.groupBy("dataset").agg(reason.alias("reason")).select(
        F.col("dataset").alias("path"), F.lit("participants").alias("stage"), "reason"
    )


def harmonize(
    rows: DataFrame,
    units: DataFrame | None = None,
    age_columns: Mapping[str, str] = AGE_COLUMNS,
    age_units: Mapping[str, str] = AGE_UNITS,
) -> DataFrame:
    """Mixed participant rows ``(dataset, line, row MAP)`` to one typed table.

    ``units`` holds ``(dataset, header, unit)`` from sidecar files, at most one row per
    dataset and header. Output: dataset, sub, ses, sex, age and the line, first row per
    subject and session in file order. A dataset that lacks the age column named for it
    is left out; :func:`left_out` reports it.
    """
    found = resolve_columns(rows.where("map_contains_key(row, 'participant_id')"), age_columns).where(
        "age_header IS NULL OR map_contains_key(row, age_header)"
    )
    # In steps: each looked-up cell is used several times below and must be read once.
    cells = found.select(
        "dataset",
        "line",
        F.try_element_at("row", F.lit("participant_id")).alias("sub"),
        *[F.try_element_at("row", F.col(f"{name}_header")).alias(name) for name in ("ses", "sex", "age")],
        F.lower("age_header").alias("header"),
    )
    known_cells = cells.withColumns({name: null_if_na(F.col(name)) for name in ("sub", "ses", "sex", "age")})
    typed = known_cells.where("sub IS NOT NULL").withColumns({
        "sub": strip_prefix(F.col("sub"), "sub-"),
        "ses": strip_prefix(F.col("ses"), "ses-"),
        "sex": normalize_category(F.col("sex")),
        "age": normalize_age(F.col("age")),
    })
    known = literal_lookup(F.col("dataset"), age_units)
    if units is not None:
        lookup = materialize(units.select("dataset", "header", "unit"))
        typed = typed.join(lookup, on=["dataset", "header"], how="left")
        known = F.coalesce(known, F.col("unit"))
    aged = typed.withColumn("age", age_in_years(F.col("age"), F.coalesce(known, F.lit("years"))))
    first = dedup_first(aged, ["dataset", "sub", "ses"], ["line"])
    return first.select(*PARTICIPANT_COLUMNS, "line")


def unpivot_waves(
    df: DataFrame, ids: Sequence[str], waves: Mapping[str, str] = WAVE_AGE_COLUMNS, value: str = "age"
) -> DataFrame:
    """Wide wave columns to one row per subject and wave; rows without a value drop."""
    wide = df.select(*ids, *[F.col(column).alias(wave) for wave, column in waves.items()])
    return wide.unpivot(list(ids), list(waves), "ses", value).where(F.col(value).isNotNull())


def load_waves(rows: DataFrame) -> DataFrame:
    """Loader of the longitudinal study: one row per subject and wave, age in years."""
    row = F.col("row")
    wide = rows.select(
        "dataset",
        strip_prefix(cell(row, F.lit("participant_id")), "sub-").alias("sub"),
        normalize_category(cell(row, F.lit("Sex"))).alias("sex"),
        *[normalize_age(cell(row, F.lit(c))).alias(c) for c in WAVE_AGE_COLUMNS.values()],
    )
    return unpivot_waves(wide, ["dataset", "sub", "sex"]).select("dataset", "sub", "ses", "sex", "age")


LOADERS: dict[str, Loader] = {WAVE_DATASET: load_waves}


def load_participants(
    rows: DataFrame,
    exclude: Sequence[str] = (),
    units: DataFrame | None = None,
    loaders: Mapping[str, Loader] = LOADERS,
) -> DataFrame:
    """All datasets in one table: one plan for the common case, one per special loader.

    ``line`` keeps the file order within a dataset; special loaders may leave it out.
    """
    named = F.col("dataset")
    kept = rows.where(named.isNull() | ~named.isin(*exclude)) if exclude else rows
    special = list(loaders)
    common = kept.where(named.isNull() | ~named.isin(*special)) if special else kept
    out = harmonize(common, units)
    for dataset, loader in loaders.items():
        out = out.unionByName(loader(kept.where(F.col("dataset") == dataset)), allowMissingColumns=True)
    return out


def group_range(df: DataFrame, value: str = "age", keys: Sequence[str] = ("sub", "ses")) -> DataFrame:
    """Largest minus smallest value per group; a null key is a group of its own."""
    return df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("range"))


def age_check(df: DataFrame, by: str = "dataset", large: float = 85.0) -> DataFrame:
    """Per dataset: largest within-subject age range, and whether ages look too large."""
    sessions = df.groupBy(by, "sub", "ses").agg(
        (F.max("age") - F.min("age")).alias("range"), F.max("age").alias("age_max")
    )
    return sessions.groupBy(by).agg(
        F.max("range").alias("max_range"),
        F.max("age_max").alias("age_max"),
        F.coalesce(F.max("age_max") > large, F.lit(False)).alias("large_age"),
    )
