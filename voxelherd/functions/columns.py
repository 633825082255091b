"""Scalar column expressions: identifiers, typed values, names, geometry, hashing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of sex that are recognized, after trimming and lower-casing.
SEX_CODES = {"m": "M", "male": "M", "man": "M", "f": "F", "female": "F", "woman": "F"}

# Cell texts that count as missing when a table is read as strings.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fixed value: core fields carried next to every packaged scan.
CORE_FIELDS = (
    "age_open", "sex", "race", "ethnicity", "site", "scanner", "study", "days_from_V1",
    "yearquarter_event",
)

DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMBER_PATTERN = rf"^[+-]?(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?$"

# Patterns of whole numbers, packaged scan names and wave names.
INTEGER_PATTERN = r"^[+-]?[0-9]+(\.0+)?$"
SCAN_KEY_PATTERN = r"^(sub-[^_]+)_(ses-[^_]+)_([^_]+)$"
WAVE_NAME_PATTERN = r"^(sub-[^_]+)_ses-(wave[123])_(.*)$"


def squeeze(column: Column) -> Column:
    """Strip surrounding white space of any kind."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def null_if_na(column: Column) -> Column:
    """Missing-value spellings become null."""
    return F.when(~column.isin(*NA_STRINGS), column)


def strip_prefix(column: Column, prefix: str) -> Column:
    """Remove one leading ``prefix``; null stays null."""
    return F.when(column.startswith(prefix), F.substr(column, F.lit(len(prefix) + 1))).otherwise(column)


def normalize_category(column: Column, codes: Mapping[str, str] = SEX_CODES) -> Column:
    """Trimmed, lower-cased text looked up in ``codes``; anything else is null."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.try_element_at(table, F.lower(squeeze(column)))


def parse_number(column: Column) -> Column:
    """Text to double; anything but a plain finite decimal literal is null.

    The pattern guard matters: a bare cast accepts ``5d`` and hexadecimal floats.
    """
    text = squeeze(column)
    value = F.when(
        text.rlike(NUMBER_PATTERN), F.regexp_replace(text, "_", "").try_cast("double")
    )
    return F.when(F.abs(value) != float("inf"), value)


def normalize_age(column: Column) -> Column:
    return F.round(parse_number(column), 2)


def age_in_years(age: Column, unit: Column) -> Column:
    """Age in years from a number and its unit; not re-rounded, zero or less is null."""
    years = F.when(unit == "months", age / 12.0).otherwise(age)
    return F.when(years > 0, years)


def label_in_months(age: Column, units: str = "months") -> Column:
    if units not in ("months", "years"):
        raise ValueError(f"unknown age units {units!r}")
    return age * 12.0 if units == "months" else age


def coerce_value(column: Column) -> Column:
    """Split free text into ``as_int``, ``as_double``, ``as_string``: at most one is set.

    Blank and non-finite cells set none of the three.
    """
    text = squeeze(column)
    number = F.regexp_replace(text, "_", "").try_cast("double")
    is_number = text.rlike(NUMBER_PATTERN)
    finite = F.abs(number) != float("inf")
    whole = F.regexp_replace(text, r"\.0+$", "").try_cast("bigint")
    is_int = text.rlike(INTEGER_PATTERN) & whole.isNotNull()
    non_finite = F.lower(text).rlike(r"^[+-]?(inf|infinity|nan)$")
    return F.struct(
        F.when(is_int, whole).alias("as_int"),
        F.when(is_number & ~is_int & finite, number).alias("as_double"),
        F.when((text != "") & ~is_number & ~non_finite, text).alias("as_string"),
    )


def coerce_variant(column: Column) -> Column:
    """Free text as one VARIANT column: a whole number, a number, or a text; else null.

    The rules are those of :func:`coerce_value`; :func:`variant_parts` reads it back.
    """
    v = coerce_value(column)
    quoted = F.regexp_replace(F.to_json(F.array(v["as_string"])), r"^\[|\]$", "")
    # Always with a point, so that it is read as a number with a fraction.
    number = v["as_double"].cast("string")
    text = F.coalesce(v["as_int"].cast("string"), number, F.when(v["as_string"].isNotNull(), quoted))
    return F.parse_json(text)


def variant_parts(column: Column) -> Column:
    """``as_int``, ``as_double``, ``as_string`` of a VARIANT: at most one is set."""
    kind = F.schema_of_variant(column)
    return F.struct(
        F.when(kind == "BIGINT", F.try_variant_get(column, "$", "bigint")).alias("as_int"),
        F.when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.try_variant_get(column, "$", "double")).alias("as_double"),
        F.when(kind == "STRING", F.try_variant_get(column, "$", "string")).alias("as_string"),
    )


def null_safe_text(column: Column) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(column.cast("string"), F.lit(""))


def null_safe_list(column: Column) -> Column:
    """A list becomes its JSON text (``", "`` between items), null the empty string."""
    items = F.transform(column, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))
    text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return F.when(column.isNull(), "").otherwise(text)


def null_safe(column: Column, kind: T.DataType) -> Column:
    """Metadata without nulls: structs and maps value by value, lists as JSON text."""
    if isinstance(kind, T.StructType):
        return F.struct(*[null_safe(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, value: null_safe(value, kind.valueType))
    return null_safe_list(column) if isinstance(kind, T.ArrayType) else null_safe_text(column)


def scan_key(name: Column, suffix: str) -> Column:
    """File name without a fixed suffix; a name that lacks it is an error."""
    return F.when(name.endswith(suffix), F.substr(name, F.lit(1), F.length(name) - len(suffix))).otherwise(
        F.raise_error(F.concat(F.lit("unexpected file name: "), name)).cast("string")
    )


def scan_key_fields(key: Column) -> Column:
    """Subject, session and modality of a packaged scan, with the joined event id.

    A key that does not match gives a null struct.
    """
    part = [F.regexp_extract(key, SCAN_KEY_PATTERN, i) for i in (1, 2, 3)]
    subject_id = strip_prefix(part[0], "sub-")
    visit = strip_prefix(part[1], "ses-")
    fields = F.struct(
        part[0].alias("subject"),
        part[1].alias("session"),
        part[2].alias("modality"),
        subject_id.alias("subject_id"),
        visit.alias("visit"),
        F.concat_ws("_", subject_id, visit).alias("id_event"),
    )
    return F.when(key.rlike(SCAN_KEY_PATTERN), fields)


def wave_fields(name: Column) -> Column:
    """Participant, wave and the remaining scan name; null struct when it does not match."""
    part = [F.regexp_extract(name, WAVE_NAME_PATTERN, i) for i in (1, 2, 3)]
    fields = F.struct(
        part[0].alias("participant_id"), part[1].alias("wave"), part[2].alias("scan")
    )
    return F.when(name.rlike(WAVE_NAME_PATTERN), fields)


def bids_fields(path: Column) -> Column:
    """Dataset, entities and suffix of a path, or the reason it is rejected.

    Among repeated entity keys the last one wins.
    """
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = F.substring_index(name, ".", 1)
    tokens = F.split(stem, "_")
    items = F.filter(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: t.contains("-"))

    def is_last(item: Column, index: Column) -> Column:
        later = F.slice(items, index + 2, F.size(items) - index)
        return ~F.exists(
            later, lambda other: F.substring_index(other, "-", 1) == F.substring_index(item, "-", 1)
        )

    reason = (
        F.when(F.size(parts) < 2, "no parent folder")
        .when(F.get(parts, F.size(parts) - 2) != "anat", "not an anat folder")
        .when(~name.contains("."), "no extension")
        .when(F.size(tokens) < 2, "no suffix")
        .when(F.exists(items, lambda t: F.size(F.split(t, "-")) != 2), "malformed entity")
    )
    entities = F.map_from_entries(
        F.transform(
            F.filter(items, is_last),
            lambda t: F.struct(F.substring_index(t, "-", 1), F.substring_index(t, "-", -1)),
        )
    )
    return F.struct(
        F.get(parts, F.lit(0)).alias("dataset"),
        F.when(reason.isNull(), entities).alias("entities"),
        F.element_at(tokens, -1).alias("suffix"),
        reason.alias("reason"),
    )


def path_order(path: Column) -> Column:
    """Sort key that orders paths by component, not by character."""
    return F.split(path, "/")


def geometry(shape: Column, pixdim: Column) -> dict[str, Column]:
    """Scalar geometry columns of an image, so that filters on them reach the scan."""
    fov = F.zip_with(F.slice(shape, 1, 3), F.slice(pixdim, 1, 3), lambda n, mm: n * mm)
    axes = ("x", "y", "z")
    return {
        "ndim": F.size(shape),
        "res": F.array_max(pixdim),
        "res_min": F.array_min(pixdim),
        **{f"res_{axis}": F.get(pixdim, F.lit(i)) for i, axis in enumerate(axes)},
        **{f"fov_{axis}": F.get(fov, F.lit(i)) for i, axis in enumerate(axes)},
        "fov_min": F.array_min(fov),
        "fov_max": F.array_max(fov),
        "vol": F.aggregate(fov, F.lit(1.0), lambda acc, mm: acc * mm),
    }


def hash_int(*parts: Column | str | int) -> Column:
    """Reproducible 32-bit integer from the joined text of ``parts``."""
    texts = [(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts]
    digest = F.md5(F.concat_ws("-", *texts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts: Column | str | int) -> Column:
    """Reproducible number in [0, 1)."""
    return hash_int(*parts) / F.lit(4294967296.0)


def hash_between(low: float, high: float, *parts: Column | str | int) -> Column:
    """Reproducible number in [low, high); equal ends give the constant."""
    if high < low:
        raise ValueError(f"invalid range {(low, high)}")
    if high == low:
        return F.lit(float(low))
    return F.lit(float(low)) + hash_uniform(*parts) * F.lit(float(high - low))


def hash_order(*parts: Column | str | int) -> Column:
    """Text that orders rows in a reproducible shuffle."""
    return F.md5(F.concat_ws("-", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts]))
