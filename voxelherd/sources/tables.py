"""Table sources: participants, sidecars, exclude list, index CSV, metadata, logs."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelherd.functions.columns import CORE_FIELDS, coerce_value, null_if_na, squeeze
from voxelherd.operators.ordering import dedup_first
from voxelherd.operators.quality import assert_unique
from voxelherd.session import materialize

# Entity columns of the index that are not used further.
INDEX_EXTRAS = ("acq", "rec", "ce", "rez", "echo", "part", "task")


def _unquote(text: Column) -> Column:
    inner = F.regexp_replace(F.regexp_extract(text, r'^"(.*)"$', 1), '""', '"')
    return F.when(text.rlike(r'^".*"$'), inner).otherwise(text)


def _dataset_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def any_file(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern matches anything, for files that are optional."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _parse_participants(text: str) -> tuple[list[dict], str | None]:
    """Rows of one file as dicts, or the reason why it is rejected.

    Quoted cells may hold tabs and line breaks. Of two equal header names the first
    counts; blank lines are skipped; a file without ``participant_id`` gives no rows.
    """
    lines = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), delimiter="\t")
    cells = [line for line in lines if any(cell.strip() for cell in line)]
    if not cells or "participant_id" not in cells[0]:
        return [], None
    names = cells[0]
    if any(len(line) > len(names) for line in cells):
        return [], "line longer than header"
    full = [line + [None] * (len(names) - len(line)) for line in cells[1:]]
    return [dict(reversed(list(zip(names, line, strict=True)))) for line in full], None


def read_participants(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all ``<dataset>/participants.tsv`` as maps, and the rejected files.

    A file is read as a whole by one task, as quoted cells may span lines; a dataset has
    one row per subject and session there. A file with a line longer than its header is
    rejected, a file without ``participant_id`` gives no rows. Output: dataset, line
    (grows in file order), row.
    """
    files = spark.read.text(f"{root.rstrip('/')}/*/participants.tsv", wholetext=True)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for file, text in zip(batch["file"], batch["value"], strict=True):
                rows, reason = _parse_participants(text)
                found = [(file, n, row, None) for n, row in enumerate(rows)]
                yield pd.DataFrame(found or [(file, 0, None, reason)], columns=["file", "line", "row", "reason"])

    parsed = materialize(
        files.select("value", F.col("_metadata.file_path").alias("file")).mapInPandas(
            parse, "file string, line bigint, row map<string,string>, reason string"
        )
    )
    rejects = parsed.where("reason IS NOT NULL").select(
        F.col("file").alias("path"), F.lit("participants").alias("stage"), "reason"
    )
    rows = parsed.where("row IS NOT NULL").select(_dataset_of(F.col("file")).alias("dataset"), "line", "row")
    return rows, rejects


def age_units(sidecars: DataFrame) -> DataFrame:
    """Unit per dataset and lower-cased field from sidecar JSON texts ``(dataset, json)``.

    A field whose description mentions months is in months. Malformed files give none;
    of fields that differ only in case the last one counts.
    """
    fields = sidecars.select(
        "dataset", F.posexplode(F.map_entries(F.from_json("json", "map<string,string>"))).alias("_i", "_e")
    ).select("dataset", F.lower("_e.key").alias("header"), "_e.value", "_i")
    last = dedup_first(fields, ["dataset", "header"], [F.col("_i").desc()])
    unit = F.when(F.lower("value").contains("month"), "months").otherwise("years")
    return last.select("dataset", "header", unit.alias("unit"))


def read_sidecar_units(spark: SparkSession, root: str) -> DataFrame:
    pattern = f"{root.rstrip('/')}/*/participants.json"
    if not any_file(spark, pattern):
        return spark.createDataFrame([], "dataset string, header string, unit string")
    texts = spark.read.text(pattern, wholetext=True)
    return age_units(
        texts.select(_dataset_of(F.col("_metadata.file_path")).alias("dataset"), F.col("value").alias("json"))
    )


def read_exclude(spark: SparkSession, path: str) -> DataFrame:
    """Dataset ids of a YAML list with the comment next to them as the reason."""
    line = F.col("value")
    return (
        spark.read.text(path)
        .select(
            _unquote(F.regexp_replace(F.regexp_extract(line, r"^\s*-\s*([^#\s]+)", 1), "'", "")).alias("dataset"),
            F.regexp_extract(line, r"#\s*(.*?)\s*$", 1).alias("reason"),
        )
        .where("dataset <> ''")
        .withColumn("reason", F.nullif("reason", F.lit("")))
    )


def parse_list_column(text: Column, element: str) -> Column:
    """Bracketed list text to an array; text that does not parse is null."""
    return F.from_json(text, f"array<{element}>")


def load_image_index(spark: SparkSession, path: str) -> DataFrame:
    """Index CSV with text ids, parsed lists, and the unused entity columns dropped.

    Columns follow the header of the file: an index has whatever entities its paths had.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    return raw.drop(*INDEX_EXTRAS).withColumns({
        "size": F.col("size").cast("bigint"),
        "shape": parse_list_column(F.col("shape"), "int"),
        "pixdim": parse_list_column(F.col("pixdim"), "double"),
        "md5": null_if_na(F.col("md5")),
    })


def load_event_metadata(spark: SparkSession, path: str, key: str = "id_event") -> DataFrame:
    """Event metadata with text ids; blank ids are skipped, repeated ones are an error.

    The raw row is kept as a map next to the core fields.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    names = raw.columns
    trimmed = raw.select(
        squeeze(F.col(f"`{key}`")).alias(key),
        F.create_map(*[part for n in names for part in (F.lit(n), F.col(f"`{n}`"))]).alias("raw"),
        *[squeeze(F.col(f"`{n}`")).alias(n) for n in CORE_FIELDS if n in names],
    )
    return assert_unique(trimmed.where(F.col(key) != ""), [key], "event metadata")


def typed_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Struct of typed values in place of each text column."""
    return df.withColumns({c: coerce_value(F.col(c)) for c in columns})


def list_pairs(files: DataFrame, path: str = "path", limit: int | None = None) -> DataFrame:
    """Matched files in text order, optionally the first ``limit``; none is an error."""
    if files.isEmpty():
        raise FileNotFoundError("no processed images matched")
    ordered = files.orderBy(path)
    return ordered if limit is None else ordered.limit(limit)


VOLUME_NAME = r"(sub-[^_]+)_ses-(wave[123])_(.+?)_space-[^_]+_desc-preproc_T1w_desc-[^_]+_volumes\.tsv$"


def read_region_volumes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Region volumes and quality scores of all scans, long form.

    Every value file and its sibling score file carry the scan in their name; files
    with another name are ignored.
    """
    base = root.rstrip("/")

    def table(kind: str, schema: str) -> DataFrame:
        files = f"{base}/sub-*/ses-*/anat/*_{kind}.tsv"
        if kind == "qc" and not any_file(spark, files):
            return spark.createDataFrame([], f"pat_id string, participant_id string, wave string, scan string, {schema}")
        rows = spark.read.csv(files, sep="\t", header=True, schema=schema, enforceSchema=False)
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        pattern = VOLUME_NAME.replace("_volumes", f"_{kind}")
        part = [F.regexp_extract(name, pattern, i) for i in (1, 2, 3)]
        return rows.where(name.rlike(pattern)).select(
            F.concat(part[0], F.lit("_ses-"), part[1], F.lit("_"), part[2], F.lit("_T1w")).alias("pat_id"),
            part[0].alias("participant_id"), part[1].alias("wave"), part[2].alias("scan"), *rows.columns,
        )

    return table("volumes", "region string, volume_mm3 double"), table("qc", "region string, qc_score double")


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log, one object per epoch; the run is the folder of the file."""
    return spark.read.json(path).withColumn("run", _dataset_of(F.col("_metadata.file_path")))
