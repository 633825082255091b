"""The provided tables seen as imaging tables, in Spark and in SQL.

All derived values use integer arithmetic on the keys, so both sides agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.plans.registry import Tables

SHAPE = (4, 4, 4)
PATCH = (2, 2, 2)

IMAGES_SQL = """
images AS (
  SELECT doc_id AS path, source AS dataset, CAST(doc_id - doc_id % 3 AS VARCHAR) AS sub,
         CASE lang WHEN 'en' THEN 'T1w' WHEN 'fr' THEN 'T2w' WHEN 'de' THEN 'FLAIR' ELSE 'bold' END AS suffix,
         md5(text) AS md5, n_chars * 10000 AS size,
         CASE WHEN doc_id % 37 = 0 THEN 4 ELSE 3 END AS ndim,
         160 + doc_id % 100 AS nx, 150 + (doc_id * 7) % 80 AS ny, 150 + n_chars % 70 AS nz,
         CAST(7 + doc_id % 6 AS DOUBLE) / CAST(10 AS DOUBLE) AS px,
         CAST(8 + doc_id % 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS py,
         CAST(CASE WHEN n_chars % 41 = 0 THEN 32 ELSE 8 + n_chars % 5 END AS DOUBLE) / CAST(10 AS DOUBLE) AS pz
  FROM documents
), geo AS (
  SELECT *, px AS res_x, py AS res_y, pz AS res_z, nx * px AS fov_x, ny * py AS fov_y, nz * pz AS fov_z,
         CASE WHEN ndim = 4 THEN greatest(px, py, pz, 2.0::DOUBLE) ELSE greatest(px, py, pz) END AS res,
         CASE WHEN ndim = 4 THEN least(px, py, pz, 2.0::DOUBLE) ELSE least(px, py, pz) END AS res_min
  FROM images
), ruled AS (
  SELECT *, (ndim = 3) AS r_ndim, size / 1e6::DOUBLE >= 1 AS r_size_low, size / 1e6::DOUBLE <= 60 AS r_size_high,
         res_min >= 0.3::DOUBLE AS r_res_min, res_x <= 1.5::DOUBLE AS r_res_x, res_y <= 1.5::DOUBLE AS r_res_y,
         res_z <= 3.0::DOUBLE AS r_res_z, least(fov_x, fov_y, fov_z) >= 120 AS r_fov_min,
         greatest(fov_x, fov_y, fov_z) <= 260 AS r_fov_max
  FROM geo
), kept AS (
  SELECT * FROM ruled WHERE r_ndim AND r_size_low AND r_size_high AND r_res_min AND r_res_x AND r_res_y
         AND r_res_z AND r_fov_min AND r_fov_max AND dataset NOT IN ('src3', 'src11')
         AND suffix IN ('T1w', 'T2w', 'FLAIR')
), uniq AS (
  SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY path) = 1
), parts AS (
  SELECT CAST(doc_id AS VARCHAR) AS sub,
         CASE WHEN doc_id % 11 = 0 THEN NULL WHEN quality = 1 THEN 'F' ELSE 'M' END AS sex,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(18 + doc_id % 60 AS DOUBLE) + toxic * 0.5::DOUBLE END AS age
  FROM labels
), joined AS (
  SELECT u.*, p.sex, p.age, p.sub IS NOT NULL AS matched FROM uniq u LEFT JOIN parts p ON u.sub = p.sub
)"""

EXCLUDED = ["src3", "src11"]


def images(t: Tables) -> DataFrame:
    """``documents`` as an image index with shape and voxel size."""
    doc = F.col("doc_id")
    chars = F.col("n_chars")
    four = doc % 37 == 0

    def tenth(value):
        return value.cast("double") / F.lit(10.0)

    shape = [160 + doc % 100, 150 + (doc * 7) % 80, 150 + chars % 70]
    pixdim = [tenth(7 + doc % 6), tenth(8 + doc % 5), tenth(F.when(chars % 41 == 0, 32).otherwise(8 + chars % 5))]
    return t.documents.select(
        doc.alias("path"),
        F.col("source").alias("dataset"),
        (doc - doc % 3).cast("string").alias("sub"),
        F.when(F.col("lang") == "en", "T1w").when(F.col("lang") == "fr", "T2w")
        .when(F.col("lang") == "de", "FLAIR").otherwise("bold").alias("suffix"),
        F.md5("text").alias("md5"),
        (chars * 10000).alias("size"),
        F.when(four, F.array(*shape, F.lit(2).cast("bigint"))).otherwise(F.array(*shape)).alias("shape"),
        F.when(four, F.array(*pixdim, F.lit(2.0))).otherwise(F.array(*pixdim)).alias("pixdim"),
    )


def participants(t: Tables) -> DataFrame:
    """``labels`` as a participant table with gaps."""
    doc = F.col("doc_id")
    return t.labels.select(
        doc.cast("string").alias("sub"),
        F.when(doc % 11 == 0, None).when(F.col("quality") == 1, "F").otherwise("M").alias("sex"),
        F.when(doc % 7 == 0, None).otherwise((18 + doc % 60).cast("double") + F.col("toxic") * F.lit(0.5)).alias("age"),
    )


VOXELS_SQL = """
voxels AS (
  SELECT vec_id AS scan_id, i - 1 AS k, CAST(embedding[i] AS DOUBLE) AS v, embedding[i] > 0 AS m,
         (i - 1) // 16 AS x, ((i - 1) // 4) % 4 AS y, (i - 1) % 4 AS z
  FROM embeddings, range(1, 65) r(i)
), cells AS (
  SELECT *, (x // 2) * 4 + (y // 2) * 2 + z // 2 AS patch_id, (x % 2) * 4 + (y % 2) * 2 + z % 2 AS j FROM voxels
)"""


def volumes(t: Tables) -> DataFrame:
    """``embeddings`` as 4x4x4 volumes whose mask is the positive voxels."""
    return t.embeddings.select(
        F.col("vec_id").alias("scan_id"),
        F.col("embedding").alias("image"),
        F.transform("embedding", lambda v: v > 0).alias("mask"),
        F.expr("vec_id div 16").alias("batch"),
    )


def spread(df: DataFrame, vals: str, keys: list[str], width: int, prefix: str = "v", digits: int | None = None) -> DataFrame:
    """A short list as scalar columns, for comparison."""
    def item(i: int):
        value = F.col(vals)[i].cast("double")
        return value if digits is None else F.round(value, digits)

    return df.select(*keys, *[item(i).alias(f"{prefix}{i}") for i in range(width)])


def spread_sql(value: str, position: str, width: int, prefix: str = "v", digits: int | None = None) -> str:
    """SQL aggregates that lay out one value per position."""
    def item(i: int) -> str:
        picked = f"max(CASE WHEN {position} = {i} THEN {value} END)"
        return picked if digits is None else f"round({picked}, {digits})"

    return ", ".join(f"{item(i)} AS {prefix}{i}" for i in range(width))
