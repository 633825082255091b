"""Queries: image index and curation."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyarrow import fs
from pyspark.sql import functions as F

from voxelherd.functions.columns import bids_fields, path_order, scan_key_fields, wave_fields
from voxelherd.operators import curation as c
from voxelherd.operators import sketches
from voxelherd.operators.ordering import dedup_first, sorted_curve
from voxelherd.plans.analogs import EXCLUDED, IMAGES_SQL, images, participants
from voxelherd.plans.curate import curate
from voxelherd.plans.registry import query
from voxelherd.session import materialize, scratch_folder
from voxelherd.sources.volumes import decode_volumes
from voxelherd.sources.image_source import scan_images
from voxelherd.sources.images import HEADER, content_md5, filter_listing, incremental_index, read_headers
from voxelherd.sources.tables import parse_list_column

WITH = f"WITH {IMAGES_SQL}"


def curated(t):
    return curate(images(t), participants(t), EXCLUDED, on=("sub",))


@query("curate_overview", f"""{WITH}
SELECT dataset, count(*) AS n_images, count(DISTINCT sub) AS n_subs,
       round(count(age) * 1.0::DOUBLE / count(*), 6) AS frac_labeled,
       round(count(*) * 1.0::DOUBLE / count(DISTINCT sub), 6) AS im_per_sub
FROM joined GROUP BY dataset""")
def curate_overview(t):
    over = c.dataset_overview(curated(t).joined)
    return over.withColumns({k: F.round(k, 6) for k in ("frac_labeled", "im_per_sub")})


@query("coverage_join", f"""{WITH}
SELECT count(*) AS n_images, count(*) FILTER (WHERE matched) AS n_matched, count(sex) AS n_sex, count(age) AS n_age,
       count(*) FILTER (WHERE sex IS NOT NULL AND age IS NOT NULL) AS n_both,
       round(100.0::DOUBLE * count(sex) / count(*), 6) AS pct_sex,
       round(100.0::DOUBLE * count(age) / count(*), 6) AS pct_age,
       round(100.0::DOUBLE * count(*) FILTER (WHERE sex IS NOT NULL AND age IS NOT NULL) / count(*), 6) AS pct_both
FROM joined""")
def coverage_join(t):
    found = c.coverage(curated(t).joined)
    return found.withColumns({k: F.round(k, 6) for k in ("pct_sex", "pct_age", "pct_both")})


@query("final_counts", f"""{WITH}
SELECT count(DISTINCT dataset) AS datasets, (SELECT count(*) FROM (SELECT DISTINCT dataset, sub FROM uniq)) AS subjects,
       count(*) AS images, count(*) FILTER (WHERE suffix = 'T1w') AS T1w, count(*) FILTER (WHERE suffix = 'T2w') AS T2w,
       count(*) FILTER (WHERE suffix = 'FLAIR') AS FLAIR
FROM uniq""")
def final_counts(t):
    return c.final_counts(curated(t).images)


@query("dataset_overview", f"""{WITH}, everything AS (
  SELECT i.*, p.age FROM images i LEFT JOIN parts p ON i.sub = p.sub)
SELECT dataset, count(path) AS n_images, count(DISTINCT sub) AS n_subs,
       round(count(age) * 1.0::DOUBLE / count(*), 6) AS frac_labeled,
       round(count(path) * 1.0::DOUBLE / count(DISTINCT sub), 6) AS im_per_sub
FROM everything GROUP BY dataset""")
def dataset_overview(t):
    joined = c.attach_participants(images(t).select("path", "dataset", "sub"), participants(t), ["sub"])
    return c.dataset_overview(joined).withColumns({k: F.round(k, 6) for k in ("frac_labeled", "im_per_sub")})


@query("geometry", f"""{WITH}
SELECT path, ndim, res, res_min, res_x, res_y, res_z, round(fov_x, 6) AS fov_x, round(fov_y, 6) AS fov_y,
       round(fov_z, 6) AS fov_z, round(least(fov_x, fov_y, fov_z), 6) AS fov_min,
       round(greatest(fov_x, fov_y, fov_z), 6) AS fov_max, round(fov_x * fov_y * fov_z, 3) AS vol
FROM geo""")
def geometry(t):
    made = c.add_geometry(images(t)).drop("dataset", "sub", "suffix", "md5", "size", "shape", "pixdim")
    fine = {k: F.round(k, 6) for k in ("fov_x", "fov_y", "fov_z", "fov_min", "fov_max")}
    return made.withColumns({**fine, "vol": F.round("vol", 3)})


@query("exclude_anti", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src3', 'src11')")
def exclude_anti(t):
    return c.exclude_datasets(t.documents.select("doc_id", "source"), EXCLUDED, on="source")


@query("exclude_by_table", """
SELECT d.doc_id, d.source FROM documents d
WHERE d.source NOT IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 1)""")
def exclude_by_table(t):
    docs = t.documents.select("doc_id", "source")
    odd = docs.groupBy("source").agg(F.min("doc_id").alias("m")).where("m % 2 = 1")
    return c.exclude_datasets(docs, odd, on="source")


@query("curate_filter", f"{WITH} SELECT path, dataset, suffix, md5, size FROM kept")
def curate_filter(t):
    kept = c.curate_filter(c.keep_modalities(c.exclude_datasets(c.add_geometry(images(t)), EXCLUDED)))
    return kept.select("path", "dataset", "suffix", "md5", "size")


@query("rule_report", f"""{WITH}
SELECT count(*) AS n_images,
  count(*) FILTER (WHERE r_ndim AND r_size_low AND r_size_high AND r_res_min AND r_res_x AND r_res_y AND r_res_z
           AND r_fov_min AND r_fov_max) AS n_kept,
  count(*) FILTER (WHERE NOT r_ndim) AS rejected_ndim, count(*) FILTER (WHERE NOT r_size_low) AS rejected_size_low,
  count(*) FILTER (WHERE NOT r_size_high) AS rejected_size_high, count(*) FILTER (WHERE NOT r_res_min) AS rejected_res_min,
  count(*) FILTER (WHERE NOT r_res_x) AS rejected_res_x, count(*) FILTER (WHERE NOT r_res_y) AS rejected_res_y,
  count(*) FILTER (WHERE NOT r_res_z) AS rejected_res_z, count(*) FILTER (WHERE NOT r_fov_min) AS rejected_fov_min,
  count(*) FILTER (WHERE NOT r_fov_max) AS rejected_fov_max
FROM ruled""")
def rule_report(t):
    return c.rule_report(c.add_geometry(images(t)))


@query("outlier_topk", """
(SELECT doc_id AS path, n_chars AS size, 'small' AS kind FROM documents WHERE n_chars < 100 ORDER BY n_chars, doc_id LIMIT 10)
UNION ALL
(SELECT doc_id, n_chars, 'big' FROM documents WHERE n_chars > 8000 ORDER BY n_chars DESC, doc_id LIMIT 10)""")
def outlier_topk(t):
    sizes = t.documents.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    return c.outlier_lists(sizes, small=100, big=8000)


@query("top_datasets", """
SELECT source AS dataset, count(*) AS n_subs FROM documents GROUP BY source HAVING count(*) >= 8
ORDER BY n_subs DESC, dataset LIMIT 5""")
def top_datasets(t):
    sizes = t.documents.groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n_subs"))
    return c.top_rows(sizes, "n_subs", 8, 5)


@query("non_3d", f"{WITH} SELECT path, ndim FROM images WHERE ndim <> 3")
def non_3d(t):
    return c.non_3d(c.add_geometry(images(t))).select("path", "ndim")


@query("value_counts", """
SELECT nullif(lang, 'es') AS lang, count(*) AS count FROM documents WHERE lang <> 'es' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def value_counts(t):
    return c.value_counts(t.documents.select(F.nullif("lang", F.lit("es")).alias("lang")), "lang", 3)


@query("value_counts_by", """
SELECT lang, source, n AS count FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) <= 10""")
def value_counts_by(t):
    return c.value_counts(t.documents, "source", 10, by=["lang"])


@query("histogram", """
WITH v AS (SELECT least(CAST(n_chars AS DOUBLE), 8000) AS v FROM documents),
lim AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20::DOUBLE AS w FROM v)
SELECT CAST(least(floor((v - lo) / w), 19) AS INTEGER) AS bin,
       round(min(lo) + CAST(least(floor((v - lo) / w), 19) AS INTEGER) * min(w), 6) AS bin_start, count(*) AS count
FROM v, lim GROUP BY 1""")
def histogram(t):
    return c.histogram(t.documents, "n_chars", 20, clip=8000).withColumn("bin_start", F.round("bin_start", 6))


@query("histogram_by", """
WITH v AS (SELECT lang, CAST(n_chars AS DOUBLE) AS v FROM documents),
lim AS (SELECT lang, min(v) AS lo, (max(v) - min(v)) / 40::DOUBLE AS w FROM v GROUP BY lang)
SELECT v.lang, CAST(least(floor((v - lo) / w), 39) AS INTEGER) AS bin,
       round(min(lo) + CAST(least(floor((v - lo) / w), 39) AS INTEGER) * min(w), 6) AS bin_start, count(*) AS count
FROM v JOIN lim ON v.lang = lim.lang GROUP BY 1, 2""")
def histogram_by(t):
    made = c.histogram(t.documents, "n_chars", 40, by=["lang"])
    return made.withColumn("bin_start", F.round("bin_start", 6))


@query("quantiles", """
SELECT round(quantile_cont(n_chars / 1e6::DOUBLE, 0.01), 9) AS p01, round(quantile_cont(n_chars / 1e6::DOUBLE, 0.05), 9) AS p05,
       round(quantile_cont(n_chars / 1e6::DOUBLE, 0.5), 9) AS p50, round(quantile_cont(n_chars / 1e6::DOUBLE, 0.95), 9) AS p95,
       round(max(n_chars / 1e6::DOUBLE), 9) AS p100 FROM documents""")
def quantiles(t):
    found = c.size_quantiles(t.documents.select((F.col("n_chars") / F.lit(1e6)).alias("mb")), "mb")
    return found.select(*[F.round(k, 9).alias(k) for k in found.columns])


@query("quantiles_by", """
SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2,
       round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY l_suppkey""")
def quantiles_by(t):
    found = c.size_quantiles(t.lineitem, "l_extendedprice", (0.25, 0.5, 0.75), ["l_suppkey"], names=["q1", "q2", "q3"])
    return found.select("l_suppkey", *[F.round(k, 4).alias(k) for k in ("q1", "q2", "q3")])


@query("quantiles_merged", """
SELECT l_suppkey % 10 AS part, count(*) AS n, round(quantile_disc(l_extendedprice, 0.25), 4) AS q1,
       round(quantile_disc(l_extendedprice, 0.5), 4) AS q2, round(quantile_disc(l_extendedprice, 0.95), 4) AS q3 FROM lineitem GROUP BY 1""")
def quantiles_merged(t):
    """Sketches per supplier are stored, then merged; with this k they still hold every value."""
    rows = t.lineitem.select("l_suppkey", "l_extendedprice")
    stored = materialize(sketches.quantile_sketches(rows, "l_extendedprice", ["l_suppkey"], k=32_768))
    merged = sketches.merge_sketches(stored.withColumn("part", F.col("l_suppkey") % 10), ["part"], k=32_768)
    found = sketches.sketch_quantiles(merged, (0.25, 0.5, 0.95), ["part"], names=["q1", "q2", "q3"])
    return found.select("part", "n", *[F.round(k, 4).alias(k) for k in ("q1", "q2", "q3")])


@query("dup_report", """
WITH g AS (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, coalesce(max(n), 0) AS largest FROM g""")
def dup_report(t):
    return c.dup_report(t.documents.select(F.md5("text").alias("md5")))


@query("dedup_first", """
SELECT doc_id, md5(text) AS md5, source FROM documents
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""")
def dedup_first_content(t):
    rows = t.documents.select("doc_id", F.md5("text").alias("md5"), "source")
    return dedup_first(rows, ["md5"], ["doc_id"])


@query("sorted_curve", """
WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem),
p AS (SELECT CAST(i AS INTEGER) AS point, (i * ((SELECT count(*) FROM lineitem) - 1)) // 199 AS r FROM range(0, 200) t(i))
SELECT p.point, s.v AS l_extendedprice FROM p JOIN s ON p.r = s.r""")
def sorted_curve_price(t):
    return sorted_curve(t.lineitem, "l_extendedprice", 200).withColumn("point", F.col("point").cast("int"))


@query("per_group_boxstats", f"""{WITH}, lab AS (
  SELECT i.path, i.dataset, i.sub, p.age FROM images i JOIN parts p ON i.sub = p.sub WHERE p.age IS NOT NULL
), one AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY dataset, sub ORDER BY path) = 1)
SELECT dataset, round(min(age), 6) AS age_min, round(quantile_cont(age, 0.25), 6) AS age_q1,
       round(quantile_cont(age, 0.5), 6) AS age_median, round(quantile_cont(age, 0.75), 6) AS age_q3,
       round(max(age), 6) AS age_max, count(*) AS n_subs, round(log10(count(*)), 6) AS log_count
FROM one GROUP BY dataset HAVING count(*) >= 5""")
def per_group_boxstats(t):
    joined = c.attach_participants(images(t).select("path", "dataset", "sub"), participants(t), ["sub"])
    stats = c.per_dataset_age(joined, ["path"], min_subjects=5)
    rounded = [k for k in stats.columns if k.startswith("age_") or k == "log_count"]
    return stats.withColumns({k: F.round(k, 6) for k in rounded})


def asset_paths(docs):
    """Paths of the image files the documents stand for, some hidden or ignored."""
    doc = F.col("doc_id").cast("string")
    folder = F.when(F.col("doc_id") % 13 == 0, "func").otherwise("anat")
    dot = F.when(F.col("doc_id") % 17 == 0, ".").otherwise("")
    extra = (
        F.when(F.col("doc_id") % 19 == 0, "_acq-a-b").when(F.col("doc_id") % 5 == 0, "_acq-hi_run-1_run-2").otherwise("")
    )
    tail = F.when(F.col("doc_id") % 23 == 0, ".json").otherwise(".nii.gz")
    place = F.when(F.col("doc_id") % 29 == 0, "/bidsignore").otherwise("")
    return F.concat(
        F.col("source"), place, F.lit("/sub-"), doc, F.lit("/"), folder, F.lit("/"), dot, F.lit("sub-"), doc, extra,
        F.lit("_"), F.upper("lang"), tail,
    )


PATHS_SQL = """paths AS (
  SELECT doc_id, n_chars, source || CASE WHEN doc_id % 29 = 0 THEN '/bidsignore' ELSE '' END || '/sub-' || doc_id || '/' ||
    CASE WHEN doc_id % 13 = 0 THEN 'func' ELSE 'anat' END || '/' || CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END ||
    'sub-' || doc_id || CASE WHEN doc_id % 19 = 0 THEN '_acq-a-b' WHEN doc_id % 5 = 0 THEN '_acq-hi_run-1_run-2' ELSE '' END ||
    '_' || upper(lang) || CASE WHEN doc_id % 23 = 0 THEN '.json' ELSE '.nii.gz' END AS path
  FROM documents)"""


@query("list_assets", f"""WITH {PATHS_SQL}
SELECT path, n_chars AS size FROM paths
WHERE doc_id % 23 <> 0 AND doc_id % 17 <> 0 AND doc_id % 29 <> 0""")
def list_assets(t):
    return filter_listing(t.documents.select(asset_paths(t.documents).alias("path"), F.col("n_chars").alias("size")))


@query("parse_path", f"""WITH {PATHS_SQL}
SELECT path, split_part(path, '/', 1) AS dataset,
       CASE WHEN doc_id % 13 = 0 THEN 'not an anat folder' WHEN doc_id % 17 = 0 THEN 'no suffix'
            WHEN doc_id % 19 = 0 THEN 'malformed entity' END AS reason,
       CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS sub,
       CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN '2' END AS run
FROM paths""")
def parse_path(t):
    parsed = t.documents.select(asset_paths(t.documents).alias("path")).withColumn("f", bids_fields(F.col("path")))
    entity = {k: F.try_element_at("f.entities", F.lit(k)).alias(k) for k in ("sub", "run")}
    return parsed.select("path", "f.dataset", "f.reason", *entity.values())


@query("path_order", f"""WITH {PATHS_SQL}
SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place
FROM paths ORDER BY string_split(path, '/') LIMIT 100""")
def first_paths(t):
    from voxelherd.operators.ordering import first_n

    paths = t.documents.select(asset_paths(t.documents).alias("path"))
    return first_n(paths, [path_order(F.col("path"))], 100).select("path", F.col("index").cast("bigint").alias("place"))


@query("parse_key", """
WITH k AS (SELECT o_orderkey, 'sub-' || o_custkey || CASE WHEN o_orderkey % 10 = 0 THEN '-ses' ELSE '_ses' END ||
                  '-wave' || (o_orderkey % 4) || '_T' || (o_orderkey % 3) AS key FROM orders),
ok AS (SELECT *, o_orderkey % 10 <> 0 AS good FROM k)
SELECT o_orderkey, CASE WHEN good THEN regexp_extract(key, '^sub-([^_]+)_', 1) END AS subject_id,
       CASE WHEN good THEN regexp_extract(key, '_ses-([^_]+)_', 1) END AS visit,
       CASE WHEN good THEN regexp_extract(key, '_([^_]+)$', 1) END AS modality,
       CASE WHEN good THEN regexp_extract(key, '^sub-([^_]+)_', 1) || '_' || regexp_extract(key, '_ses-([^_]+)_', 1) END AS id_event,
       CASE WHEN good AND o_orderkey % 4 <> 0 THEN 'wave' || (o_orderkey % 4) END AS wave
FROM ok""")
def parse_key(t):
    order = F.col("o_orderkey")
    key = F.concat(
        F.lit("sub-"), F.col("o_custkey"), F.when(order % 10 == 0, "-ses").otherwise("_ses"), F.lit("-wave"),
        order % 4, F.lit("_T"), order % 3,
    )
    parsed = t.orders.select("o_orderkey", key.alias("key")).withColumns({
        "f": scan_key_fields(F.col("key")), "w": wave_fields(F.col("key"))
    })
    return parsed.select("o_orderkey", "f.subject_id", "f.visit", "f.modality", "f.id_event", "w.wave")


@query("asset_md5", "SELECT doc_id, md5(text) AS md5 FROM documents")
def asset_md5(t):
    return content_md5(t.documents.select("doc_id", F.col("text").alias("content"))).select("doc_id", "md5")


@query("incremental_index", "SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental(t):
    return incremental_index(t.documents.select(F.col("doc_id").alias("path")), t.labels.select(F.col("doc_id").alias("path")))


@query("parse_list_col", f"""{WITH}
SELECT path, CASE WHEN path % 31 = 0 THEN NULL ELSE nx END AS n0, CASE WHEN path % 31 = 0 THEN NULL ELSE nz END AS n2,
       CASE WHEN path % 31 = 0 THEN NULL ELSE 3 END AS n FROM images""")
def parse_list_col(t):
    sized = images(t)
    text = F.concat(F.lit("["), F.array_join(F.slice("shape", 1, 3).cast("array<string>"), ", "), F.lit("]"))
    parsed = sized.select(
        "path", parse_list_column(F.when(F.col("path") % 31 == 0, "[1, nan, 2]").otherwise(text), "bigint").alias("s")
    )
    size = F.when(F.col("s").isNotNull(), F.size("s"))
    return parsed.select("path", F.get("s", F.lit(0)).alias("n0"), F.get("s", F.lit(2)).alias("n2"), size.alias("n"))


def _le(value, size: int):
    """Little-endian bytes of a non-negative integer column, for building headers."""
    hexed = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(hexed, 2 * (size - i) - 1, 2) for i in range(size)]))


def header_bytes(part):
    """A valid file header made from the columns of ``part``; every 11th is cut short."""
    zero = lambda n: F.unhex(F.lit("00" * n))
    dims = [F.lit(3), F.col("p_size") + 100, F.lit(256), F.col("p_partkey") % 300 + 1, *[F.lit(1)] * 4]
    # Single-precision 1.0, 0.5 and 2.0 as integers.
    zooms = [F.lit(0x3F800000), F.lit(0x3F000000), F.lit(0x40000000), F.lit(0x3F800000), *[F.lit(0)] * 4]
    whole = F.concat(
        _le(F.lit(348), 4), zero(36), *[_le(d, 2) for d in dims], zero(14),
        _le(F.when(F.col("p_partkey") % 2 == 0, 4).otherwise(16), 2), zero(4), *[_le(z, 4) for z in zooms], zero(240),
    )
    return F.when(F.col("p_partkey") % 11 == 0, F.substring(whole, 1, 100)).otherwise(whole)


@query("read_volumes", """
SELECT vec_id AS path, CAST(2 AS INTEGER) AS nx, CAST(8 AS INTEGER) AS nz,
       round(sum(floor((CAST(embedding[i] AS DOUBLE) + 4) * 1000) * 0.5::DOUBLE - 3), 4) AS total,
       round(sum((floor((CAST(embedding[i] AS DOUBLE) + 4) * 1000) * 0.5::DOUBLE - 3) * ((i - 1) % 2 * 32 + (i - 1) // 2 % 4 * 8 + (i - 1) // 8)), 4) AS weighted
FROM embeddings, range(1, 65) r(i) GROUP BY 1""")
def read_volumes(t):
    """Files of 2 x 4 x 8 voxels made from the vectors; values are scaled on reading."""
    zero = lambda n: F.unhex(F.lit("00" * n))
    # Single-precision 1.0, 0.5 (slope), -3.0 (shift) and 352.0 (start of the voxels) as integers.
    one, half, shift, start = (F.lit(x) for x in (0x3F800000, 0x3F000000, 0xC0400000, 0x43B00000))
    header = F.concat(
        _le(F.lit(348), 4), zero(36), *[_le(F.lit(d), 2) for d in (3, 2, 4, 8, 1, 1, 1, 1)], zero(14), _le(F.lit(512), 2),
        zero(4), *[_le(one, 4)] * 8, _le(start, 4), _le(half, 4), _le(shift, 4), zero(228), zero(4),
    )
    digits = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 4) * 1000)), 4, "0"))
    body = F.unhex(F.array_join(F.transform(digits, lambda d: F.concat(F.substring(d, 3, 2), F.substring(d, 1, 2))), ""))
    files = t.embeddings.select(F.col("vec_id").alias("path"), F.concat(header, body).alias("content"))
    made = decode_volumes(files)
    add = lambda a, x: a + x
    values = F.transform("image", lambda x: x.cast("double"))
    return made.select(
        "path", F.get("shape", F.lit(0)).alias("nx"), F.get("shape", F.lit(2)).alias("nz"),
        F.round(F.aggregate(values, F.lit(0.0), add), 4).alias("total"),
        F.round(F.aggregate(F.transform(values, lambda x, i: x * i), F.lit(0.0), add), 4).alias("weighted"),
    )


@query("header_index", """
SELECT p_partkey AS path, CASE WHEN p_partkey % 11 <> 0 THEN p_size + 100 END AS nx,
       CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 300 + 1 AS INTEGER) END AS nz,
       CASE WHEN p_partkey % 11 <> 0 THEN 0.5::DOUBLE END AS dx,
       CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'int16' ELSE 'float32' END END AS dtype,
       CASE WHEN p_partkey % 11 <> 0 THEN 'LAS' END AS orient,
       CASE WHEN p_partkey % 11 = 0 THEN 'truncated header' END AS reason
FROM part""")
def header_index(t):
    files = t.part.select(F.col("p_partkey").alias("path"), header_bytes(t.part).alias("content"))
    decoded = read_headers(files)
    return decoded.select(
        "path", F.get("shape", F.lit(0)).alias("nx"), F.get("shape", F.lit(2)).alias("nz"),
        F.get("pixdim", F.lit(0)).alias("dx"), "dtype", "orient", "reason",
    )


@query("image_scan", """
SELECT 'ds' || s_suppkey % 4 || '/sub-' || s_suppkey || '/anat/sub-' || s_suppkey || '_' || CASE WHEN s_suppkey % 3 = 0 THEN 'T1w' ELSE 'T2w' END || '.nii' AS path,
       CAST(348 + s_suppkey % 50 AS BIGINT) AS size, 'T1w' AS suffix, CAST(s_suppkey % 200 + 1 AS INTEGER) AS nx, 'int16' AS dtype
FROM supplier WHERE s_suppkey % 4 IN (1, 2) AND s_suppkey % 3 = 0 AND s_suppkey % 50 > 5""")
def image_scan(t):
    """Files made from the table, read back through the image source with filters."""
    root = scratch_folder(t.spark)
    key = F.col("s_suppkey")
    name = F.concat(
        F.lit("ds"), key % 4, F.lit("/sub-"), key, F.lit("/anat/sub-"), key, F.lit("_"),
        F.when(key % 3 == 0, "T1w").otherwise("T2w"), F.lit(".nii"),
    )
    t.supplier.select(name.alias("path"), (key % 200 + 1).cast("int").alias("nx"), (key % 50).cast("int").alias("more")).foreachPartition(
        partial(write_small_images, root)
    )
    found = scan_images(t.spark, root, ["path", "size", "dataset", "suffix", "shape", "dtype"])
    kept = found.where(F.col("dataset").isin("ds1", "ds2") & (F.col("suffix") == "T1w") & (F.col("size") > 353))
    return kept.select("path", "size", "suffix", F.get("shape", F.lit(0)).alias("nx"), "dtype")


def write_small_images(root, rows):
    """One file per row: a header with the given first size, and some bytes after it."""
    store, base = fs.FileSystem.from_uri(root)
    for row in rows:
        head = np.zeros((), HEADER)
        head["size"], head["datatype"], head["dim"], head["pixdim"] = 348, 4, [3, row["nx"], 5, 6, 1, 1, 1, 1], 1.0
        store.create_dir(f"{base}/{row['path'].rsplit('/', 1)[0]}", recursive=True)
        with store.open_output_stream(f"{base}/{row['path']}") as out:
            out.write(head.tobytes() + bytes(row["more"]))
