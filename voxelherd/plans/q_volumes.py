"""Queries: volumes, patches, masks, augmentation, windows, views.

Results are laid out as one row per scan or patch with a column per value, so nothing
is exploded to voxels; the SQL twins do work on voxel rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelherd.functions import kernels
from voxelherd.operators import masks, packed, volumes as v
from voxelherd.plans.analogs import PATCH, SHAPE, VOXELS_SQL, spread, spread_sql, volumes
from voxelherd.plans.registry import query

WITH = f"WITH {VOXELS_SQL}"
ONES = (1, 1, 1)
GRID_SQL = "grid AS (SELECT k, k // 16 AS x, (k // 4) % 4 AS y, k % 4 AS z FROM range(0, 64) r(k))"
VALID_SQL = "val AS (SELECT scan_id, scan_id // 16 AS batch, patch_id, bool_or(m) AS valid FROM cells GROUP BY 1, 2, 3)"


def quota_sql(source: str, flag: str, share: float) -> str:
    return f"""cnt AS (SELECT scan_id, batch, count(*) FILTER (WHERE {flag}) AS n FROM {source} GROUP BY 1, 2),
quota AS (SELECT batch, CAST(floor({share}::DOUBLE * min(n)) AS INTEGER) AS num_keep FROM cnt GROUP BY 1)"""


def drawn_sql(source: str, flag: str, seed: int, order: str | None = None) -> str:
    order = order or f"md5(scan_id || '-' || patch_id || '-{seed}')"
    return f"""drawn AS (SELECT s.scan_id, s.patch_id, s.{flag} AS flag, q.num_keep,
  s.{flag} AND row_number() OVER (PARTITION BY s.scan_id, s.{flag} ORDER BY {order}, patch_id) <= q.num_keep AS keep
  FROM {source} s JOIN quota q ON s.batch = q.batch)"""


def with_valid(t, patch=PATCH):
    return masks.add_valid(volumes(t), SHAPE, patch)


def flags(df, column, keys, width=8, prefix="f"):
    return df.select(*keys, *[F.col(column)[i].alias(f"{prefix}{i}") for i in range(width)])


def flags_sql(value: str, position: str, width: int = 8, prefix: str = "f") -> str:
    return ", ".join(f"bool_or({value}) FILTER (WHERE {position} = {i}) AS {prefix}{i}" for i in range(width))


# --- patches -------------------------------------------------------------------------

@query("patchify", f"""{WITH}
SELECT scan_id, CAST(patch_id AS INTEGER) AS patch_id, {spread_sql("v", "j", 8)} FROM cells GROUP BY 1, 2""")
def patchify(t):
    return spread(v.patchify(volumes(t), SHAPE, PATCH), "vals", ["scan_id", "patch_id"], 8)


@query("unpatchify", f"""{WITH} SELECT scan_id, {spread_sql("v", "k", 64)} FROM voxels GROUP BY 1""")
def unpatchify(t):
    return spread(v.unpatchify(v.patchify(volumes(t), SHAPE, PATCH), SHAPE, PATCH), "image", ["scan_id"], 64)


@query("patchify_strided", f"""{WITH}
SELECT scan_id, CAST(patch_id AS INTEGER) AS patch_id, {spread_sql("v", "j", 4)} FROM cells WHERE x % 2 = 0 GROUP BY 1, 2""")
def patchify_strided(t):
    return spread(v.patchify(volumes(t), SHAPE, PATCH, stride=2), "vals", ["scan_id", "patch_id"], 4)


@query("unpatchify_strided", f"""{WITH}, r AS (SELECT a.scan_id, a.k, b.v FROM voxels a JOIN voxels b
  ON a.scan_id = b.scan_id AND b.x = (a.x // 2) * 2 AND a.y = b.y AND a.z = b.z)
SELECT scan_id, {spread_sql("v", "k", 64)} FROM r GROUP BY 1""")
def unpatchify_strided(t):
    cut = v.patchify(volumes(t), SHAPE, PATCH, stride=2)
    return spread(v.unpatchify(cut, SHAPE, PATCH, stride=2), "image", ["scan_id"], 64)


@query("patchify_channels", """
WITH c AS (SELECT vec_id AS scan_id, embedding, i - 1 AS k, (i - 1) // 32 AS c, ((i - 1) // 8) % 4 AS x, ((i - 1) // 4) % 2 AS y, (i - 1) % 4 AS z,
                  CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))
SELECT scan_id, CAST((x // 2) * 2 + z // 2 AS INTEGER) AS patch_id,
""" + spread_sql("v", "c * 8 + (x % 2) * 4 + y * 2 + z % 2", 16) + " FROM c GROUP BY 1, 2")
def patchify_channels(t):
    return spread(v.patchify(volumes(t), (4, 2, 4), PATCH, chans=2), "vals", ["scan_id", "patch_id"], 16)


@query("patch_valid", f"""{WITH}, {VALID_SQL}
SELECT scan_id, {flags_sql("valid", "patch_id")} FROM val GROUP BY 1""")
def patch_valid(t):
    return flags(with_valid(t), "valid", ["scan_id"])


@query("patch_to_voxel", f"""{WITH}, {VALID_SQL}
SELECT c.scan_id, {flags_sql("valid", "k", 64)} FROM cells c JOIN val ON c.scan_id = val.scan_id AND c.patch_id = val.patch_id GROUP BY 1""")
def patch_to_voxel(t):
    full = with_valid(t).withColumn("full", kernels.spread_patches(SHAPE, PATCH)(F.col("valid")))
    return flags(full, "full", ["scan_id"], 64)


GATHER_SQL = f"""{WITH}, {VALID_SQL}, {quota_sql("val", "valid", 0.5)}, {drawn_sql("val", "valid", 9)}
SELECT c.scan_id, CAST(c.patch_id AS INTEGER) AS patch_id, {spread_sql("v", "j", 8)} FROM cells c
JOIN drawn d ON c.scan_id = d.scan_id AND c.patch_id = d.patch_id WHERE keep GROUP BY 1, 2"""


@query("gather_patches", GATHER_SQL)
def gather_patches(t):
    chosen = masks.random_mask(with_valid(t), 0.5, 9).select("scan_id", "visible")
    return spread(v.gather_patches(v.patchify(volumes(t), SHAPE, PATCH), chosen), "vals", ["scan_id", "patch_id"], 8)


@query("drop_scale", f"""{WITH}
SELECT scan_id, CAST(patch_id AS INTEGER) AS patch_id, {spread_sql("v * 8 / n", "j", 8, digits=6)}
FROM (SELECT *, CAST(greatest(count(*) FILTER (WHERE m) OVER (PARTITION BY scan_id, patch_id), 1) AS DOUBLE) AS n FROM cells) GROUP BY 1, 2""")
def drop_scale(t):
    both = v.patchify(volumes(t), SHAPE, PATCH, mask="mask")
    scaled = both.withColumn("vals", v.drop_scale(F.col("vals").cast("array<double>"), F.col("observed")))
    return spread(scaled, "vals", ["scan_id", "patch_id"], 8, digits=6)


# --- masks ---------------------------------------------------------------------------

@query("mask_random", f"""{WITH}, {VALID_SQL}, {quota_sql("val", "valid", 0.4)}, {drawn_sql("val", "valid", 7)}
SELECT scan_id, max(num_keep) AS num_keep, {flags_sql("keep", "patch_id")} FROM drawn GROUP BY 1""")
def mask_random(t):
    return flags(masks.random_mask(with_valid(t), 0.6, 7), "visible", ["scan_id", "num_keep"])


@query("mask_first", f"""{WITH}, {VALID_SQL}, {quota_sql("val", "valid", 1.0)}, {drawn_sql("val", "valid", 0, "patch_id")}
SELECT scan_id, max(num_keep) AS num_keep, {flags_sql("keep", "patch_id")} FROM drawn GROUP BY 1""")
def mask_first(t):
    return flags(masks.random_mask(with_valid(t), 0.0, 0, shuffle=False), "visible", ["scan_id", "num_keep"])


def mask_summary(df):
    """Counts that any valid block mask must meet."""
    outside = F.size(F.filter(F.arrays_zip("visible", "valid"), lambda p: p["visible"] & ~p["valid"]))
    return df.select("scan_id", "num_keep", masks.count_set(F.col("visible")).alias("n_visible"), outside.alias("n_outside"))


BLOCK_SQL = f"""{WITH}, one AS (SELECT scan_id, scan_id // 16 AS batch, m FROM voxels), {quota_sql("one", "m", 0.3)}
SELECT scan_id, num_keep, num_keep AS n_visible, CAST(0 AS INTEGER) AS n_outside FROM cnt JOIN quota ON cnt.batch = quota.batch"""


@query("mask_block", BLOCK_SQL)
def mask_block(t):
    return mask_summary(masks.apply_masking("block", with_valid(t, ONES), 0.7, 5, SHAPE))


@query("mask_hybrid", BLOCK_SQL)
def mask_hybrid(t):
    return mask_summary(masks.apply_masking("hybrid", with_valid(t, ONES), 0.7, 5, SHAPE))


VISIBLE_SQL = f"{VALID_SQL}, {quota_sql('val', 'valid', 0.4)}, {drawn_sql('val', 'valid', 7)}"


@query("mask_pred", f"""{WITH}, {VISIBLE_SQL},
cand AS (SELECT c.scan_id, c.scan_id // 16 AS batch, c.patch_id, bool_or(c.m AND NOT d.keep) AS cand
         FROM cells c JOIN drawn d ON c.scan_id = d.scan_id AND c.patch_id = d.patch_id GROUP BY 1, 2, 3),
pc AS (SELECT scan_id, batch, count(*) FILTER (WHERE cand) AS n FROM cand GROUP BY 1, 2),
pq AS (SELECT batch, CAST(floor(0.75::DOUBLE * min(n)) AS INTEGER) AS num_keep FROM pc GROUP BY 1),
pd AS (SELECT s.scan_id, s.patch_id, q.num_keep, s.cand AND row_number() OVER (PARTITION BY s.scan_id, s.cand
       ORDER BY md5(scan_id || '-' || patch_id || '-8')) <= q.num_keep AS keep FROM cand s JOIN pq q ON s.batch = q.batch)
SELECT scan_id, max(num_keep) AS num_keep, {flags_sql("keep", "patch_id")} FROM pd GROUP BY 1""")
def mask_pred(t):
    seen = masks.random_mask(with_valid(t), 0.6, 7).drop("num_keep")
    seen = seen.withColumn("visible_mask", kernels.combine_flags(64, "and")(
        F.col("mask"), kernels.spread_patches(SHAPE, PATCH)(F.col("visible"))
    ))
    return flags(masks.select_pred_patches(seen, SHAPE, PATCH, 0.25, 8), "pred", ["scan_id", "num_keep"])


@query("mask_stats", f"""{WITH}, {VALID_SQL}, n AS (SELECT scan_id, batch, count(*) FILTER (WHERE valid) AS n FROM val GROUP BY 1, 2)
SELECT batch, round(avg(n), 6) AS valid_mean, CAST(min(n) AS INTEGER) AS valid_min, CAST(floor(0.2::DOUBLE * min(n)) AS INTEGER) AS visible
FROM n GROUP BY 1""")
def mask_stats(t):
    return masks.mask_stats(with_valid(t), 0.8).withColumn("valid_mean", F.round("valid_mean", 6))


@query("dilate", f"""{WITH}, hi AS (SELECT scan_id, k, x, y, z, v > 0.2::DOUBLE AS m FROM voxels),
grown AS (SELECT a.scan_id, a.k, bool_or(b.m) AS m FROM hi a JOIN hi b ON a.scan_id = b.scan_id AND abs(a.x - b.x) <= 1
          AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY 1, 2)
SELECT scan_id, {flags_sql("m", "k", 64)} FROM grown GROUP BY 1""")
def dilate(t):
    high = volumes(t).withColumn("mask", F.transform("image", lambda x: x.cast("double") > 0.2))
    return flags(high.withColumn("grown", kernels.dilate(SHAPE, 1)(F.col("mask"))), "grown", ["scan_id"], 64)


@query("unpack_bits", f"""{WITH}
SELECT scan_id, CAST(8 AS INTEGER) AS n_bytes, {flags_sql("m", "k", 64)} FROM voxels GROUP BY 1""")
def unpack_bits(t):
    packed = volumes(t).withColumn("bits", kernels.pack_bits(64)(F.col("mask")))
    dense = packed.withColumn("dense", kernels.unpack_bits(64)(F.col("bits"))).withColumn("n_bytes", F.length("bits"))
    return flags(dense, "dense", ["scan_id", "n_bytes"], 64)


@query("mask_from_seg", f"""{WITH} SELECT scan_id, CAST(count(*) FILTER (WHERE floor(v * 20) > 0) AS INTEGER) AS n,
       string_agg(CASE WHEN floor(v * 20) > 0 THEN '1' ELSE '0' END, '' ORDER BY k) AS cells FROM voxels GROUP BY 1""")
def mask_from_seg(t):
    seg = volumes(t).withColumn("seg", F.transform("image", lambda x: F.floor(x.cast("double") * 20).cast("int")))
    made = v.mask_from_segmentation(seg)
    cells = F.array_join(F.col("mask").cast("array<string>"), "")
    return made.select("scan_id", F.size(F.filter("mask", lambda m: m > 0)).alias("n"), cells.alias("cells"))


# --- normalization -------------------------------------------------------------------

def norm_sql(unit: str, masked: str = "CASE WHEN m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END") -> str:
    return f"""{WITH}, c AS (SELECT *, {unit} AS u, {masked} AS w FROM cells),
s AS (SELECT scan_id, u, greatest(sum(w), 1) AS n, sum(w * v) / greatest(sum(w), 1) AS mean FROM c GROUP BY 1, 2),
d AS (SELECT s.scan_id, s.u, max(mean) AS mean, sqrt(sum(w * (v - mean) * (v - mean)) / max(n) + 1e-6::DOUBLE) AS std
      FROM c JOIN s ON c.scan_id = s.scan_id AND c.u = s.u GROUP BY 1, 2),
z AS (SELECT c.scan_id, c.k, c.u, w * (v - mean) / std AS v, mean, std FROM c JOIN d ON c.scan_id = d.scan_id AND c.u = d.u)
SELECT scan_id, round(max(mean) FILTER (WHERE u = 0), 6) AS mean0, round(max(std) FILTER (WHERE u = 0), 6) AS std0,
       {spread_sql("v", "k", 64, digits=5)} FROM z GROUP BY 1"""


def normalized(t, level, mask="mask"):
    made = v.masked_normalize(volumes(t), SHAPE, PATCH, level, mask=mask)
    flat = made.select(
        "scan_id", F.col("norm.image").alias("image"), F.round(F.col("norm.mean")[0], 6).alias("mean0"),
        F.round(F.col("norm.std")[0], 6).alias("std0"),
    )
    return spread(flat, "image", ["scan_id", "mean0", "std0"], 64, digits=5)


@query("normalize_global", norm_sql("0"))
def normalize_global(t):
    return normalized(t, "global")


@query("normalize_slice", norm_sql("x // 2"))
def normalize_slice(t):
    return normalized(t, "slice")


@query("normalize_patch", norm_sql("patch_id"))
def normalize_patch(t):
    return normalized(t, "patch")


@query("normalize_plain", norm_sql("patch_id", "1.0::DOUBLE"))
def normalize_plain(t):
    return normalized(t, "patch", mask=None)


STATS_SQL = "st AS (SELECT scan_id, avg(v) AS mean, stddev_pop(v) AS std FROM cells WHERE scan_id % 3 <> 0 GROUP BY 1)"


@query("denormalize", f"""{WITH}, {STATS_SQL}
SELECT c.scan_id, CAST(patch_id AS INTEGER) AS patch_id, {spread_sql("v * coalesce(std, 1) + coalesce(mean, 0)", "j", 8, digits=6)}
FROM cells c LEFT JOIN st ON c.scan_id = st.scan_id GROUP BY 1, 2""")
def denormalize(t):
    made = v.masked_normalize(volumes(t), SHAPE, PATCH, "global", mask=None)
    known = F.col("scan_id") % 3 != 0
    stats = made.select(
        "scan_id", F.when(known, F.col("norm.mean")[0]).alias("mean"),
        F.when(known, F.sqrt(F.pow(F.col("norm.std")[0], 2) - 1e-6)).alias("std"),
    )
    joined = v.patchify(volumes(t), SHAPE, PATCH).join(stats, on="scan_id")
    raw = v.denormalize(F.col("vals").cast("array<double>"), F.col("mean"), F.col("std"))
    return spread(joined.withColumn("vals", raw), "vals", ["scan_id", "patch_id"], 8, digits=6)


# --- loss and predictions ------------------------------------------------------------

def predicted(t):
    """Half of the candidate patches with a simple prediction."""
    seen = masks.random_mask(with_valid(t), 0.5, 9)
    hidden = seen.withColumn("hidden", F.zip_with("valid", "visible", lambda a, b: a & ~b))
    rows = v.patchify(hidden, SHAPE, PATCH, keep="hidden")
    return rows.select("scan_id", "patch_id", F.transform("vals", lambda x: x.cast("double") * 0.5 + 0.1).alias("pred"))


HIDDEN_SQL = f"{VALID_SQL}, {quota_sql('val', 'valid', 0.5)}, {drawn_sql('val', 'valid', 9)}"


MSE_SQL = f"""{WITH}, {HIDDEN_SQL}
SELECT count(*) AS n_voxels, round(avg((v * 0.5::DOUBLE + 0.1::DOUBLE - v) * (v * 0.5::DOUBLE + 0.1::DOUBLE - v)), 8) AS loss
FROM cells c JOIN drawn d ON c.scan_id = d.scan_id AND c.patch_id = d.patch_id WHERE d.flag AND NOT d.keep AND c.m"""


@query("masked_mse", MSE_SQL)
def masked_mse(t):
    targets = v.patchify(volumes(t), SHAPE, PATCH, mask="mask").select(
        "scan_id", "patch_id", F.col("vals").cast("array<double>").alias("target"), F.col("observed").alias("mask")
    )
    loss = v.masked_mse(predicted(t), targets)
    return loss.select(F.col("n_voxels").cast("bigint").alias("n_voxels"), F.round("loss", 8).alias("loss"))


SCATTER_SQL = f"""{WITH}, {HIDDEN_SQL}
SELECT c.scan_id, {spread_sql("CASE WHEN d.flag AND NOT d.keep AND c.m THEN v * 0.5::DOUBLE + 0.1::DOUBLE ELSE 0.0::DOUBLE END", "k", 64, digits=6)}
FROM cells c JOIN drawn d ON c.scan_id = d.scan_id AND c.patch_id = d.patch_id GROUP BY 1"""


@query("scatter", SCATTER_SQL)
def scatter(t):
    placed = v.scatter_predictions(predicted(t), volumes(t), SHAPE, PATCH)
    return spread(placed, "image", ["scan_id"], 64, digits=6)


def hidden_on_scan(t):
    """Per scan the hidden patches as lists: numbers, values, observed voxels and predictions."""
    seen = masks.random_mask(with_valid(t), 0.5, 9)
    lists = seen.select(
        "scan_id", "mask", F.zip_with("valid", "visible", lambda a, b: a & ~b).alias("hidden"),
        F.sequence(F.lit(0), F.lit(7)).alias("id"),
        kernels.patch_arrays(SHAPE, PATCH)(F.col("image")).cast("array<array<double>>").alias("target"),
        kernels.patch_arrays(SHAPE, PATCH, element="boolean")(F.col("mask")).alias("observed"),
    )
    chosen = F.filter(F.arrays_zip("id", "hidden", "target", "observed"), lambda r: r["hidden"])
    kept = lists.select("scan_id", "mask", chosen.alias("_rows")).select(
        "scan_id", "mask", F.col("_rows.id").alias("patch_ids"), F.col("_rows.target").alias("target"),
        F.col("_rows.observed").alias("observed"),
    )
    return kept.withColumn("pred", F.transform("target", lambda p: F.transform(p, lambda x: x * 0.5 + 0.1)))


@query("gather_on_scan", GATHER_SQL)
def gather_on_scan(t):
    """The flags are on the scan row, so the patches are picked where they are cut."""
    return spread(v.patchify(masks.random_mask(with_valid(t), 0.5, 9), SHAPE, PATCH, keep="visible"), "vals", ["scan_id", "patch_id"], 8)


@query("masked_mse_on_scan", MSE_SQL)
def masked_mse_on_scan(t):
    loss = v.masked_mse_of_scans(hidden_on_scan(t), mask="observed")
    return loss.select(F.col("n_voxels").cast("bigint").alias("n_voxels"), F.round("loss", 8).alias("loss"))


@query("scatter_on_scan", SCATTER_SQL)
def scatter_on_scan(t):
    return spread(v.scatter_predictions_of_scans(hidden_on_scan(t), SHAPE, PATCH), "image", ["scan_id"], 64, digits=6)


@query("mean_pool", f"""{WITH}, p AS (SELECT scan_id, j, avg(v) AS v FROM cells GROUP BY 1, 2)
SELECT scan_id, {spread_sql("v", "j", 8, digits=6)} FROM p GROUP BY 1""")
def mean_pool(t):
    pooled = v.mean_pool(v.patchify(volumes(t), SHAPE, PATCH), vector="vals")
    return spread(pooled, "vals", ["scan_id"], 8, digits=6)


@query("composite", f"""{WITH}
SELECT scan_id, {spread_sql("CASE WHEN patch_id % 2 = 0 AND m THEN -v ELSE v END", "k", 64, prefix="c")},
       {spread_sql("CASE WHEN m AND NOT (patch_id % 2 = 0 AND m) THEN v ELSE -9.0::DOUBLE END", "k", 8, prefix="d")}
FROM cells GROUP BY 1""")
def composite(t):
    even = F.array(*[F.lit(i % 2 == 0) for i in range(8)])
    asked = kernels.combine_flags(64, "and")(F.col("mask"), kernels.spread_patches(SHAPE, PATCH)(F.col("even")))
    rows = volumes(t).withColumn("even", even).withColumn("asked", asked).withColumn(
        "pred", F.transform("image", lambda x: (-x).cast("float"))
    )
    shown = v.masked_input_display(v.composite(rows, 64, "image", "pred", "asked"), 64, "image", "asked", "mask", -9.0)
    return shown.select(
        "scan_id", *[F.col("composite")[i].cast("double").alias(f"c{i}") for i in range(64)],
        *[F.col("display")[i].cast("double").alias(f"d{i}") for i in range(8)],
    )


# --- augmentation --------------------------------------------------------------------

def hash_sql(*parts: str) -> str:
    joined = " || '-' || ".join(parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


@query("jitter", f"""{WITH}, {GRID_SQL},
p AS (SELECT vec_id AS scan_id, {", ".join(f"1 + {hash_sql(repr('6'), 'vec_id', repr('pad'), repr(str(i)))} % 2 AS p{i}, {hash_sql(repr('6'), 'vec_id', repr('start'), repr(str(i)))} AS h{i}" for i in range(3))} FROM embeddings),
s AS (SELECT scan_id, {", ".join(f"p{i} - h{i} % (2 * p{i} + 1) AS s{i}" for i in range(3))} FROM p),
o AS (SELECT s.scan_id, g.k, coalesce(a.v, 0) AS v, coalesce(a.m, false) AS m FROM s JOIN grid g ON true
      LEFT JOIN voxels a ON a.scan_id = s.scan_id AND a.x = g.x - s0 AND a.y = g.y - s1 AND a.z = g.z - s2)
SELECT scan_id, CAST(count(*) FILTER (WHERE m) AS INTEGER) AS n_mask, {spread_sql("v", "k", 64)} FROM o GROUP BY 1""")
def jitter(t):
    moved = v.jitter_crop(volumes(t), SHAPE, (1, 2), 6).withColumn("n_mask", masks.count_set(F.col("mask")))
    return spread(moved, "image", ["scan_id", "n_mask"], 64)


def double_volumes(t):
    """Volumes in double: results keep the type of the input and are compared to six digits."""
    return volumes(t).withColumn("image", F.col("image").cast("array<double>"))


@query("intensity", f"""{WITH}, p AS (SELECT vec_id AS scan_id, 0.9::DOUBLE + {hash_sql(repr('6'), 'vec_id', repr('scale'))} / 4294967296.0::DOUBLE * (1.1::DOUBLE - 0.9::DOUBLE) AS a,
  -0.1::DOUBLE + {hash_sql(repr('6'), 'vec_id', repr('shift'))} / 4294967296.0::DOUBLE * 0.2::DOUBLE AS b FROM embeddings)
SELECT c.scan_id, {spread_sql("CASE WHEN m THEN v * a + b ELSE 0.0::DOUBLE END", "k", 64, digits=6)} FROM voxels c JOIN p ON c.scan_id = p.scan_id GROUP BY 1""")
def intensity(t):
    changed = v.intensity_augment(double_volumes(t), SHAPE, 6, scale=(0.9, 1.1), shift=(-0.1, 0.1))
    return spread(changed, "image", ["scan_id"], 64, digits=6)


BLUR_SIGMA = 0.5


@query("blur", f"""{WITH}, w0 AS (SELECT o, exp(-0.5::DOUBLE * o * o / 0.25::DOUBLE) AS w FROM range(-2, 3) r(o)),
w AS (SELECT o, w / (SELECT sum(w) FROM w0) AS w FROM w0),
s AS (SELECT a.scan_id, a.k, max(a.m) AS m, sum(CASE WHEN b.m THEN b.v ELSE 0 END * wx.w * wy.w * wz.w) AS num,
             sum(CASE WHEN b.m THEN 1 ELSE 0 END * wx.w * wy.w * wz.w) AS den
      FROM voxels a JOIN voxels b ON a.scan_id = b.scan_id JOIN w wx ON wx.o = b.x - a.x JOIN w wy ON wy.o = b.y - a.y
      JOIN w wz ON wz.o = b.z - a.z GROUP BY 1, 2)
SELECT scan_id, {spread_sql("CASE WHEN m THEN num / greatest(den, 1e-6::DOUBLE) ELSE 0.0::DOUBLE END", "k", 64, digits=6)} FROM s GROUP BY 1""")
def blur(t):
    blurred = v.masked_blur(double_volumes(t), SHAPE, 1, sigma=(BLUR_SIGMA, BLUR_SIGMA))
    return spread(blurred, "image", ["scan_id"], 64, digits=6)


# --- windows and views ---------------------------------------------------------------

@query("pad_window", f"""{WITH}, g AS (SELECT k, k // 25 AS x, (k // 5) % 5 AS y, k % 5 AS z FROM range(0, 125) r(k)),
o AS (SELECT e.vec_id AS scan_id, g.k, coalesce(a.v, 0) AS v FROM embeddings e JOIN g ON true
      LEFT JOIN voxels a ON a.scan_id = e.vec_id AND a.x = g.x AND a.y = g.y AND a.z = g.z)
SELECT scan_id, '5x5x5' AS shape, true AS same, {spread_sql("v", "k", 125)} FROM o GROUP BY 1""")
def pad_window(t):
    original = volumes(t).withColumn("original", F.col("image"))
    padded, shape = v.pad_to_window(original, SHAPE, (5, 5, 5))
    back = v.crop_back(padded.withColumn("wide", F.col("image")), SHAPE, (5, 5, 5))
    marked = back.select("scan_id", F.lit("x".join(map(str, shape))).alias("shape"),
                         (F.col("image") == F.col("original")).alias("same"), "wide")
    return spread(marked, "wide", ["scan_id", "shape", "same"], 125)


def stitched(t, mode):
    """Windows whose values depend on the window, merged again."""
    tiles = v.window_tiles(volumes(t), SHAPE, (2, 2, 2), 0.5)
    scored = tiles.withColumn("vals", F.transform("vals", lambda x: x.cast("double") + F.col("tile") * 0.01))
    return spread(v.stitch(scored, SHAPE, (2, 2, 2), 0.5, mode), "image", ["scan_id"], 64, digits=6)


TILES_SQL = """tiles AS (SELECT a.i * 9 + b.i * 3 + c.i AS tile, a.i AS x0, b.i AS y0, c.i AS z0 FROM range(0, 3) a(i), range(0, 3) b(i), range(0, 3) c(i)),
hits AS (SELECT scan_id, k, v + tile * 0.01::DOUBLE AS v FROM voxels JOIN tiles ON x - x0 IN (0, 1) AND y - y0 IN (0, 1) AND z - z0 IN (0, 1))"""


@query("window_stitch", f"""{WITH}, {TILES_SQL}, o AS (SELECT scan_id, k, avg(v) AS v FROM hits GROUP BY 1, 2)
SELECT scan_id, {spread_sql("v", "k", 64, digits=6)} FROM o GROUP BY 1""")
def window_stitch(t):
    return stitched(t, "mean")


@query("window_stitch_sum", f"""{WITH}, {TILES_SQL}, o AS (SELECT scan_id, k, sum(v) AS v FROM hits GROUP BY 1, 2)
SELECT scan_id, {spread_sql("v", "k", 64, digits=6)} FROM o GROUP BY 1""")
def window_stitch_sum(t):
    return stitched(t, "sum")


def view_sql(axis: str, row: str, col: str, at: int) -> str:
    return f"""{WITH} SELECT scan_id, {spread_sql("v", f"(3 - {row}) * 4 + {col}", 16)} FROM voxels WHERE {axis} = {at} GROUP BY 1"""


def viewed(t, view, index=None):
    plane = v.extract_view(volumes(t), SHAPE, view, index).select("scan_id", F.flatten("plane").alias("plane"))
    return spread(plane, "plane", ["scan_id"], 16)


@query("view_slice", view_sql("x", "z", "y", 2))
def view_sagittal(t):
    return viewed(t, "sagittal")


@query("view_axial", view_sql("z", "y", "x", 3))
def view_axial(t):
    return viewed(t, "axial", -1)


@query("view_coronal", view_sql("y", "z", "x", 0))
def view_coronal(t):
    return viewed(t, "coronal", 0)


@query("intensity_limits", f"""{WITH}, n AS (SELECT scan_id, count(*) FILTER (WHERE m) AS n, min(v) FILTER (WHERE m) AS lo, max(v) FILTER (WHERE m) AS hi,
  quantile_cont(v, 0.005) FILTER (WHERE m) AS qlo, quantile_cont(v, 0.995) FILTER (WHERE m) AS qhi FROM voxels GROUP BY 1)
SELECT scan_id, round(CASE WHEN n < 32 THEN lo ELSE qlo END, 6) AS vmin, round(CASE WHEN n < 32 THEN hi ELSE qhi END, 6) AS vmax FROM n""")
def intensity_limits(t):
    found = v.intensity_limits(volumes(t))
    return found.select("scan_id", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


@query("content_crop", """
WITH p AS (SELECT vec_id AS scan_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c FROM embeddings, range(1, 65) x(i) WHERE embedding[i] > 0.3),
b AS (SELECT scan_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM p GROUP BY 1)
SELECT e.vec_id AS scan_id, CAST(coalesce(greatest((r0 // 2 - 1) * 2, 0), 0) AS INTEGER) AS row0, CAST(coalesce(least((r1 // 2 + 2) * 2, 8), 8) AS INTEGER) AS row1,
       CAST(coalesce(greatest((c0 // 1 - 1) * 1, 0), 0) AS INTEGER) AS col0, CAST(coalesce(least((c1 // 1 + 2) * 1, 8), 8) AS INTEGER) AS col1
FROM embeddings e LEFT JOIN b ON e.vec_id = b.scan_id""")
def content_crop(t):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(
        F.slice("embedding", r * 8 + 1, F.lit(8)), lambda x: x.cast("double") > 0.3))
    planes = t.embeddings.select(F.col("vec_id").alias("scan_id"), rows.alias("plane"))
    return v.content_crop(planes, (2, 1)).drop("plane")


# --- volumes as bytes ----------------------------------------------------------------

def packed_volumes(t):
    return packed.pack_volumes(volumes(t), SHAPE)


@query("packed_patchify", f"""{WITH}
SELECT scan_id, CAST(patch_id AS INTEGER) AS patch_id, {spread_sql("v", "j", 8)} FROM cells GROUP BY 1, 2""")
def packed_patchify(t):
    cut = packed.patchify(packed_volumes(t), PATCH)
    lists = cut.withColumn("vals", packed.unpack_values("float")(F.col("vals")))
    return spread(lists, "vals", ["scan_id", "patch_id"], 8)


@query("packed_unpatchify", f"""{WITH} SELECT scan_id, {spread_sql("v", "k", 64)} FROM voxels GROUP BY 1""")
def packed_unpatchify(t):
    whole = packed.unpatchify(packed.patchify(packed_volumes(t), PATCH), SHAPE, PATCH)
    return spread(whole.withColumn("image", packed.unpack_values("float")(F.col("image"))), "image", ["scan_id"], 64)


def packed_normalized(t, level):
    made = packed.masked_normalize(packed_volumes(t), PATCH, level, element="double")
    flat = made.select(
        "scan_id", packed.unpack_values("double")(F.col("image")).alias("image"), F.round(F.col("mean")[0], 6).alias("mean0"),
        F.round(F.col("std")[0], 6).alias("std0"),
    )
    return spread(flat, "image", ["scan_id", "mean0", "std0"], 64, digits=5)


@query("packed_normalize_patch", norm_sql("patch_id"))
def packed_normalize_patch(t):
    return packed_normalized(t, "patch")


@query("packed_normalize_global", norm_sql("0"))
def packed_normalize_global(t):
    return packed_normalized(t, "global")
