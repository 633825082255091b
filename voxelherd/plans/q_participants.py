"""Queries: participant harmonization."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelherd.functions.columns import (
    coerce_value, coerce_variant, normalize_age, normalize_category, null_if_na, null_safe, strip_prefix, variant_parts,
)
from voxelherd.operators.ordering import dedup_first
from voxelherd.operators.participants import (
    age_check, group_range, load_participants, resolve_columns, unpivot_waves,
)
from voxelherd.operators.quality import assert_unique, duplicate_keys
from voxelherd.plans.registry import query
from voxelherd.sources.tables import age_units


@query("normalize_ids", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS sub,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'xses-' || o_orderpriority END AS ses FROM orders""")
def normalize_ids(t):
    order = F.col("o_orderkey")
    raw_sub = F.when(order % 3 == 0, None).otherwise(
        F.concat(F.when(order % 3 == 1, "sub-").otherwise(""), F.col("o_custkey"))
    )
    raw_ses = F.concat(F.when(order % 2 == 0, "ses-").otherwise("xses-"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", strip_prefix(raw_sub, "sub-").alias("sub"), strip_prefix(raw_ses, "ses-").alias("ses"))


SEX_SPELLINGS = ["M", " male ", "Man", "F", "FEMALE", "woman", "other", "n/a", ""]


@query("normalize_category", """
SELECT doc_id, CASE WHEN doc_id % 9 < 3 THEN 'M' WHEN doc_id % 9 < 6 THEN 'F' END AS sex FROM documents""")
def normalize_sex(t):
    text = F.get(F.array(*[F.lit(s) for s in SEX_SPELLINGS]), (F.col("doc_id") % 9).cast("int"))
    return t.documents.select("doc_id", normalize_category(text).alias("sex"))


@query("normalize_age", """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN round(c_acctbal, 2) WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL
       WHEN 4 THEN 1000.0::DOUBLE + c_nationkey ELSE round(c_nationkey::DOUBLE, 2) END AS age FROM customer""")
def normalize_ages(t):
    key = F.col("c_custkey") % 6
    text = (
        F.when(key == 0, F.col("c_acctbal").cast("string")).when(key == 1, F.concat("c_nationkey", F.lit("d")))
        .when(key == 2, "nan").when(key == 3, "0x1p3")
        .when(key == 4, F.concat(F.lit("1_0"), F.lpad("c_nationkey", 2, "0")))
        .otherwise(F.concat(F.lit(" +"), F.col("c_nationkey"), F.lit(".0e0 ")))
    )
    return t.customer.select("c_custkey", normalize_age(null_if_na(text)).alias("age"))


def header_rows(orders):
    """Orders as participant rows of many studies with differing headers."""
    study = (F.col("o_custkey") % 40).cast("string")
    kind = F.col("o_custkey") % 4
    cells = {
        "participant_id": F.concat(F.lit("sub-"), F.col("o_custkey")),
    }
    sex = F.when(F.col("o_orderkey") % 2 == 0, "Female").otherwise("m")
    age = F.round(F.col("o_totalprice") / 1000.0, 1).cast("string")
    ses = F.concat(F.lit("ses-"), F.col("o_orderkey") % 3)
    plain = F.create_map(
        F.lit("participant_id"), cells["participant_id"], F.lit("Sex"), sex, F.lit("AGE"), age, F.lit("session_id"), ses
    )
    gender = F.create_map(F.lit("participant_id"), cells["participant_id"], F.lit("gender"), sex, F.lit("age"), age)
    both = F.create_map(
        F.lit("participant_id"), cells["participant_id"], F.lit("SEX"), F.lit("n/a"), F.lit("gender"), sex,
        F.lit("ScanAge"), age, F.lit("session"), ses,
    )
    lacking = F.create_map(F.lit("subject"), cells["participant_id"], F.lit("age"), age)
    row = F.when(kind == 0, plain).when(kind == 1, gender).when(kind == 2, both).otherwise(lacking)
    return orders.select(F.concat(F.lit("st"), study).alias("dataset"), F.col("o_orderkey").alias("line"), row.alias("row"))


@query("coalesce_headers", """
SELECT o_orderkey AS line,
       CASE o_custkey % 4 WHEN 0 THEN 'session_id' WHEN 2 THEN 'session' END AS ses_header,
       CASE o_custkey % 4 WHEN 0 THEN 'Sex' WHEN 1 THEN 'gender' WHEN 2 THEN 'SEX' END AS sex_header,
       CASE WHEN o_custkey % 40 = 2 THEN 'ScanAge' WHEN o_custkey % 4 = 0 THEN 'AGE' WHEN o_custkey % 4 IN (1, 3) THEN 'age' END AS age_header
FROM orders""")
def coalesce_headers(t):
    found = resolve_columns(header_rows(t.orders), {"st2": "ScanAge"})
    return found.select("line", "ses_header", "sex_header", "age_header")


SIDECAR = """CASE WHEN s % 5 = 0 THEN '{"Age": {"Units": "Months"}}' WHEN s % 5 = 1 THEN '{"age": {"Description": "in years"}, "AGE": "months"}'
 WHEN s % 5 = 2 THEN '{"broken' WHEN s % 5 = 3 THEN '{"age": "years", "SCANAGE": ["Month"]}' ELSE '{}' END"""


@query("age_units", """
SELECT 'st' || s AS dataset, h AS header, u AS unit FROM (
  SELECT s, CASE WHEN s % 5 = 3 AND k = 1 THEN 'scanage' ELSE 'age' END AS h,
         CASE WHEN s % 5 = 3 AND k = 0 THEN 'years' ELSE 'months' END AS u,
         s % 5 IN (0, 1, 3) AND (k = 0 OR s % 5 = 3) AS there
  FROM (SELECT DISTINCT o_custkey AS s FROM orders), range(0, 2) r(k)) WHERE there""")
def sidecar_units(t):
    studies = t.orders.select(F.col("o_custkey").alias("s")).distinct()
    return age_units(studies.select(F.concat(F.lit("st"), F.col("s")).alias("dataset"), F.expr(SIDECAR).alias("json")))


HARMONIZED_SQL = """
WITH r AS (
  SELECT o_custkey % 40 AS s, o_orderkey AS line, CAST(o_custkey AS VARCHAR) AS sub, o_custkey % 4 AS kind,
         CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'M' END AS sexv, round(o_totalprice / 1000.0::DOUBLE, 1) AS agev,
         CAST(o_orderkey % 3 AS VARCHAR) AS sesv FROM orders
), h AS (
  SELECT 'st' || s AS dataset, line, sub, CASE WHEN kind IN (0, 2) THEN sesv END AS ses,
         CASE WHEN kind IN (0, 1) THEN sexv END AS sex,
         CASE WHEN kind = 0 AND s % 5 = 0 THEN agev / 12 WHEN kind = 0 AND s % 5 = 1 THEN agev / 12
              WHEN kind = 1 AND s % 5 IN (0, 1) THEN agev / 12 WHEN kind IN (0, 1) THEN agev END AS age
  FROM r WHERE kind <> 3
), one AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY dataset, sub, ses ORDER BY line) = 1)
"""


@query("union_loaders", HARMONIZED_SQL + """
SELECT dataset, sub, ses, sex, round(CASE WHEN age > 0 THEN age END, 6) AS age FROM one WHERE dataset <> 'st8'
UNION ALL SELECT dataset, sub, 'own', NULL, NULL FROM h WHERE dataset = 'st8'""")
def union_loaders(t):
    rows = header_rows(t.orders)
    studies = rows.select("dataset").distinct()
    number = F.expr("substring(dataset, 3)").cast("int")
    units = age_units(studies.withColumn("s", number).select("dataset", F.expr(SIDECAR).alias("json")))

    def own(part):
        return part.select(
            "dataset", strip_prefix(F.element_at("row", "participant_id"), "sub-").alias("sub"), F.lit("own").alias("ses")
        )

    loaded = load_participants(rows, units=units, loaders={"st8": own})
    return loaded.drop("line").withColumn("age", F.round("age", 6))


@query("unpivot", """
SELECT doc_id, 'wave1' AS ses, quality AS age FROM labels
UNION ALL SELECT doc_id, 'wave2', nullif(toxic, 0) FROM labels WHERE toxic <> 0""")
def unpivot(t):
    wide = t.labels.select("doc_id", F.col("quality").alias("a1"), F.nullif("toxic", F.lit(0)).alias("a2"))
    return unpivot_waves(wide, ["doc_id"], {"wave1": "a1", "wave2": "a2"})


@query("group_range", """
SELECT o_custkey AS sub, nullif(o_orderstatus, 'P') AS ses, round(max(o_totalprice) - min(o_totalprice), 4) AS range
FROM orders GROUP BY 1, 2""")
def value_range(t):
    rows = t.orders.select(F.col("o_custkey").alias("sub"), F.nullif("o_orderstatus", F.lit("P")).alias("ses"), "o_totalprice")
    return group_range(rows, "o_totalprice").withColumn("range", F.round("range", 4))


@query("age_check", """
WITH s AS (SELECT o_orderpriority AS dataset, o_custkey, o_orderstatus, max(o_totalprice) - min(o_totalprice) AS r, max(o_totalprice) AS m
           FROM orders GROUP BY 1, 2, 3)
SELECT dataset, round(max(r), 4) AS max_range, max(m) AS age_max, max(m) > 499000 AS large_age FROM s GROUP BY 1""")
def check_ages(t):
    rows = t.orders.select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").alias("sub"), F.col("o_orderstatus").alias("ses"),
        F.col("o_totalprice").alias("age"),
    )
    return age_check(rows, large=499000).withColumn("max_range", F.round("max_range", 4))


@query("assert_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def unique_keys(t):
    assert_unique(t.orders, ["o_orderkey"], "orders")
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("first_session", """
SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1""")
def first_session(t):
    rows = t.conversations.select("conv_id", "turn", "role").distinct()
    return dedup_first(rows, ["conv_id", "role"], ["turn"])


COERCE_SQL = """
WITH v AS (SELECT c_custkey, c_custkey % 8 AS k, c_nationkey, c_acctbal, c_mktsegment FROM customer)
SELECT c_custkey, CASE WHEN k IN (1, 2) THEN CAST(c_nationkey AS BIGINT) END AS as_int,
       CASE k WHEN 3 THEN CAST(c_nationkey AS DOUBLE) * 1000 WHEN 6 THEN c_nationkey + 0.5::DOUBLE END AS as_double,
       CASE WHEN k = 7 THEN c_mktsegment || '_V' || c_nationkey END AS as_string FROM v"""


def mixed_cells(t):
    k, n = F.col("c_custkey") % 8, F.col("c_nationkey").cast("string")
    return (
        F.when(k == 0, "   ").when(k == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(k == 2, F.concat(F.lit("+"), n, F.lit(".00")))
        .when(k == 3, F.concat(n, F.lit("e3"))).when(k == 4, "-inf").when(k == 5, "NaN")
        .when(k == 6, F.concat(n, F.lit(".5"))).otherwise(F.concat("c_mktsegment", F.lit("_V"), n))
    )


@query("coerce_value", COERCE_SQL)
def coerce_values(t):
    parts = coerce_value(mixed_cells(t))
    return t.customer.select("c_custkey", parts.alias("v")).select("c_custkey", "v.as_int", "v.as_double", "v.as_string")


@query("coerce_variant", COERCE_SQL)
def coerce_variants(t):
    """The same cells kept as one VARIANT column, then read by type."""
    stored = t.customer.select("c_custkey", coerce_variant(mixed_cells(t)).alias("cell"))
    parts = stored.select("c_custkey", variant_parts(F.col("cell")).alias("v"))
    return parts.select("c_custkey", "v.as_int", "v.as_double", "v.as_string")


@query("null_safe_meta", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS source, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS inner_source,
       CAST(n_chars AS VARCHAR) AS inner_size, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '["' || lang || ', x", "' || source || '"]' END AS tags FROM documents""")
def null_safe_meta(t):
    source = F.when(F.col("doc_id") % 4 != 0, F.col("source"))
    tags = F.when(F.col("doc_id") % 5 != 0, F.array(F.concat("lang", F.lit(", x")), F.col("source")))
    metas = t.documents.select("doc_id", F.struct(
        source.alias("source"), tags.alias("tags"), F.struct(source.alias("source"), F.col("n_chars").alias("size")).alias("inner")
    ).alias("meta"))
    safe = metas.select("doc_id", null_safe(F.col("meta"), metas.schema["meta"].dataType).alias("meta"))
    return safe.select(
        "doc_id", "meta.source", "meta.tags", F.col("meta.inner.source").alias("inner_source"), F.col("meta.inner.size").alias("inner_size")
    )
