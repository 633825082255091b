"""Queries: pairing, work plan, splits, shards, epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelherd.operators import packaging as p
from voxelherd.operators.ordering import batch_slice, first_n
from voxelherd.operators.epochs import FACTOR, PRIME, ROUNDS, SPREAD, epoch_slots, number_samples, round_keys
from voxelherd.plans.registry import query

SCANS_SQL = """scans AS (
  SELECT o_orderkey AS key, 'e' || o_custkey AS id_event, o_orderpriority AS modality FROM orders
), meta AS (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'e' END || c_custkey AS id_event,
         CAST(c_nationkey AS VARCHAR) AS site, c_mktsegment AS study
  FROM customer
)"""


def scans(t):
    return t.orders.select(
        F.col("o_orderkey").alias("key"), F.concat(F.lit("e"), F.col("o_custkey")).alias("id_event"),
        F.col("o_orderpriority").alias("modality"),
    )


def event_metadata(t):
    custkey = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.when(custkey % 3 == 0, "x").otherwise("e"), custkey).alias("id_event"), F.col("c_nationkey").cast("string").alias("site"),
        F.col("c_mktsegment").alias("study"),
    )


@query("join_metadata", f"""WITH {SCANS_SQL}
SELECT key, s.id_event, site, study, CAST(NULL AS VARCHAR) AS race, m.id_event IS NOT NULL AS matched
FROM scans s LEFT JOIN meta m ON s.id_event = m.id_event""")
def join_metadata(t):
    joined = p.join_metadata(scans(t), event_metadata(t), allow_unmatched=True)
    return joined.select("key", "id_event", "site", "study", "race", "matched")


@query("unmatched_metadata", f"""WITH {SCANS_SQL}
SELECT key, id_event FROM scans WHERE id_event NOT IN (SELECT id_event FROM meta)""")
def unmatched(t):
    return p.unmatched_metadata(scans(t), event_metadata(t)).select("key", "id_event")


@query("record_report", f"""WITH {SCANS_SQL}
SELECT modality, count(*) AS n_records, count(m.id_event) AS n_matched
FROM scans s LEFT JOIN meta m ON s.id_event = m.id_event GROUP BY ROLLUP (modality)""")
def record_report(t):
    return p.record_report(p.join_metadata(scans(t), event_metadata(t), allow_unmatched=True))


@query("pair_missing", """
SELECT o_orderkey AS key, count(l_orderkey) > 0 AS paired FROM orders
LEFT JOIN (SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey ELSE -l_orderkey END AS l_orderkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1""")
def pair_missing(t):
    images = t.orders.select(F.col("o_orderkey").alias("key"))
    order = F.col("l_orderkey")
    masks = t.lineitem.select(F.when(F.col("l_returnflag") == "R", order).otherwise(-order).alias("key")).distinct()
    paired, missing = p.pair_image_mask(images, masks)
    return paired.withColumn("paired", F.lit(True)).unionByName(missing.withColumn("paired", F.lit(False)))


@query("shape_mismatch", """
WITH m AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS key, n FROM orders JOIN m ON o_orderkey = key WHERE o_orderkey % 3 + 3 <> n""")
def shape_mismatch(t):
    images = t.orders.select(F.col("o_orderkey").alias("key"), F.array(F.col("o_orderkey") % 3 + 3, F.lit(2)).alias("shape"))
    masks = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    masks = masks.withColumn("mask_shape", F.array("n", F.lit(2)))
    return p.shape_mismatch(images.join(masks, on="key")).select("key", "n")


@query("work_plan", """
WITH f AS (SELECT l_orderkey AS key, max(CASE WHEN l_linenumber IN (1) THEN 1 ELSE 0 END) a, max(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) b,
  max(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) c, max(CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END) d,
  max(CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END) e, max(CASE WHEN l_linenumber IN (6, 7) THEN 1 ELSE 0 END) g FROM lineitem GROUP BY 1)
SELECT o_orderkey AS key, CASE WHEN coalesce(a, 0) * coalesce(b, 0) = 0 THEN 'register'
  WHEN c * d * e = 0 THEN 'segment' WHEN g = 0 THEN 'mask_only' ELSE 'done' END AS status,
  'sub-' || o_orderkey || '_T1w_space-MNI152NLin2009cAsym_desc-processed.nii.gz' AS processed,
  'sub-' || o_orderkey || '_T1w_from-native_to-MNI152NLin2009cAsym_mode-image_xfm.mat' AS transform
FROM orders LEFT JOIN f ON o_orderkey = key""")
def work_plan(t):
    kinds = ["processed", "transform", "seg", "volumes", "qc", "mask", "mask"]
    outputs = t.lineitem.select(
        F.col("l_orderkey").alias("key"), F.get(F.array(*[F.lit(k) for k in kinds]), F.col("l_linenumber") - 1).alias("kind")
    )
    todo = p.work_plan(t.orders.select(F.col("o_orderkey").alias("key")), outputs)
    names = p.output_names(F.concat(F.lit("raw/sub-"), F.col("key"), F.lit("_T1w.nii.gz")))
    return todo.select("key", "status", names["processed"].alias("processed"), names["transform"].alias("transform"))


@query("failure_report", """
WITH p AS (SELECT o_orderkey, o_custkey % 50 AS batch, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'segment' END AS status FROM orders)
SELECT CASE WHEN batch % 7 = 3 AND status <> 'done' THEN 'failed' ELSE status END AS status, count(*) AS n_scans FROM p GROUP BY 1""")
def failure_report(t):
    plan = t.orders.select(
        "o_orderkey", (F.col("o_custkey") % 50).alias("batch"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("segment").alias("status")
    )
    failed = plan.where("batch % 7 = 3").select("batch", F.lit("tool ended with an error").alias("reason"))
    return p.run_report(p.mark_failures(plan, failed, "batch"))


@query("group_kfold", """
WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT o_custkey, (row_number() OVER (ORDER BY n DESC, o_custkey) - 1) % 10 AS lap FROM g)
SELECT o.o_orderkey, o.o_custkey, CAST(CASE WHEN lap < 5 THEN lap ELSE 9 - lap END + 1 AS INTEGER) AS fold
FROM orders o JOIN r ON o.o_custkey = r.o_custkey""")
def group_kfold(t):
    return p.group_kfold(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 5)


@query("split_assign", """
SELECT o_orderkey, o_custkey, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, CAST('0x' || substr(md5('7-' || o_custkey), 1, 8) AS BIGINT) % 100 AS b FROM orders)""")
def split_assign(t):
    return t.orders.select("o_orderkey", "o_custkey", p.split_assign(F.col("o_custkey"), seed=7).alias("split"))


@query("plan_shards", """
WITH c AS (SELECT doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before
           FROM documents)
SELECT doc_id, n_chars, bytes_before, dense_rank() OVER (ORDER BY bytes_before // 20000) - 1 AS shard FROM c""")
def plan_shards(t):
    return p.plan_shards(t.documents.select("doc_id", "n_chars"), ["doc_id"], "n_chars", 20000).drop("position")


@query("batch_slice", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 300""")
def rows_of_batch(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return batch_slice(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 100).drop("position")


@query("first_n", """
SELECT CAST(row_number() OVER (ORDER BY url, page_id) AS INTEGER) AS index, page_id, url FROM pages ORDER BY url, page_id LIMIT 50""")
def manifest(t):
    return first_n(t.pages.select("page_id", "url"), ["url", "page_id"], 50)


EPOCH_SQL = """
WITH n AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 50 AS block FROM embeddings),
x AS (SELECT vec_id, block, CAST(pass AS INTEGER) AS pass, md5('11-3-' || pass || '-block-' || block) AS b, md5('11-3-' || pass || '-' || vec_id) AS h
      FROM n, range(0, {passes}) r(pass)),
o AS (SELECT vec_id, pass, row_number() OVER (ORDER BY pass, b, block, h, vec_id) - 1 AS slot FROM x)
"""


@query("epoch_plan", EPOCH_SQL.format(passes=1) + """
SELECT vec_id, pass, slot, slot // 32 AS batch, CAST((slot // 32) % 4 AS INTEGER) AS rank, (slot // 32) // 4 AS step
FROM o WHERE slot < ((SELECT count(*) FROM embeddings) // 32) * 32""")
def epoch_plan(t):
    return p.epoch_plan(t.embeddings, "vec_id", 11, 3, batch_size=32, block_size=50, world_size=4)


@query("epoch_plan_repeat", EPOCH_SQL.format(passes=3) + """
SELECT vec_id, pass, slot, slot // 32 AS batch, CAST(0 AS INTEGER) AS rank, slot // 32 AS step FROM o
WHERE slot < ((SELECT count(*) FROM embeddings) * 5 // 2 // 32) * 32""")
def epoch_plan_repeat(t):
    size = t.embeddings.count() * 5 // 2
    return p.epoch_plan(t.embeddings, "vec_id", 11, 3, epoch_size=size, batch_size=32, block_size=50)


@query("epoch_plan_eval", """
SELECT vec_id, CAST(0 AS INTEGER) AS pass, row_number() OVER (ORDER BY vec_id) - 1 AS slot,
       (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch FROM embeddings""")
def epoch_plan_eval(t):
    plan = p.epoch_plan(t.embeddings, "vec_id", 0, 0, batch_size=64, drop_last=False, shuffle=False)
    return plan.select("vec_id", "pass", "slot", "batch")


@query("collate", EPOCH_SQL.format(passes=1) + """
SELECT slot // 32 AS batch, slot, e.vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
       round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 4) AS total
FROM o JOIN embeddings e ON o.vec_id = e.vec_id WHERE slot < ((SELECT count(*) FROM embeddings) // 32) * 32""")
def collate(t):
    plan = p.epoch_plan(t.embeddings, "vec_id", 11, 3, batch_size=32, block_size=50)
    packed = p.collate(plan, t.embeddings, "vec_id", ["embedding"], keep_meta=["label"])
    values = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return packed.select(
        "batch", "slot", "vec_id", "label", F.round(F.get(values, F.lit(0)), 6).alias("first_value"),
        F.round(total, 4).alias("total"),
    )


@query("sample_example", """
SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('5-' || doc_id), doc_id) = 1""")
def sample_example(t):
    return p.sample_example(t.documents.select("source", "doc_id"), ["source"], "doc_id", 5)


def _permuted_sql(value: str, n: str, key: str, tweak: str = "0") -> str:
    """The rounds of the permutation over a list, for a value of 0 … n - 1."""
    pivots, bits = zip(*round_keys(key))

    def mix(x: str, k: str) -> str:
        y = f"((({x}) + {k}) % {PRIME})"
        return f"(({y} * {y} % {PRIME} * {FACTOR} + {k}) % {PRIME})"

    pivot, bit = f"{list(pivots)}[r + 1]::BIGINT", f"{list(bits)}[r + 1]::BIGINT"
    other = f"((({mix(f'({tweak})::BIGINT', pivot)} - v) % ({n}) + ({n})) % ({n}))"
    drawn = f"({mix(f'greatest(v, {other}) + ({tweak})::BIGINT * {SPREAD}', bit)} // 1024 % 2)"
    return (f"list_reduce(list_prepend(({value})::BIGINT, range(0, {ROUNDS})), "
            f"lambda v, r: CASE WHEN {drawn} = 1 THEN {other} ELSE v END)")


@query("epoch_permuted", f"""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS total FROM orders),
b AS (SELECT *, position // 500 AS block, (total + 499) // 500 AS blocks, total - (total - 1) // 500 * 500 AS last_size FROM n),
k AS (SELECT DISTINCT block, blocks, last_size, {_permuted_sql("block", "blocks", "11-3-0-blocks")} AS place FROM b),
s AS (SELECT max(place) FILTER (block = blocks - 1) AS short FROM k),
r AS (SELECT o_orderkey, position, place * 500 - CASE WHEN place > short THEN 500 - last_size ELSE 0 END AS begin, block,
             CASE WHEN block = blocks - 1 THEN last_size ELSE 500 END AS size FROM b JOIN k USING (block, blocks, last_size), s)
SELECT o_orderkey, position, CAST(begin + {_permuted_sql("position % 500", "size", "11-3-0-rows", "block")} AS BIGINT) AS slot FROM r""")
def epoch_permuted(t):
    """Slots of an epoch by permutation; the rows were numbered before."""
    orders = t.orders.select("o_orderkey")
    return epoch_slots(number_samples(orders, "o_orderkey"), orders.count(), seed=11, epoch=3, block_size=500)
