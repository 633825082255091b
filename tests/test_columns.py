import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxelherd.functions import columns as c
from voxelherd.operators.curation import Bounds, add_geometry, curate_filter, dup_report, outlier_lists, rule_report
from voxelherd.operators.ordering import dedup_first


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_prefix_is_removed_once(spark):
    assert values(spark, ["sub-007", "007", "sub-sub-1", None], lambda t: c.strip_prefix(t, "sub-")) == ["007", "007", "sub-1", None]


def test_sex_spellings(spark):
    assert values(spark, [" Male\t", "WOMAN", "f", "x", "", None], c.normalize_category) == ["M", "F", "F", None, None, None]


def test_age_text(spark):
    texts = ["2.676", "720", " +3 ", "1e1", "1_000", ".5", "5.", "5d", "0x1p3", "nan", "inf", "", "1e999", None]
    assert values(spark, texts, c.normalize_age) == [2.68, 720.0, 3.0, 10.0, 1000.0, 0.5, 5.0, *[None] * 7]


def test_age_units(spark):
    df = spark.createDataFrame([(24.0, "months"), (30.0, "years"), (0.0, "years"), (-1.0, "years"), (None, "months")], "a double, u string")
    assert [r[0] for r in df.select(c.age_in_years(F.col("a"), F.col("u"))).collect()] == [2.0, 30.0, None, None, None]


def test_missing_spellings(spark):
    assert values(spark, ["n/a", "NA", "", "none", "x"], c.null_if_na) == [None, None, None, "none", "x"]


def test_coerced_cells(spark):
    texts = ["", " 5 ", "+5.0", "1e3", "inf", "nan", "HC1_V1", "-7", "2.50", "99999999999999999999", None]
    got = [tuple(v) for v in values(spark, texts, c.coerce_value)]
    none = (None, None, None)
    assert got == [
        none, (5, None, None), (5, None, None), (None, 1000.0, None), none, none, (None, None, "HC1_V1"),
        (-7, None, None), (None, 2.5, None), (None, 1e20, None), none,
    ]


def test_json_list_text(spark):
    df = spark.createDataFrame([(["a, b", 'q"'],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(c.null_safe_list(F.col("x"))).collect()] == ['["a, b", "q\\""]', "[]", ""]


def test_paths(spark):
    texts = [
        "ds1/sub-04/anat/sub-04_T1w.nii.gz", "ds1/sub-04/ses-1/anat/sub-04_ses-1_run-1_run-2_x_FLAIR.nii",
        "ds1/sub-04/func/sub-04_bold.nii.gz", "ds1/anat/sub-1_acq-a-b_T1w.nii.gz", "ds1/anat/scan.nii.gz", "scan_T1w.nii",
        "ds1/anat/x_T1w",
    ]
    got = values(spark, texts, c.bids_fields)
    assert got[0].asDict() == {"dataset": "ds1", "entities": {"sub": "04"}, "suffix": "T1w", "reason": None}
    assert got[1]["entities"] == {"sub": "04", "ses": "1", "run": "2"} and got[1]["suffix"] == "FLAIR"
    assert [g["reason"] for g in got[2:]] == [
        "not an anat folder", "malformed entity", "no suffix", "no parent folder", "no extension",
    ]


def test_component_order(spark):
    df = spark.createDataFrame([("a-b/c",), ("a/b",)], "path string")
    assert [r[0] for r in df.orderBy(c.path_order(F.col("path"))).collect()] == ["a/b", "a-b/c"]


def test_scan_key(spark):
    tail = "_space-X_desc-processed.nii.gz"
    assert values(spark, ["sub-A_ses-V1_T1w" + tail], lambda t: c.scan_key(t, tail)) == ["sub-A_ses-V1_T1w"]
    with pytest.raises(PySparkException, match="unexpected file name"):
        values(spark, ["other.nii.gz"], lambda t: c.scan_key(t, tail))
    got = values(spark, ["sub-A_ses-V1_T1w", "sub-A_T1w"], c.scan_key_fields)
    assert got[0]["id_event"] == "A_V1" and got[1] is None


GOOD = ([200, 200, 200], [1.0, 1.0, 1.0], 20_000_000)


def images(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "path int, shape array<int>, pixdim array<double>, size bigint"
    )


def test_inclusion_bounds_are_inclusive(spark):
    rows = [
        GOOD,
        (GOOD[0], GOOD[1], 1_000_000), (GOOD[0], GOOD[1], 999_999), (GOOD[0], GOOD[1], 60_000_000), (GOOD[0], GOOD[1], 60_000_001),
        ([600, 200, 200], [0.3, 1.0, 1.0], GOOD[2]), ([600, 200, 200], [0.29, 1.0, 1.0], GOOD[2]),
        ([100, 200, 200], [1.5, 1.0, 1.0], GOOD[2]), ([100, 200, 200], [1.51, 1.0, 1.0], GOOD[2]),
        ([200, 100, 200], [1.0, 1.51, 1.0], GOOD[2]), ([200, 200, 50], [1.0, 1.0, 3.0], GOOD[2]), ([200, 200, 50], [1.0, 1.0, 3.01], GOOD[2]),
        ([120, 200, 260], [1.0, 1.0, 1.0], GOOD[2]), ([119, 200, 200], [1.0, 1.0, 1.0], GOOD[2]), ([200, 200, 261], [1.0, 1.0, 1.0], GOOD[2]),
        ([200, 200, 200, 2], [1.0, 1.0, 1.0, 2.0], GOOD[2]), ([200, 200], [1.0, 1.0], GOOD[2]),
    ]
    df = add_geometry(images(spark, rows))
    assert sorted(r["path"] for r in curate_filter(df).collect()) == [0, 1, 3, 5, 7, 10, 12]
    report = rule_report(df).first()
    assert (report["n_images"], report["n_kept"]) == (17, 7)
    assert report["rejected_ndim"] == 2 and report["rejected_res_z"] == 2 and report["rejected_size_low"] == 1
    loose = curate_filter(df, Bounds(ndim=4))
    assert [r["path"] for r in loose.collect()] == [15]


def test_geometry_values(spark):
    row = add_geometry(images(spark, [([2, 3, 4, 9], [1.0, 2.0, 0.5, 7.0], 1)])).first()
    assert (row["ndim"], row["res"], row["fov_x"], row["fov_y"], row["fov_z"], row["vol"]) == (4, 7.0, 2.0, 6.0, 2.0, 24.0)


def test_copies(spark):
    df = spark.createDataFrame(
        [(2, "a"), (1, "a"), (3, None), (4, None), (5, "b")], "path int, md5 string"
    )
    assert dup_report(df).first().asDict() == {"n_groups": 1, "n_rows": 2, "largest": 2}
    assert sorted(r[0] for r in dedup_first(df, ["md5"], ["path"]).collect()) == [1, 3, 5]
    assert sorted(r[0] for r in dedup_first(df, ["md5"], ["path"], null_equal=False).collect()) == [1, 3, 4, 5]


def test_outliers(spark):
    df = spark.createDataFrame([(i, 10**i) for i in range(1, 12)], "path int, size bigint")
    got = [(r["path"], r["kind"]) for r in outlier_lists(df, n=2).collect()]
    assert sorted(got) == sorted([(1, "small"), (2, "small"), (11, "big"), (10, "big")])


def test_hashes_are_uniform_and_stable(spark):
    df = spark.range(4000).select(c.hash_uniform(1, F.col("id")).alias("u"))
    got = [r[0] for r in df.collect()]
    assert min(got) >= 0 and max(got) < 1 and math.isclose(sum(got) / len(got), 0.5, abs_tol=0.03)
    assert got == [r[0] for r in df.repartition(3).sort(F.lit(1)).collect()] or sorted(got) == sorted(
        r[0] for r in df.repartition(3).collect()
    )


def test_mixed_cells_as_one_variant(spark):
    cells = ["", " 5 ", "+5.0", "1e3", "0.5", "-2.25e-3", "inf", "nan", "HC1_V1", 'quote " and \\ back', "[1]", "true", None, "1_000", "12345678901234567890"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, cell string")
    got = df.select("i", c.coerce_value(F.col("cell")).alias("want"), c.variant_parts(c.coerce_variant(F.col("cell"))).alias("got")).orderBy("i").collect()
    for row in got:
        assert row["got"] == row["want"], cells[row["i"]]
    kinds = df.select(F.schema_of_variant(c.coerce_variant(F.col("cell"))).alias("kind")).distinct().collect()
    assert {"BIGINT", "STRING"} <= {r["kind"] for r in kinds}
