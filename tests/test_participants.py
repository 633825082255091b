import json

import pytest
from pyspark.sql import functions as F

from voxelherd.operators.participants import (
    age_check, group_range, load_participants, unpivot_waves,
)
from voxelherd.operators.quality import CohortDataError, many_to_one
from voxelherd.sources.tables import (
    load_event_metadata, load_image_index, read_exclude, read_participants, read_region_volumes, read_sidecar_units,
    read_train_log, typed_cells,
)


@pytest.fixture()
def studies(tmp_path):
    def put(dataset, tsv, sidecar=None):
        (tmp_path / dataset).mkdir()
        (tmp_path / dataset / "participants.tsv").write_text(tsv)
        if sidecar is not None:
            (tmp_path / dataset / "participants.json").write_text(sidecar)

    put("ds1", "participant_id\tSex\tAGE\tsession_id\nsub-007\t M\t20.456\tses-1\nsub-007\tF\t99\tses-1\nsub-8\tn/a\t0\tn/a\nsub-8\tman\t4\tn/a\nn/a\tM\t3\tses-1\n\nsub-9\tx\t5d\tses-2\n")
    put("ds2", "participant_id\tgender\tage\r\nsub-1\tfemale\t720\r\n", json.dumps({"Age": {"Units": "Months"}}))
    put("ds3", "subject\tage\nsub-1\t5\n")
    put("ds4", "participant_id\tage\nsub-1\t5\t7\n")
    put("ds5", "participant_id\tsession\tsession_id\tage\nsub-1\tn/a\tses-2\t-1\n", "{broken")
    put("ds000144", 'participant_id\tage\tScanAge\n"sub-1"\t1\t30\n')
    put("ds006169", "participant_id\tage\nsub-1\t24\n", json.dumps({"age": "years"}))
    put("ds004856", "participant_id\tSex\tAgeMRI_W1\tAgeMRI_W2\tAgeMRI_W3\nsub-1\tF\t30\tn/a\t38.5\nsub-2\tm\tn/a\tn/a\tn/a\n")
    put("ds7", 'participant_id\tnote\tage\n"sub-1"\t"a\ttab and\na ""break"""\t31\nsub-2\t\t32\n')
    put("out", "participant_id\tage\nsub-1\t24\n")
    return str(tmp_path)


def test_participant_files_to_one_table(spark, studies):
    rows, rejects = read_participants(spark, studies)
    table = load_participants(rows, exclude=["out"], units=read_sidecar_units(spark, studies))
    got = {tuple(r) for r in table.select("dataset", "sub", "ses", "sex", "age").collect()}
    assert got == {
        ("ds1", "007", "1", "M", 20.46), ("ds1", "8", None, None, None), ("ds1", "9", "2", None, None),
        ("ds2", "1", None, "F", 60.0), ("ds5", "1", None, None, None), ("ds000144", "1", None, None, 30.0),
        ("ds006169", "1", None, None, 2.0), ("ds7", "1", None, None, 31.0), ("ds7", "2", None, None, 32.0), ("ds004856", "1", "wave1", "F", 30.0), ("ds004856", "1", "wave3", "F", 38.5),
    }
    assert [(r["path"].split("/")[-2], r["reason"]) for r in rejects.collect()] == [("ds4", "line longer than header")]


def test_waves_keep_gaps_out(spark):
    df = spark.createDataFrame([(1, 10.0, None, 12.0), (2, None, None, None)], "sub int, a double, b double, c double")
    got = unpivot_waves(df, ["sub"], {"wave1": "a", "wave2": "b", "wave3": "c"}).collect()
    assert sorted(tuple(r) for r in got) == [(1, "wave1", 10.0), (1, "wave3", 12.0)]


def test_age_ranges(spark):
    df = spark.createDataFrame(
        [("d", "1", None, 10.0), ("d", "1", None, 12.5), ("d", "1", "a", 90.0), ("e", "2", None, None)],
        "dataset string, sub string, ses string, age double",
    )
    ranges = {(r["sub"], r["ses"]): r["range"] for r in group_range(df).collect()}
    assert ranges == {("1", None): 2.5, ("1", "a"): 0.0, ("2", None): None}
    checks = {r["dataset"]: (r["max_range"], r["large_age"]) for r in age_check(df).collect()}
    assert checks == {"d": (2.5, True), "e": (None, False)}


def test_repeated_lookup_key_is_an_error(spark):
    left = spark.createDataFrame([("1",)], "sub string")
    right = spark.createDataFrame([("1", "M"), ("1", "F")], "sub string, sex string")
    with pytest.raises(CohortDataError, match="duplicate key"):
        many_to_one(left, right, ["sub"])


def test_exclude_list(spark, tmp_path):
    path = tmp_path / "exclude.yaml"
    path.write_text("# header\n- ds000001\n- ds000002  # lesions\n\n  - 'ds3'\n")
    got = [tuple(r) for r in read_exclude(spark, str(path)).orderBy("dataset").collect()]
    assert got == [("ds000001", None), ("ds000002", "lesions"), ("ds3", None)]


def test_image_index_csv(spark, tmp_path):
    path = tmp_path / "index.csv"
    path.write_text(
        "dataset,sub,ses,acq,rec,ce,rez,echo,part,task,suffix,shape,pixdim,dtype,orient,size,md5,path\n"
        'ds1,01,,hi,,,,,,,T1w,"[2, 3, 4]","[1.0, 0.5, 2.0]",int16,RAS,10,abc,ds1/a\n'
        'ds1,02,,,,,,,,,T1w,"[2, 3, 4]","[1.0, nan, 2.0]",int16,RAS,10,,ds1/b\n'
    )
    rows = load_image_index(spark, str(path)).orderBy("sub").collect()
    assert rows[0]["sub"] == "01" and rows[0]["shape"] == [2, 3, 4] and rows[0]["pixdim"] == [1.0, 0.5, 2.0]
    other = tmp_path / "other.csv"
    other.write_text("dataset,sub,run,suffix,shape,pixdim,dtype,orient,size,md5,path\nds1,01,2,T1w,\"[2]\",\"[1.0]\",int16,RAS,10,abc,p\n")
    again = load_image_index(spark, str(other)).first()
    assert (again["run"], again["size"], again["shape"]) == ("2", 10, [2])
    assert rows[1]["pixdim"] is None and rows[1]["md5"] is None and "acq" not in rows[0]


def test_event_metadata(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text("id_event,age_open,sex,note\n HC1_V1 ,5,F,x\n,6,M,y\n0,1e3,M,\n")
    got = load_event_metadata(spark, str(path))
    assert sorted(r["id_event"] for r in got.collect()) == ["0", "HC1_V1"]
    typed = {r["id_event"]: r["age_open"] for r in typed_cells(got, ["age_open"]).collect()}
    assert typed["HC1_V1"]["as_int"] == 5 and typed["0"]["as_double"] == 1000.0
    path.write_text("id_event,sex\n7,F\n7 ,M\n")
    with pytest.raises(CohortDataError):
        load_event_metadata(spark, str(path))


def test_region_volume_files(spark, tmp_path):
    anat = tmp_path / "sub-1" / "ses-wave1" / "anat"
    anat.mkdir(parents=True)
    stem = "sub-1_ses-wave1_run-1_space-X_desc-preproc_T1w_desc-seg"
    (anat / f"{stem}_volumes.tsv").write_text("region\tvolume_mm3\ntotal intracranial\t10.5\nleft\t2\n")
    (anat / f"{stem}_qc.tsv").write_text("region\tqc_score\nleft\t0.7\n")
    (anat / "other_volumes.tsv").write_text("region\tvolume_mm3\nx\t1\n")
    volumes, qc = read_region_volumes(spark, str(tmp_path))
    assert {(r["pat_id"], r["region"], r["volume_mm3"]) for r in volumes.collect()} == {
        ("sub-1_ses-wave1_run-1_T1w", "total intracranial", 10.5), ("sub-1_ses-wave1_run-1_T1w", "left", 2.0),
    }
    assert qc.first()["qc_score"] == 0.7


def test_train_log(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "log.json").write_text('{"epoch": 0, "train/loss": 1.5}\n{"epoch": 1, "train/loss": 1.0, "eval/a/loss": 2}\n')
    from voxelherd.operators.meters import metric_log

    wide = read_train_log(spark, str(tmp_path / "run1" / "log.json"))
    got = {(r["run"], r["epoch"], r["metric"], r["value"]) for r in metric_log(wide).collect()}
    assert got == {("run1", 0, "train/loss", 1.5), ("run1", 1, "train/loss", 1.0), ("run1", 1, "eval/a/loss", 2.0)}
    assert wide.where(F.col("epoch") == 1).count() == 1
