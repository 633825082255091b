"""The documented flow on a small tree of files, started from another folder."""

import gzip
import os
import subprocess
import sys
import textwrap

from tests.test_images import header
from voxelherd.operators.curation import Bounds, coverage, dataset_overview, final_counts
from voxelherd.operators.participants import load_participants
from voxelherd.plans.curate import curate
from voxelherd.sources import sinks
from voxelherd.sources.images import index_images
from voxelherd.sources.tables import load_image_index, read_exclude, read_participants, read_sidecar_units


def test_index_to_include_list(spark, tmp_path):
    root = tmp_path / "data"

    def put(path, data):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)

    fine = header((200, 200, 200), (1.0, 1.0, 1.0))
    put("ds1/sub-1/anat/sub-1_T1w.nii", fine + b"a" * 2000)
    put("ds1/sub-1/anat/sub-1_T2w.nii", fine + b"b" * 2000)
    put("ds1/sub-2/anat/sub-2_T1w.nii", fine + b"a" * 2000)
    put("ds1/sub-3/anat/sub-3_T1w.nii", header((200, 200, 200), (2.0, 1.0, 1.0)) + b"c" * 2000)
    put("ds1/sub-4/anat/sub-4_PDw.nii", fine + b"d" * 2000)
    put("ds2/sub-1/anat/sub-1_FLAIR.nii.gz", gzip.compress(fine + os.urandom(2000)))
    put("ds3/sub-1/anat/sub-1_T1w.nii", fine + b"e" * 2000)
    put("ds1/participants.tsv", b"participant_id\tsex\tage\tsession_id\nsub-1\tM\t30\tses-2\nsub-1\tF\t28\tses-1\nsub-2\tF\t40\tses-1\n")
    put("ds2/participants.tsv", b"participant_id\tsex\nsub-1\tf\n")
    (tmp_path / "exclude.yaml").write_text("- ds3  # lesions\n")

    images, _ = index_images(spark, str(root))
    images = images.withColumn("sub", images.entities["sub"])
    rows, _ = read_participants(spark, str(root))
    people = load_participants(rows, units=read_sidecar_units(spark, str(root)))
    found = curate(images, people, read_exclude(spark, str(tmp_path / "exclude.yaml")), Bounds(size_low=0.001))
    kept = {r["path"]: (r["sex"], r["age"]) for r in found.joined.collect()}
    assert kept == {
        "ds1/sub-1/anat/sub-1_T1w.nii": ("M", 30.0), "ds1/sub-1/anat/sub-1_T2w.nii": ("M", 30.0),
        "ds2/sub-1/anat/sub-1_FLAIR.nii.gz": ("F", None),
    }
    assert coverage(found.joined).first()["n_age"] == 2
    over = {r["dataset"]: (r["n_images"], r["n_subs"], r["frac_labeled"], r["im_per_sub"]) for r in dataset_overview(found.joined).collect()}
    assert over == {"ds1": (2, 1, 1.0, 2.0), "ds2": (1, 1, 0.0, 1.0)}
    assert final_counts(found.images).first().asDict() == {"datasets": 2, "subjects": 2, "images": 3, "T1w": 1, "T2w": 1, "FLAIR": 1}
    sinks.write_file_list(found.images, str(tmp_path / "include"))
    listed = "".join(p.read_text() for p in (tmp_path / "include").glob("*.txt")).split()
    assert sorted(listed) == sorted(kept)
    sinks.write_csv(sinks.index_columns(images, ["sub", "ses", "acq", "rec", "ce", "rez", "echo", "part", "task"]), str(tmp_path / "index"))
    again = load_image_index(spark, str(tmp_path / "index"))
    assert again.count() == images.count() and again.where("size(shape) = 3").count() == images.count()


def test_workers_find_the_package_from_any_folder(tmp_path, folder):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {repo!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        import __spark_entry__ as e
        print("rows", e.queries()["patch_valid"](spark, {folder!r}).count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
