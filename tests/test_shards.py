"""The shard writer's two phases: attempts, commit and abort."""

import tarfile

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from voxelherd.session import ship_package
from voxelherd.sources.shards import SAMPLE_SCHEMA, ShardSource, ShardWriter


def batch(name, keys, value=1.0):
    return pa.RecordBatch.from_pydict({
        "name": [name] * len(keys), "key": keys, "image": pa.array([[value] * 8] * len(keys), pa.list_(pa.float32())),
        "mask": pa.array([[1] * 8] * len(keys), pa.list_(pa.int8())), "shape": pa.array([[2, 2, 2]] * len(keys), pa.list_(pa.int32())),
        "meta": ['{"a": 1}'] * len(keys),
    })


def members(path):
    with tarfile.open(path) as tar:
        return [n.removesuffix(".meta.json") for n in tar.getnames() if n.endswith(".meta.json")]


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*")) if folder.exists() else []


def test_two_attempts_of_one_task_do_not_meet(tmp_path):
    """A second attempt writes the same shard while the first is open; either may be committed."""
    for chosen in (0, 1):
        root = tmp_path / f"r{chosen}"
        writer = ShardWriter(str(root), False, None)
        second = []

        def slow():
            yield batch("s-0.tar", ["a", "b"])
            second.append(writer.write(iter([batch("s-0.tar", ["a", "b", "c"]), batch("s-1.tar", ["d"])])))
            yield batch("s-0.tar", ["c"])
            yield batch("s-1.tar", ["d"])

        first = writer.write(slow())
        assert not list(root.glob("*.tar"))
        writer.commit([[first, second[0]][chosen], None])
        assert names(root) == ["s-0.tar", "s-1.tar"]
        assert members(root / "s-0.tar") == ["a", "b", "c"] and members(root / "s-1.tar") == ["d"]


def test_abort_leaves_nothing_and_keeps_the_earlier_run(tmp_path):
    root = tmp_path / "r"
    old = ShardWriter(str(root), False, None)
    old.commit([old.write(iter([batch("s-0.tar", ["old"]), batch("s-9.tar", ["old"])]))])
    writer = ShardWriter(str(root), True, None)
    done = writer.write(iter([batch("s-0.tar", ["new"])]))

    def broken():
        yield batch("s-1.tar", ["x"])
        raise OSError("disk")

    with pytest.raises(OSError):
        writer.write(broken())
    assert len(names(root)) > 2
    writer.abort([done, None])
    assert names(root) == ["s-0.tar", "s-9.tar"] and members(root / "s-0.tar") == ["old"]
    again = ShardWriter(str(root), True, None)
    again.commit([again.write(iter([batch("s-0.tar", ["new"])])), again.write(iter([]))])
    assert names(root) == ["s-0.tar"] and members(root / "s-0.tar") == ["new"]


def test_commit_refuses_split_shards_and_full_folders(tmp_path):
    root = tmp_path / "r"
    writer = ShardWriter(str(root), False, None)
    parts = [writer.write(iter([batch("s-0.tar", ["a"])])), writer.write(iter([batch("s-0.tar", ["b"])]))]
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit(parts)
    writer.commit(parts[:1])
    late = ShardWriter(str(root), False, None)
    with pytest.raises(FileExistsError):
        late.commit([late.write(iter([batch("s-1.tar", ["b"])]))])


def test_a_failing_task_fails_the_job_and_leaves_nothing(spark, tmp_path):
    ship_package(spark)
    spark.dataSource.register(ShardSource)
    rows = [("s-0.tar", "a", [1.0], [1], [1], "{}"), ("s-1.tar", "b", [1.0], [1], [1], "not json")]
    df = spark.createDataFrame(rows, SAMPLE_SCHEMA).repartition(2, "name").sortWithinPartitions("name")
    with pytest.raises(PySparkException):
        df.write.format("voxelherd_shards").mode("append").save(str(tmp_path / "out"))
    assert names(tmp_path / "out") == []
    good = df.where("key = 'a'").write.format("voxelherd_shards").mode("append").option("manifest", str(tmp_path / "m"))
    good.save(str(tmp_path / "out"))
    assert names(tmp_path / "out") == ["s-0.tar"]
    assert [tuple(r)[1:] for r in spark.read.schema("path string, n_samples long, bytes long").json(str(tmp_path / "m")).collect()] == [
        (1, (tmp_path / "out" / "s-0.tar").stat().st_size)
    ]
