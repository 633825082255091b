import glob
import os

import duckdb
import pytest

from voxelherd.plans.catalog import ORACLES, QUERIES

import __spark_entry__ as entry_module
from tests.compare import differences


@pytest.fixture(scope="module")
def connection(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, connection, name):
    assert differences(QUERIES[name](spark, folder), connection, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["dataset", "n_images", "n_subs", "frac_labeled", "im_per_sub"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["stream_index", "stream_meters", "stream_window"])
def test_streams_of_tables_in_parts(spark, folder, connection, name, tmp_path):
    """A table may be a folder of Parquet files."""
    for table in ("documents", "events"):
        spark.read.parquet(f"{folder}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    assert differences(QUERIES[name](spark, str(tmp_path)), connection, ORACLES[name]) is None
