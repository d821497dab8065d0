"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

OWN = sorted(set(entries.oracle_sql()) - (set(entries.training_data.QUERIES) | {"pipeline"} if entries.training_data else set()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    extra = set(entries.training_data.QUERIES) | {"pipeline"} if entries.training_data else set()
    assert set(entries.queries()) - extra == set(entries.oracle_sql()) - extra


def test_flagship(spark):
    assert {r.ucc for r in entries.entry(spark).collect()} >= {"o_orderkey"}


@pytest.mark.parametrize("name", OWN)
def test_same_rows(spark, duck, name):
    df = entries.queries()[name](spark, DATA)
    names = sorted(df.columns)
    result = duck.execute(entries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    expected = [tuple(dict(zip(columns, row))[c] for c in names) for row in result.fetchall()]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(expected, key=repr)


def test_nothing_stays_in_memory(spark):
    entries.queries()["minimal_uccs_part"](spark, DATA)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    entries.queries()["minimal_uccs_orders"](spark, DATA)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def files_below(folder):
    return sum(len(names) for _, _, names in os.walk(folder))


def test_finished_queries_leave_no_files(spark, monkeypatch):
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    folder = folder.removeprefix("file:")
    names = ["minimal_uccs_orders_small_sample", "minimal_uccs_orders_dual", "delimited_text_medians", "selection_nan", "ragged_text_uniqueness"]
    before = files_below(folder)
    for name in names:
        entries.queries()[name](spark, DATA).collect()
        assert files_below(folder) <= before, name
    # Also where a search ends with an error.
    from solekey.plans import search

    monkeypatch.setattr(search._Search, "_candidates", lambda self, level: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        entries.queries()["minimal_uccs_orders_small_sample"](spark, DATA)
    assert files_below(folder) <= before
