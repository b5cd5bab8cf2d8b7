"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, duck

from rivulant.workload import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    _, issues = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert not issues


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    rows = {r.risk_level: r.n_docs for r in contract.entry(spark).collect()}
    assert set(rows) == {"green", "yellow", "red"}


def test_keys_agree():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name, table", [("T3_stream_rule_counts", "documents"), ("T4_stream_events", "events")])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name, table):
    spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = lambda sf: sorted(map(tuple, all_queries()[name](spark, sf).collect()))
    assert rows(str(tmp_path)) == rows(SF) != []
