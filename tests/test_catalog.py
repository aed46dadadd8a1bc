"""Every registered query beside its SQL on DuckDB, at the smallest scale."""

import pytest

from tests.conftest import SF
from tools.check import compare, connect
from vigilgrid.catalog import load

ENTRIES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql is not None))
def test_matches_sql(spark, con, name):
    entry = ENTRIES[name]
    verdict, _ = compare(entry.run(spark, SF), con, entry.sql)
    assert verdict == "ok"


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql is None))
def test_runs(spark, name):
    assert ENTRIES[name].run(spark, SF).count() >= 0


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    covered = {i for e in ENTRIES.values() for i in e.ids}
    assert {"A1", "J13", "T14", "V19", "G10", "D5", "E4", "S12", "R3"} <= covered


def test_bucketed_tables_join_without_exchange(spark):
    plan = ENTRIES["bucketed_hits"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@pytest.mark.parametrize("name, most", [("linked_by_overlap", 4), ("linked_two_stage", 5), ("track_lifecycles", 4)])
def test_last_plan_reads_little(spark, name, most):
    plan = ENTRIES[name].run(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") <= most
