"""Every registered query against its SQL at the smallest scale, and its plan against the banned operators."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import canonical

from .conftest import plan_of

SF = "/root/testdata/sf0.001"
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval")

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def test_every_query_has_sql():
    assert set(entry._ALL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry._ALL))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = plan_of(df)
    assert not [operator for operator in BANNED if operator in plan]
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", ["profile_columns", "validate_unique", "validate_report"])
def test_distinct_counts_do_not_copy_rows(spark, name):
    """One copy of a row per column is fine as a stacked table, not as Spark's expansion of distinct aggregates."""
    plan = plan_of(entry.queries()[name](spark, SF))
    assert not any(line.strip(" +-:").startswith("Expand") and "grouping" not in line and "gid" in line for line in plan.splitlines())
