"""Every query that has SQL gives exactly the rows the SQL gives."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    problems = oracle.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert not problems, "\n".join(problems)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
