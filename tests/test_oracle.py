"""Every core query with SQL gives the same rows as the SQL; the others give rows of a stable schema."""

import pytest
from oracle import connect, differences

from answerforge.plans import load_queries
from answerforge.session import temporary_tables

QUERIES, ORACLES = load_queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, sf, name):
    with temporary_tables(spark):
        assert differences(spark, con, sf, QUERIES[name], ORACLES[name]) is None
    assert con.execute(f"select count(*) from ({ORACLES[name]})").fetchone()[0] > 0, "nothing is compared"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    with temporary_tables(spark):
        df = QUERIES[name](spark, sf)
        assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
