"""Every registered query against its DuckDB oracle (rows-only when it has none)."""

import numpy as np
import pytest

from tests.conftest import SF_SMALL

from prismlake.plans.catalog import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    from tools.check_oracle import duck
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    from tools.check_oracle import compare
    q = QUERIES[name]
    got = q.spark(spark, SF_SMALL).toPandas()
    sql = q.oracle()
    if sql is None:
        assert len(got) > 0
        for c in got.columns:                                   # no column is all null, no number is infinite
            assert got[c].notna().any(), c
            if got[c].dtype.kind == "f":
                assert not np.isinf(got[c]).any(), c
        return
    want = con.execute(sql).df()
    assert compare(got, want) == "ok"


def test_entry_contract(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.count() > 0
