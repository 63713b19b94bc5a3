"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import canon, duck  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

from fundlens.plans.oracle import oracles  # noqa: E402
from fundlens.plans.registry import registry  # noqa: E402

QUERIES = registry()
ORACLES = oracles()


# without SQL: an iterative fit (held against numpy in test_operators), and every title against every word, too
# slow in SQL on whole tables (held against brute force in test_profile_changes)
BRUTE = {"forecast_changepoints", "keyword_reconcile_all"}


def test_every_query_has_an_oracle():
    assert sorted(set(QUERIES) - BRUTE) == sorted(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["code", "name", "total_funding", "avg_funding", "project_count"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert canon(sdf.columns, srows) == canon(dcols, drows)
