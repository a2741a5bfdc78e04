"""Each registered query of the catalogue against its SQL twin."""

from __future__ import annotations

import pytest
from helpers import SF, compare

from agendry import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()


#: Characters of an analyzed plan: rules that repeat what they read grow past this, and then plans fill the driver's heap.
PLAN = 200_000


def bounded(df):
    size = len(df._jdf.queryExecution().analyzed().toString())
    assert size < PLAN, size
    return df


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    compare(bounded(QUERIES[name](spark, SF)), duck, SQL[name])


# These have tests of their own in test_listing_rules.py.
TESTED = {"reconcile_twice", "ingest_cycle", "stream_ingest"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - TESTED))
def test_runs(spark, name):
    assert bounded(QUERIES[name](spark, SF)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
