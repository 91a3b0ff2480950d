"""Every registered query against its oracle."""

import pytest

from metasift.plans import load_all
from tests.harness import compare

ENTRIES = load_all()


@pytest.mark.parametrize("key", list(ENTRIES))
def test_query(spark, con, sf, key):
    err = compare(spark, con, ENTRIES[key], sf)
    assert err is None or err == "oracle returned no rows", err


def test_contract():
    import __spark_entry__ as contract

    q, o = contract.queries(), contract.oracle_sql()
    assert set(o) <= set(q)
    assert set(ENTRIES) <= set(q)
    assert set(ENTRIES) - set(o) == {"sample_percent", "dq_distinct_count_approx"}


def test_entry(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert rows and {r.category for r in rows} == {"framework", "source", "ingestion", "dq_rules"}
