"""The driver contract: entry, queries and oracle SQL agree (sf0.001)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tests.conftest import SF_TINY
from tests.oracle_harness import compare, duck


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == [
        "category", "total_orders", "total_revenue", "avg_order_value", "total_units_sold"
    ]


CORE = sorted(set(entry_module.queries()) - set(entry_module.EXTRA_QUERIES))


def test_every_query_has_oracle():
    """All keys of the library itself; those of the optional subpackage are tested beside it."""
    sqls = entry_module.oracle_sql()
    assert set(sqls) <= set(entry_module.queries())
    assert set(CORE) <= set(sqls) and len(CORE) >= 62


@pytest.fixture(scope="module")
def con():
    return duck(SF_TINY)


@pytest.mark.parametrize("key", CORE)
def test_query_matches_oracle(spark, con, key):
    fn = entry_module.queries()[key]
    ok, n, _, detail = compare(spark, con, key, fn, entry_module.oracle_sql()[key], SF_TINY)
    assert ok, detail


def test_a_package_that_the_optional_queries_need_may_be_absent():
    """Without ``zstandard`` the library's own keys stay, with a warning that names what is missing."""
    import subprocess
    import sys

    code = (
        "import sys, warnings; sys.modules['zstandard'] = None\n"
        "with warnings.catch_warnings(record=True) as said:\n"
        "    warnings.simplefilter('always')\n"
        "    import __spark_entry__ as e\n"
        "print(len(e.queries()), len(e.oracle_sql()), [str(w.message) for w in said if 'zstandard' in str(w.message)] != [])\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=entry_module.__file__.rsplit("/", 1)[0])
    n, m, warned = out.stdout.split()
    assert int(n) == int(m) == len(CORE) and (warned == "True" or not entry_module.EXTRA_QUERIES)
