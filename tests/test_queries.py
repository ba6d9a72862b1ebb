"""Every registered query against its SQL on the smallest tables (CURVEKIT_ONLY=prefix,prefix limits the run)."""
import os

import pytest
from compare import check, oracle

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ONLY = tuple(p for p in os.environ.get("CURVEKIT_ONLY", "").split(",") if p)
NAMES = [n for n in entry.queries() if not ONLY or n.startswith(ONLY)]


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    note, _, ok = check(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok or note in ("same 0", "rows 0"), note


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
