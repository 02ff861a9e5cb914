"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    status, n, note = check.compare(spark, con, name, SF)
    assert status in ("ok", "rows-only"), note
