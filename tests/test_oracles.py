"""Every named query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def con(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, folder, name):
    df = queries()[name](spark, folder)
    if name in oracle_sql():
        assert check.compare(df, con, oracle_sql()[name]) == ""
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1
