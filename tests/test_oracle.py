"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

SF_DIR = os.environ.get("DOCFLOW_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query(spark, duck, key):
    status, *_, note = compare(spark, duck, SF_DIR, key, entry.queries()[key], entry.oracle_sql().get(key))
    assert status in ("ok", "rows"), f"{status} {note}"


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
