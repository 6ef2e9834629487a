"""Every registered query against its reference SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from check_oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry_gives_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["doc_id", "mapping_id", "redacted"] and df.count() > 0


def test_every_reference_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_equals_reference(spark, con, name):
    assert differences(spark, con, FOLDER, name) is None
