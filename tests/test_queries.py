"""Every registered query against its SQL, on the smallest data."""

import os

import pytest

import __spark_entry__ as entry_points
import check

SF_DIR = os.environ.get("QUIRE_TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", entry_points.queries())
def test_query_matches_its_sql(spark, name):
    verdict = check.compare(spark, SF_DIR, name)
    assert verdict.startswith(("match", "rows-only")), verdict


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
