"""Every registered query against its check SQL on the smallest test data."""

import os

import pytest

from tests.parity import difference, duck
from tidemark.registry import entries

FOLDER = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entries()))
def test_query_matches_check(spark, con, name):
    problem, _ = difference(spark, con, entries()[name], FOLDER)
    assert problem is None, problem


def test_every_query_has_a_check():
    assert [n for n, e in entries().items() if e.check_sql is None] == []
