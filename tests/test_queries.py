"""Every registered query against its SQL over the whole small tables."""

import os

import pytest

import __spark_entry__ as spark_entry
from pagemill.plans import compare, group_a, group_b, group_c, group_d, group_e, group_f

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


# The optional subpackage has tests of its own.
OWN = sorted({n for g in (group_a, group_b, group_c, group_d, group_e, group_f) for n in g.QUERIES})


# Held against brute force in tests of their own.
NO_SQL = {"c5_fold_routes_lru"}


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    result = spark_entry.queries()[name](spark, SF_DIR)
    if name in NO_SQL:
        assert result.count() > 0
        return
    assert compare.difference(result, con, spark_entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["verdict", "pages", "text_chars"]
