"""Registered queries against their SQL on the smallest given tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

SQL = entry.oracle_sql()
# One query per family here; tools/compare.py runs them all.
NAMES = [
    "flagship", "read_events", "label_last_cart", "assemble_features_v2", "assemble_as_of",
    "split_with_coverage", "apply_target_encoder", "heuristic_contributions", "cohort_breakdown",
    "binary_metrics", "numeric_distribution", "stream_cart_label",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("the given tables are not here")
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    _rows, difference = compare.difference(spark, con, name, entry.queries()[name], SQL[name], SF_DIR)
    assert difference is None


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_known_counts_of_the_mapped_log(spark, con):
    from funnelspark.plans import tables

    if not SF_DIR.endswith("sf0.001"):
        pytest.skip("counts are for the smallest tables")
    samples = tables.samples(spark, SF_DIR)
    assert tables.raw(spark, SF_DIR).count() == 1020
    assert tables.clean(spark, SF_DIR).count() == 990
    assert samples.count() == 207
    assert samples.filter("is_purchased = 1").count() == 28
