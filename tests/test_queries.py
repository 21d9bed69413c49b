"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as spark_entry  # noqa: E402
import check_queries  # noqa: E402
from corpus_spark.plans.catalogue import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_dir, name):
    good, note = check_queries.compare(spark, check_queries.connect(small_dir), small_dir, name)
    assert good, note


def test_every_query_has_sql():
    assert set(QUERIES) <= set(spark_entry.queries())
    assert set(QUERIES) <= set(spark_entry.oracle_sql())


def test_entry(spark, small_dir):
    assert spark_entry.entry(spark).count() == 4
