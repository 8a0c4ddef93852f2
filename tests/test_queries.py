"""Registered queries against their SQL counterpart (a quick part of them; all: check_queries.py)."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import compare

import __spark_entry__ as entry
from lotledger.plans.catalog import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "filter_all_criteria", "market_facets", "market_summary", "market_summary_of_nothing", "price_history",
    "price_trend_by_make", "lots_page_by_price_desc", "upsert_lots", "source_health", "request_fingerprints",
    "enqueue_targets", "page_visible_text",
]
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")


def test_every_query_has_sql():
    assert all_queries().keys() == all_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER) == []


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "month" and df.count() > 0
