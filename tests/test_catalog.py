"""A cross-section of the registered queries against their SQL (tests/compare.py runs them all)."""

import pytest

from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = ["book_vote", "counts_after_vote", "nearest_fleet_match", "classify_discrepancies", "infer_between_anchors_month", "fill_missing_day", "wide_page_rows",
         "split_parts", "stabilise_transforms", "plan_pages", "match_batches", "tune_thresholds", "cross_validate", "decode_month_slots", "read_run_json", "ingest_stream"]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    from __spark_entry__ import load_catalog

    ok, message, _ = compare(spark, duck, FOLDER, name, load_catalog()[name])
    assert ok, message


def test_every_query_has_a_name_on_both_sides():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
