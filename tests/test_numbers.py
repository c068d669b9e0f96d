"""Log numbers past 9,999,999, of which the seven-digit text holds the beginning only."""

import shutil

import pytest
from pyspark.sql import functions as F

from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
# Orders whose log numbers go from 9,999,7xx to 10,000,6xx.
SHIFT = 6_399_000
NAMES = ["group_books", "mark_duplicates", "duplicate_groups", "book_vote", "book_vote_isolated", "cell_status", "classify_discrepancies", "sort_discrepancies", "review_pages",
         "infer_between_anchors_month", "infer_between_anchors_year", "infer_edges_month", "infer_edges_year", "correct_dates", "records_from_csv", "records_from_csv_ordered", "records_from_delivery"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("numbers")
    shutil.copytree(FOLDER, path, dirs_exist_ok=True)
    (path / "orders.parquet").unlink()
    spark.read.parquet(f"{FOLDER}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + SHIFT).toPandas().to_parquet(path / "orders.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql_past_seven_digits(spark, folder, name):
    from __spark_entry__ import load_catalog

    ok, message, _ = compare(spark, connect(folder), folder, name, load_catalog()[name])
    assert ok, message


def test_a_replaced_text_outranks_the_number_it_replaces(spark):
    from foliant.functions.fields import log_number

    df = spark.sql("SELECT * FROM VALUES (1, named_struct('value', '1000031'), 10000318L), (2, named_struct('value', '2000007'), 10000318L), (3, named_struct('value', '2000007'), NULL), (4, named_struct('value', 'x'), 10000318L) t(id, log_number, printed_number)")
    assert {r.id: r.n for r in df.select("id", log_number(df.columns).alias("n")).collect()} == {1: 10000318, 2: 2000007, 3: 2000007, 4: None}
