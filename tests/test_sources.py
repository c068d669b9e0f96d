"""Documents, archives and names as other programs leave them."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.functions.text import unescape_name
from foliant.operators import skew
from foliant.session import scratch
from foliant.sources import readers
from foliant.streaming import ingest


def document(n, pages):
    return {"pdf_path": f"a/scan_{n}.pdf", "pages": [{"page_number": i, "status": "OK", "fields": [{"field_id": "day", "value": "1"}]} for i in range(pages)]}


@pytest.mark.parametrize("indent", [None, 2])
def test_documents_and_broken_ones(spark, tmp_path, indent):
    for n in range(3):
        (tmp_path / f"{n}.json").write_text(json.dumps(document(n, 3 + n), indent=indent))
    (tmp_path / "9.json").write_text('{"pdf_path": "b", "pages": [')
    reports = readers.read_run_json(spark, str(tmp_path), None if indent is None else True)
    assert sorted((r.pdf_path, len(r.pages)) for r in reports.collect()) == [(f"a/scan_{n}.pdf", 3 + n) for n in range(3)]
    bad = readers.unreadable_reports(spark, str(tmp_path), bool(indent)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["9.json"]


def test_a_long_file_is_one_report(spark):
    from foliant.sources.writers import write_run_json

    reading = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("value", "raw_value")])
    pages = spark.range(12_000).select(F.lit(0).alias("file_seq"), F.lit("a/x.pdf").alias("file"), F.col("id").alias("page_number"), F.lit("OK").alias("status"), F.lit(False).alias("blank"),
                                       F.lit("ok").alias("alignment"), F.lit(1.0).alias("processing_ms"), F.lit(None).cast("string").alias("date"), reading.alias("day"))
    path = scratch(spark, "json")
    write_run_json(pages, ["day"], path)
    back = readers.read_run_pages(spark, path)
    assert back.count() == 12_000 and back.select("path").distinct().count() == 1
    header = spark.read.json(f"{path}/headers").collect()
    assert len(header) == 1 and header[0].page_count == 12_000


def test_salts_grow_with_a_key(hot):
    """A key with a third of the rows gets a salt for every 20 of them."""
    rows = hot.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = skew.join_groups(rows, groups, ["k"], ["id"])
    assert joined.count() == 3000 and joined.where("k = -1").select("n").distinct().first().n == 1000
    plan = joined._jdf.queryExecution().toString()
    assert "_salts" in plan and "Limit" not in plan


def test_names(spark):
    names = {"Espa&ntilde;a &#x1F600; &#233;&#x41;": "España 😀 éA", "a&nbsp;b &amp;lt;": "a b &lt;", "&#9999999;": "�", "&#0;x": "�x"}
    got = spark.createDataFrame([(k,) for k in names], "v string").select("v", unescape_name(F.col("v")).alias("u")).collect()
    assert {r.v: r.u for r in got} == names


def test_only_committed_files_move(spark):
    source, table, state, archive = (scratch(spark, n) for n in ("arrivals", "table", "state", "archive"))
    schema = "log_number struct<value:string>, page_number long"
    spark.createDataFrame([(("2000001",), 1)], schema).write.parquet(source)
    ingest.ingest_stream(ingest.page_stream(spark, source, schema), table, state).awaitTermination()
    spark.createDataFrame([(("2000002",), 2)], schema).write.mode("append").parquet(source)
    assert ingest.archive_committed(spark, table, source, archive) == []
    assert [r.page_number for r in spark.read.schema(schema).parquet(archive).collect()] == [1]
    assert [r.page_number for r in spark.read.schema(schema).parquet(source).collect()] == [2]
