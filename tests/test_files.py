"""Names, archives and exports on small files."""

import html
import html.entities
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from foliant.functions.text import unescape_name
from foliant.sources.writers import write_grouped
from foliant.streaming.ingest import archive_committed


def test_every_html_name(spark):
    names = [f"a&{n}b" for n in html.entities.html5] + ["&#243;n", "&#xF3;", "&#128;", "&#0;", "&#x110000;", "&notit;", "&amp;lt;", "& plain", "", None]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").select("i", unescape_name(F.col("name")).alias("plain")).collect()
    assert {r.i: r.plain for r in got} == {i: html.unescape(n or "").strip(" ") for i, n in enumerate(names)}


def test_archive_keeps_earlier_files_of_a_name(spark, tmp_path):
    source, archive, table = (str(tmp_path / n) for n in ("source", "archive", "table"))
    for _ in range(3):
        os.makedirs(source, exist_ok=True)
        with open(f"{source}/pages.one.txt", "w") as f:
            f.write("x")
        spark.createDataFrame([(f"file:{source}/pages.one.txt",)], "arrived_from string").write.mode("append").parquet(table)
        assert archive_committed(spark, table, source, archive) == []
    assert sorted(n for n in os.listdir(archive) if not n.startswith(".")) == ["pages.one-2.txt", "pages.one-3.txt", "pages.one.txt"]


def test_exports_at_once_get_numbers_of_their_own(spark, tmp_path):
    path = str(tmp_path / "export")
    rows = spark.range(20).select("id", (F.col("id") % 3).cast("string").alias("output"))
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda _: write_grouped(rows, path), range(4)))
    assert sorted(numbers) == [1, 2, 3, 4] and write_grouped(rows, path) == 5
    assert {r.export_no: r["count"] for r in spark.read.parquet(path).groupBy("export_no").count().collect()} == dict.fromkeys(range(1, 6), 20)
