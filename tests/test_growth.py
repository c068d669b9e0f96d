"""Tasks, files and bytes follow the rows."""

import os

from pyspark.sql import functions as F

from foliant.operators import segments
from foliant.plans import derived
from foliant.sources import readers, writers
from foliant.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def files(path, suffix):
    return [os.path.join(r, n) for r, _, names in os.walk(path) for n in names if n.endswith(suffix)]


def test_segments_are_not_tasks(hot, monkeypatch):
    kind, asked = type(hot.range(1)), []
    plain = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *by: asked.append(n) or plain(self, n, *by))
    cut = segments.segmented(hot.range(2000).select(F.lit("g").alias("g"), F.col("id").alias("o")), "g", ["o"])
    got = cut.rows.groupBy("_seg").agg(F.count("*").alias("n"), F.min("o").alias("a"), F.max("o").alias("z")).orderBy("_seg").collect()
    assert cut.cut and sum(r.n for r in got) == 2000 and max(r.n for r in got) <= 20 and got[0]["_seg"] > 0
    assert all(x.z < y.a for x, y in zip(got, got[1:]))
    assert asked and max(asked) <= 4


def test_derived_pages_have_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(derived, "TASK_ROWS", 100)
    assert derived.pages(spark, FOLDER).rdd.getNumPartitions() >= 15


def test_run_json_is_compressed_and_read_back(spark, tmp_path):
    pages = derived.pages(spark, FOLDER)
    for kind in ("gzip", "none"):
        writers.write_run_json(pages, derived.PAGE_FIELDS, str(tmp_path / kind), compression=kind)
    writers.write_run_json(pages, derived.PAGE_FIELDS, str(tmp_path / "default"))
    size = {k: sum(map(os.path.getsize, files(tmp_path / k / "pages", (".json", ".json.gz")))) for k in ("gzip", "none", "default")}
    assert size["default"] == size["gzip"] < size["none"] / 5
    a, b = (sorted(map(str, readers.read_run_pages(spark, str(tmp_path / k)).collect())) for k in ("gzip", "none"))
    assert a == b and len(a) == pages.count()


def test_a_batch_leaves_one_file_in_a_series(spark, tmp_path):
    pages = derived.pages(spark, FOLDER)
    pages.repartition(7).write.parquet(str(tmp_path / "in"))
    ingest.ingest_stream(ingest.page_stream(spark, str(tmp_path / "in"), pages.schema), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    for series in os.listdir(tmp_path / "table"):
        if series.startswith("series=") and series != "series=none":
            assert len(files(tmp_path / "table" / series, ".parquet")) == 1
    assert spark.read.parquet(str(tmp_path / "table")).count() == pages.count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_sort_once_and_number_without_gaps(spark):
    from foliant.operators.skew import positions

    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("o"), F.lit(None).alias("nothing"))
    got = positions(rows, ["o"], "n", start=3)
    assert "row_number" not in plan_of(got)
    assert [tuple(r) for r in got.select("o", "n").orderBy("o").collect()] == [(i, i + 3) for i in range(5000)]
    assert positions(rows.where("o < 0"), ["o"]).count() == 0


def test_only_repeated_numbers_are_joined(spark, monkeypatch):
    from foliant.operators import books, reconcile

    sizes, plain = [], books.join_groups

    def join(rows, groups, *rest, **options):
        sizes.append(groups.count())
        return plain(rows, groups, *rest, **options)

    monkeypatch.setattr(books, "join_groups", join)
    monkeypatch.setattr(reconcile, "join_groups", join)
    values = [(0, i, str(1000000 + i % 97), None) for i in range(1, 101)] + [(0, 101, None, None)]
    pages = spark.createDataFrame(values, "file_seq int, page_number long, v string, printed_number long").withColumn("log_number", F.struct(F.col("v").alias("value")))
    assert {r.page_number for r in books.mark_duplicates(pages).where("dup").collect()} == {98, 99, 100}
    records = spark.createDataFrame([(i, "", str(i % 97)) for i in range(1, 101)] + [(101, "", ""), (102, "", ""), (103, "S", "5")], "seq long, separator string, log_number string")
    found = reconcile.check_record_duplicates(records).collect()
    assert sorted((r.seq, r.detail) for r in found) == [(i, f"el log {i - 97} ya salio en la pagina {i - 97}") for i in (98, 99, 100)]
    assert sizes == [3, 3]


def test_flags_are_those_of_the_findings(spark):
    from foliant.operators import quality

    pages = derived.pages(spark, FOLDER)
    both = quality.discrepancy_flags(quality.with_findings(pages).drop("discrepancy"))
    assert both.where(F.col("discrepancy") != (F.size("findings") > 0)).count() == 0 and both.where("discrepancy").count() > 0
    assert "findings" not in quality.discrepancy_flags(pages).columns


def test_pages_are_validated_where_they_are(spark):
    from catalog.pages import template_table
    from foliant.operators import quality

    pages = derived.pages(spark, FOLDER)
    fields = derived.PAGE_FIELDS
    gone = pages.limit(1).select([F.lit(None).cast(pages.schema[c].dataType).alias(c) if c in fields else c for c in pages.columns])
    done = quality.validate_pages(pages.unionByName(gone), fields, template_table(spark))
    assert done.count() == pages.count() + 1
    ruled = quality.validate_pages(pages, fields, template_table(spark))
    assert "hashpartitioning(file_seq" not in plan_of(ruled)
    long = quality.to_pages(quality.apply_field_rules(quality.to_readings(pages, fields), template_table(spark)), fields)
    assert sorted(map(str, ruled.select(*fields).collect())) == sorted(map(str, long.select(*fields).collect()))


def test_report_rows_are_derived_once(spark):
    from catalog.batches import report_rows

    assert "orders.parquet" not in plan_of(report_rows(spark, FOLDER))


def test_the_primary_reading_carries_what_it_uses(spark):
    from foliant.operators import quality
    from __spark_entry__ import load_catalog

    plan = plan_of(load_catalog()["accept_primary_reading"].build(spark, FOLDER))
    assert "explode" in plan and "Low confidence" not in plan
    pages = derived.pages(spark, FOLDER)
    whole = quality.to_readings(pages, list(derived.PAGE_FIELDS))
    assert whole.select("page_number", "field_id", "raw_value").exceptAll(
        quality.to_readings(pages, list(derived.PAGE_FIELDS), ["raw_value"]).select("page_number", "field_id", "raw_value")).count() == 0
