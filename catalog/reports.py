"""Wide rows, searches, statistics, samples and the ordered delivery."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from catalog.pages import DISCREPANCIES, FIELDS, MONTH_KEY, template_table
from catalog.registry import register
from catalog.tables import PAGES
from foliant.functions import dates as T
from foliant.operators import delivery as V
from foliant.operators import quality as Q
from foliant.operators import reports as R
from foliant.operators import sampling as P
from foliant.plans import derived as D
from foliant.session import scratch
from foliant.sources import writers as W

ID = ["file_seq", "page_number"]


def files(spark, folder):
    """One row per file with a start stamp and a clock, from its pages."""
    return D.pages(spark, folder).groupBy("file_seq", "file").agg(
        F.count("*").alias("pages"), (F.col("file_seq") * 1000 + 50.0).alias("started_at"), (F.sum("processing_ms") / 4.0).alias("processing_ms"))


FILES = PAGES + """
files AS (SELECT file_seq, file, count(*) AS pages, file_seq * 1000 + 50.0::DOUBLE AS started_at, sum(processing_ms) / 4.0 AS processing_ms FROM pages GROUP BY ALL),
"""
WIDE = DISCREPANCIES + """
rows AS (SELECT p.*, log_no IS NOT NULL AND row_number() OVER (PARTITION BY log_no ORDER BY file_seq, page_number) > 1 AS dup, k IN (SELECT k FROM found) AS disc,
  month_n IS NOT NULL AND year_n IS NOT NULL AS ok, day(last_day(make_date(2000 + year_n, month_n, 1))) AS last FROM pages p),
wide AS (SELECT *, ok AND (day IS NULL OR day_n > last) AS moved FROM rows),
"""
OLD = "CASE {0}_status WHEN 'ERROR' THEN 'Required field empty' WHEN 'WARNING' THEN 'Low confidence (' || printf('%.2f', {1}) || ')' ELSE 'OK' END"


def wide_sql(chosen: str, moved: str, reason: str) -> str:
    return f"""SELECT file, page_number AS page, coalesce(log, '') AS log_number, CAST(dup AS VARCHAR) AS dup, CAST(disc AS VARCHAR) AS disc, c0 AS log_number_conf, log_status AS log_number_status,
  coalesce(matricula, '') AS matricula, matricula_status, CASE WHEN {moved} THEN CAST({chosen} AS VARCHAR) ELSE coalesce(day, '') END AS day,
  CASE WHEN {moved} THEN least(c3, c4) ELSE c2 END AS day_conf, CASE WHEN {moved} THEN 'WARNING' ELSE day_status END AS day_status,
  CASE WHEN {moved} THEN {reason} ELSE {OLD.format('day', 'c2')} END AS day_comment, CASE WHEN {moved} THEN 'csv_date_policy' ELSE 'ocr' END AS day_source,
  coalesce(month, '') AS month, coalesce(year, '') AS year, pilot_signature, pilot_signature_conf, 'vision' AS pilot_signature_source,
  CASE WHEN ok THEN '20' || year || '/' || lpad(CAST(month_n AS VARCHAR), 2, '0') || '/' || lpad(CAST({chosen} AS VARCHAR), 2, '0') ELSE '' END AS date, processing_ms AS time_ms FROM wide"""


WIDE_COLUMNS = ("string file, long page, string log_number, string dup, string disc, double log_number_conf, string log_number_status, string matricula, string matricula_status, string day, double day_conf, "
                "string day_status, string day_comment, string day_source, string month, string year, string pilot_signature, double pilot_signature_conf, string pilot_signature_source, string date, double time_ms")


@register("wide_page_rows", WIDE_COLUMNS, wide_sql("CASE WHEN moved THEN last ELSE day_n END", "moved", "'Día OCR sin resolver; se usó el último día calendario del mes en el CSV'"), WIDE)
def wide_page_rows(spark, folder):
    return R.wide_page_rows(D.pages(spark, folder), FIELDS)


@register("wide_page_rows_month_end", WIDE_COLUMNS, wide_sql("last", "(ok AND (day IS NULL OR day_n <> last))", "'CSV configurado para usar el último día del mes; día OCR: ' || coalesce(day, 'vacío')"), WIDE)
def wide_page_rows_month_end(spark, folder):
    return R.wide_page_rows(D.pages(spark, folder), FIELDS, month_end=True)


@register("minimal_rows", "string columns, long rows", """
SELECT 'file,page,log_number,dup,disc,matricula,day,month,year,pilot_signature,captain_signature,captain_license,technician_license,technician_signature,date,time_ms' AS columns, count(*) AS rows FROM pages""", PAGES)
def minimal_rows(spark, folder):
    rows = R.minimal_rows(R.wide_page_rows(D.pages(spark, folder), FIELDS).drop("_file_seq", "_page_number"))
    return rows.agg(F.lit(",".join(rows.columns)).alias("columns"), F.count("*").alias("rows"))


@register("important_columns", "string view, string columns, long filled", """
SELECT 'summary' AS view, 'file,page,log_number,dup,disc,matricula,pilot_signature,captain_signature,captain_license,technician_license,technician_signature,date,time_ms' AS columns, count(log) AS filled FROM pages""", PAGES)
def important_columns(spark, folder):
    rows = R.wide_page_rows(D.pages(spark, folder), FIELDS).drop("_file_seq", "_page_number")
    template = {f: (kind, f not in ("captain_license", "technician_license")) for f, kind in FIELDS.items()}
    chosen = rows.select(*R.important_columns(rows.columns, template))
    return chosen.agg(F.lit("summary").alias("view"), F.lit(",".join(chosen.columns)).alias("columns"), F.count_if(F.col("log_number") != "").alias("filled"))


def simple_rows(spark, folder):
    text = {f: F.coalesce(F.col(f)["value"], F.lit("")) for f in ("log_number", "matricula", "day", "month")}
    return D.pages(spark, folder).select(*ID, "file", *[c.alias(n) for n, c in text.items()])


@register("search_rows", "long page_number, long match_class, string match_column", """
SELECT page_number, CASE WHEN hit LIKE '=%' THEN 0 ELSE 1 END AS match_class, hit[2:] AS match_column FROM (SELECT page_number, coalesce(
  CASE WHEN lower(file) = 'ene' THEN '=file' WHEN contains(lower(file), 'ene') THEN '~file' END, CASE WHEN log = 'ene' THEN '=log_number' END,
  CASE WHEN contains(lower(matricula), 'ene') THEN '~matricula' END, CASE WHEN lower(month) = 'ene' THEN '=month' WHEN contains(lower(month), 'ene') THEN '~month' END) AS hit FROM pages) WHERE hit IS NOT NULL""", PAGES)
def search_rows(spark, folder):
    return R.search_rows(simple_rows(spark, folder), "ENE", ["file", "log_number", "matricula", "month"], ID)


@register("search_rows_partial", "long page_number, long match_class, string match_column", """
SELECT page_number, CASE WHEN log = '2000' THEN 0 ELSE 1 END AS match_class, CASE WHEN contains(log, '2000') THEN 'log_number' ELSE 'matricula' END AS match_column FROM pages WHERE contains(log, '2000') OR contains(matricula, '2000')""", PAGES)
def search_rows_partial(spark, folder):
    return R.search_rows(simple_rows(spark, folder), "2000", ["log_number", "matricula"], ID)


@register("cell_status", "long page, string log_cell, string comment_cell, string dup_cell, string signature_cell", """
SELECT page_number AS page, log_status AS log_cell, CASE WHEN moved THEN 'WARNING' ELSE day_status END AS comment_cell, CASE WHEN dup THEN 'WARNING' END AS dup_cell,
  CASE pilot_signature WHEN 'true' THEN 'OK' WHEN 'unclear' THEN 'WARNING' ELSE 'ERROR' END AS signature_cell FROM wide""", WIDE)
def cell_status(spark, folder):
    rows = R.wide_page_rows(D.pages(spark, folder), FIELDS)
    cols = rows.columns
    return rows.select("page", R.cell_status("log_number", cols).alias("log_cell"), R.cell_status("day_comment", cols).alias("comment_cell"),
                       R.cell_status("dup", cols).alias("dup_cell"), R.cell_status("pilot_signature", cols).alias("signature_cell"))


SORT_CELLS = PAGES + """
cells AS (SELECT page_number, file_seq, CASE k % 5 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN matricula WHEN 2 THEN '  ' WHEN 3 THEN lower(month) || k::VARCHAR ELSE CAST(k / 4.0 AS VARCHAR) END AS cell FROM pages),
keys AS (SELECT *, trim(coalesce(cell, '')) = '' AS blank, TRY_CAST(trim(cell) AS DOUBLE) AS num, lower(trim(coalesce(cell, ''))) AS txt FROM cells),
"""


def sort_sql(direction: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY blank, CASE WHEN blank THEN 0 WHEN num IS NULL THEN 1 ELSE 0 END {direction}, CASE WHEN blank THEN 0 ELSE coalesce(num, 0) END {direction},
  CASE WHEN blank OR num IS NOT NULL THEN '' ELSE txt END {direction}, file_seq, page_number) AS rank, page_number FROM keys"""


def sorted_cells(spark, folder, descending):
    k = F.col("page_number") - 1
    cell = (F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.col("matricula")["value"]).when(k % 5 == 2, "  ")
            .when(k % 5 == 3, F.concat(F.lower(F.col("month")["value"]), k.cast("string"))).otherwise((k / 4.0).cast("string")))
    rows = D.pages(spark, folder).select(*ID, cell.alias("cell"))
    ordered = R.sort_by_column(rows, "cell", descending, ID)
    # The rank of the sorted rows: rows keep their partition order after a sort.
    from pyspark.sql import Window
    from foliant.session import save
    kept = save(ordered.withColumn("_chunk", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()))
    sizes = kept.groupBy("_chunk").count()
    offsets = sizes.select("_chunk", (F.sum("count").over(Window.orderBy("_chunk")) - F.col("count")).alias("_o"))
    return kept.join(F.broadcast(offsets), "_chunk").select(
        (F.col("_o") + F.row_number().over(Window.partitionBy("_chunk").orderBy("_in"))).alias("rank"), "page_number")


@register("sort_by_column_ascending", "long rank, long page_number", sort_sql("ASC"), SORT_CELLS)
def sort_by_column_ascending(spark, folder):
    return sorted_cells(spark, folder, False)


@register("sort_by_column_descending", "long rank, long page_number", sort_sql("DESC"), SORT_CELLS)
def sort_by_column_descending(spark, folder):
    return sorted_cells(spark, folder, True)


@register("review_worklist", "long priority, long page_number, string field_id", """
SELECT priority, page_number, field_id FROM (SELECT p.*, f.* FROM pages p, LATERAL (VALUES
  ('log_number', 0, CASE WHEN log_status <> 'OK' AND log IS NULL THEN 1 END), ('matricula', 1, CASE WHEN matricula IS NULL THEN 1 END), ('day', 2, 0), ('month', 3, 0), ('year', 4, 0),
  ('pilot_signature', 5, CASE WHEN pilot_signature = 'unclear' THEN 1 END), ('captain_signature', 6, CASE WHEN captain_signature = 'unclear' THEN 1 END), ('captain_license', 7, CASE WHEN captain_license = 'unclear' THEN 1 END),
  ('technician_license', 8, CASE WHEN technician_license = 'unclear' THEN 1 END), ('technician_signature', 9, CASE WHEN technician_signature = 'unclear' THEN 1 END)) f(field_id, pos, priority)
  WHERE NOT blank AND priority IS NOT NULL ORDER BY priority, file_seq, page_number, pos LIMIT 120)""", PAGES)
def review_worklist(spark, folder):
    return R.review_worklist(Q.to_readings(D.pages(spark, folder), FIELDS), template_table(spark), 120)


@register("discrepancy_stats", "string registration, long total, long confirmed, long uncertain, long level", """
SELECT registration, count(*) AS total, count(*) FILTER (category = 'missing') AS confirmed, count(*) FILTER (category <> 'missing') AS uncertain, grouping(registration) AS level
FROM (SELECT coalesce(matricula, 'sin_matricula') AS registration, category FROM found) GROUP BY ROLLUP (registration)""", DISCREPANCIES)
def discrepancy_stats(spark, folder):
    return R.discrepancy_stats(Q.classify_discrepancies(D.pages(spark, folder)))


@register("verifier_stats", "boolean active, long files, string models, long date_targets, long crops, long signatures_resolved, string disabled_by", """
SELECT bool_or(e) AS active, count(*) FILTER (e) AS files, (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT 'model-' || (pages % 3) AS m FROM files WHERE pages % 4 <> 0)) AS models,
  CAST(sum(CASE WHEN e THEN pages END) AS BIGINT) AS date_targets, CAST(sum(CASE WHEN e THEN pages // 2 END) AS BIGINT) AS crops, CAST(sum(CASE WHEN e THEN pages // 3 END) AS BIGINT) AS signatures_resolved,
  min_by('off-' || file_seq, file_seq) FILTER (NOT e) AS disabled_by FROM (SELECT *, pages % 4 <> 0 AS e FROM files)""", FILES)
def verifier_stats(spark, folder):
    return R.verifier_stats(verifier_runs(spark, folder)).withColumn("models", F.array_join("models", ","))


def verifier_runs(spark, folder):
    n, on = F.col("pages"), F.col("pages") % 4 != 0
    return files(spark, folder).select(
        F.col("file_seq").alias("seq"), on.alias("enabled"), F.concat(F.lit("model-"), (n % 3).cast("string")).alias("model"), n.alias("date_targets"),
        F.floor(n / 2).alias("crops"), F.floor(n / 3).alias("signatures_resolved"), F.lit(0).alias("date_fields_resolved"), F.lit(0).alias("fields_resolved"),
        F.when(~on, F.concat(F.lit("off-"), F.col("file_seq").cast("string"))).otherwise("").alias("disabled"))


@register("run_wall_clock", "double wall_ms", "SELECT round((max(started_at + processing_ms / 1000.0) - min(started_at)) * 1000.0, 3) AS wall_ms FROM files", FILES)
def run_wall_clock(spark, folder):
    return R.run_wall_clock(files(spark, folder)).select(F.round("wall_ms", 3).alias("wall_ms"))


@register("page_time_share", "long page_number, double time_ms", """
SELECT page_number, round(processing_ms * (SELECT (max(started_at + processing_ms / 1000.0) - min(started_at)) * 1000.0 FROM files) / (SELECT sum(processing_ms) FROM pages), 4) AS time_ms FROM pages""", FILES)
def page_time_share(spark, folder):
    return R.page_time_share(D.pages(spark, folder), files(spark, folder)).select("page_number", F.round("time_ms", 4).alias("time_ms"))


@register("page_time_share_per_file", "long page_number, double time_ms", "SELECT page_number, round(processing_ms / 4.0, 4) AS time_ms FROM pages", PAGES)
def page_time_share_per_file(spark, folder):
    return R.page_time_share(D.pages(spark, folder), files(spark, folder), per_file=True).select("page_number", F.round("time_ms", 4).alias("time_ms"))


@register("run_stats_header", "long files, long total_pages, long blank_pages, long valid_pages", """
SELECT count(DISTINCT file_seq) AS files, count(*) AS total_pages, count(*) FILTER (blank) AS blank_pages, count(*) FILTER (NOT blank) AS valid_pages FROM pages""", PAGES)
def run_stats_header(spark, folder):
    return R.run_header(D.pages(spark, folder))


@register("run_stats", "string block, string key, double n", f"""
SELECT 'total' AS block, key, n FROM (SELECT count(DISTINCT file_seq) AS files, count(*) AS total_pages, count(*) FILTER (blank) AS blank_pages, count(*) FILTER (NOT blank) AS valid_pages FROM pages) UNPIVOT (n FOR key IN (files, total_pages, blank_pages, valid_pages))
UNION ALL SELECT 'registration', coalesce(matricula, 'sin_matricula'), count(*) FROM pages WHERE NOT blank GROUP BY ALL
UNION ALL SELECT 'month', {MONTH_KEY}, count(*) FROM pages WHERE NOT blank GROUP BY ALL
UNION ALL SELECT 'total', 'no_registration', count(*) FROM pages WHERE NOT blank AND matricula IS NULL UNION ALL SELECT 'total', 'no_month', count(*) FROM pages WHERE NOT blank AND {MONTH_KEY} = 'sf'
UNION ALL SELECT 'discrepancies', coalesce(matricula, 'sin_matricula'), count(*) FROM found GROUP BY ALL UNION ALL SELECT 'discrepancies', 'all', count(*) FROM found
UNION ALL SELECT 'verifier', 'crops', sum(CASE WHEN pages % 4 <> 0 THEN pages // 2 END) FROM files
UNION ALL SELECT 'wall', 'ms', round((max(started_at + processing_ms / 1000.0) - min(started_at)) * 1000.0, 3) FROM files
UNION ALL SELECT 'delivery', 'distributed', count(*) FROM pages WHERE NOT blank UNION ALL SELECT 'delivery', 'left_over', 0""", DISCREPANCIES + FILES[len(PAGES):])
def run_stats(spark, folder):
    """The statistics object, written and read back."""
    pages, path = D.pages(spark, folder), scratch(spark, "stats")
    found, clocks = Q.classify_discrepancies(pages), files(spark, folder)
    made = R.run_stats(pages, "run", found, clocks, verifier_runs(spark, folder), V.delivery_coverage(pages, ("avion", "mes")))
    W.write_stats({"files": clocks}, path, summary=made)
    whole = spark.read.schema(made.schema).json(f"{path}/stats")

    def rows(block, entries):
        return whole.select(F.lit(block).alias("block"), F.explode(entries).alias("key", "n")).select("block", "key", F.col("n").cast("double").alias("n"))

    def single(block, **columns):
        return rows(block, F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("double"))]))

    parts = [single("total", **{c: F.col(c) for c in ("files", "total_pages", "blank_pages", "valid_pages")}, no_registration=F.col("counts.no_registration"), no_month=F.col("counts.no_month")),
             rows("registration", F.col("counts.by_registration")), rows("month", F.col("counts.by_month")),
             rows("discrepancies", F.transform_values("discrepancies.by_registration", lambda k, v: v["total"])), single("discrepancies", all=F.col("discrepancies.all.total")),
             single("verifier", crops=F.col("verifier.crops")), single("wall", ms=F.round("wall_ms", 3)), single("delivery", distributed=F.col("delivery.distributed"), left_over=F.col("delivery.left_over"))]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@register("source_documents", "string path, long seq", """
SELECT min_by(path, page_number) AS path, min(page_number) AS seq FROM (SELECT page_number, CASE WHEN k % 2 = 0 THEN '/in/' || file ELSE upper('/in/' || file) END AS path FROM pages) GROUP BY lower(path)""", PAGES)
def source_documents(spark, folder):
    path = F.concat(F.lit("/in/"), "file")
    rows = D.pages(spark, folder).select(F.when(F.col("page_number") % 2 == 1, path).otherwise(F.upper(path)).alias("path"), F.col("page_number").alias("seq"))
    return R.source_documents(rows)


def companion(spark, folder, keep):
    """Report rows by position and the companion's pages, the latter only where ``keep``."""
    pages = P.positions(D.pages(spark, folder).select(*ID, "file"), ID, "pos")
    rows = pages.select("pos", "file", F.col("page_number").alias("page"))
    source = pages.where(keep).select("pos", F.concat(F.lit("/in/"), "file").alias("path"), F.col("page_number").alias("page"))
    return rows, source


@register("attach_source", "long page, string source_path", "SELECT page_number AS page, '/in/' || file AS source_path FROM pages", PAGES)
def attach_source(spark, folder):
    rows, source = companion(spark, folder, F.lit(True))
    return R.attach_source(rows, source)


@register("attach_source_by_key", "long page, string source_path", "SELECT page_number AS page, CASE WHEN k % 3 <> 0 THEN '/in/' || file END AS source_path FROM pages", PAGES)
def attach_source_by_key(spark, folder):
    rows, source = companion(spark, folder, (F.col("page_number") - 1) % 3 != 0)
    return R.attach_source(rows, source)


@register("drop_pages", "string path, long page_number", """
SELECT path, page_number FROM (SELECT *, CASE WHEN file_seq < 2 THEN '/' || file_seq || '/same.pdf' ELSE '/in/' || file END AS path FROM pages)
WHERE NOT (file_seq >= 2 AND k % 10 = 3) AND NOT (file_seq = 0 AND k % 10 = 4)""", PAGES)
def drop_pages(spark, folder):
    shared = F.col("file_seq") < 2
    pages = D.pages(spark, folder).select("page_number", "file_seq", F.when(shared, "same.pdf").otherwise(F.col("file")).alias("file"), F.when(
        shared, F.concat(F.lit("/"), F.col("file_seq").cast("string"), F.lit("/same.pdf"))).otherwise(F.concat(F.lit("/in/"), "file")).alias("path"))
    k = F.col("page_number") - 1
    by_name = pages.where(k % 10 == 3).select(F.lit(None).cast("string").alias("path"), "file", "page_number")
    by_path = pages.where((k % 10 == 4) & (F.col("file_seq") == 0)).select("path", F.lit("gone.pdf").alias("file"), "page_number")
    return R.drop_pages(pages, by_name.unionByName(by_path))


NUMBERED = PAGES + "numbered AS (SELECT *, row_number() OVER (ORDER BY file_seq, page_number) AS no, count(*) OVER () AS total FROM pages),\n"


@register("page_range", "long batch_no, long page_number", "SELECT no AS batch_no, page_number FROM numbered WHERE no BETWEEN 101 AND 1200", NUMBERED)
def page_range(spark, folder):
    return P.page_range(D.pages(spark, folder).select(*ID), "101-1200")


@register("page_range_open", "long batch_no, long page_number", "SELECT no AS batch_no, page_number FROM numbered WHERE no >= 700", NUMBERED)
def page_range_open(spark, folder):
    return P.page_range(D.pages(spark, folder).select(*ID), "700-")


@register("slice_batch", "long file_seq, long first_page, long last_page, long taken", """
SELECT file_seq, first_page, last_page, last_page - first_page + 1 AS taken FROM (SELECT file_seq, greatest(1, 500 - start_no + 1) AS first_page, least(n, 3000 - start_no + 1) AS last_page FROM
 (SELECT file_seq, count(*) AS n, sum(count(*)) OVER (ORDER BY file_seq) - count(*) + 1 AS start_no FROM pages GROUP BY file_seq)) WHERE last_page >= first_page""", PAGES)
def slice_batch(spark, folder):
    return P.slice_batch(files(spark, folder).select("file_seq", "pages"), 500, 3000)


@register("spread_sample", "long page_number", """
SELECT page_number FROM numbered WHERE no - 1 IN (SELECT CAST(round_even(i * ((SELECT count(*) FROM pages) - 1) / (least(37, (SELECT count(*) FROM pages)) - 1), 0) AS BIGINT) FROM range(37) t(i))""", NUMBERED)
def spread_sample(spark, folder):
    return P.spread_sample(D.pages(spark, folder).select(*ID), ID, 37)


@register("step_sample", "long page_number", """
SELECT page_number FROM (SELECT *, (no - 1) // 7 AS j FROM numbered WHERE (no - 1) % 7 = 0) WHERE j IN (SELECT CAST(floor(i * ((SELECT count(*) FROM numbered WHERE (no - 1) % 7 = 0) / 50)) AS BIGINT) FROM range(50) t(i))""", NUMBERED)
def step_sample(spark, folder):
    return P.step_sample(D.pages(spark, folder).select(*ID), ID, 7, 50)


@register("random_sample", "string file, long page_number", """
SELECT file, page_number FROM (SELECT *, (page_number * 48271 + file_seq * 69621 + 7 * 16807) % 2147483647 AS mix FROM pages)
ORDER BY ((mix * mix + 12345) % 2147483647 * 39373 + mix) % 2147483647, file_seq, page_number LIMIT 50""", PAGES)
def random_sample(spark, folder):
    return P.random_sample(D.pages(spark, folder), 50, 7)


def transforms(spark, folder):
    k = F.col("page_number") - 1
    return D.pages(spark, folder).select(*ID, ((k * 7) % 11 / 10.0).alias("rot"), ((k * 13) % 101).cast("double").alias("tx"), ((k * 17) % 89).cast("double").alias("ty"),
                                         (1.0 + (k % 5) / 100.0).alias("scale"), (k % 300).alias("inliers"), (F.floor(k / 60) % 3 != 0).alias("reliable"), ((k * 3) % 50 / 10.0).alias("score"))


TRANSFORMS = PAGES + """
transforms AS (SELECT page_number, file_seq, (k * 7) % 11 / 10.0 AS rot, CAST((k * 13) % 101 AS DOUBLE) AS tx, CAST((k * 17) % 89 AS DOUBLE) AS ty, 1.0 + (k % 5) / 100.0 AS scale, k % 300 AS inliers, (k // 60) % 3 <> 0 AS reliable, (k * 3) % 50 / 10.0 AS score FROM pages),
"""
_MEDIAN = "round(coalesce(quantile_cont({0}, 0.5) FILTER (reliable) OVER w, quantile_cont({0}, 0.5) OVER w), 9)"


@register("stabilise_transforms", "long page_number, double rot, double tx, double ty, double scale, long inliers, boolean reliable", f"""
SELECT page_number, {_MEDIAN.format('rot')} AS rot, {_MEDIAN.format('tx')} AS tx, {_MEDIAN.format('ty')} AS ty, {_MEDIAN.format('scale')} AS scale,
  coalesce(max(inliers) FILTER (reliable) OVER w, max(inliers) OVER w) AS inliers, bool_or(reliable) OVER w AS reliable FROM transforms
WINDOW w AS (PARTITION BY file_seq ORDER BY page_number ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""", TRANSFORMS)
def stabilise_transforms(spark, folder):
    done = P.stabilise_transforms(transforms(spark, folder))
    return done.select("page_number", *[F.round(c, 9).alias(c) for c in ("rot", "tx", "ty", "scale")], "inliers", "reliable")


@register("choose_transform", "long page_number, double rot, long inliers, string method", """
SELECT page_number, rot, inliers, method FROM (SELECT page_number, rot, inliers, reliable, score, 'orb' AS method FROM transforms UNION ALL SELECT page_number, rot + 1, (inliers * 7) % 400, NOT reliable OR inliers % 2 = 0, score, 'akaze' FROM transforms
  UNION ALL SELECT page_number, rot + 2, inliers, reliable, score + 1, 'phase' FROM transforms) QUALIFY row_number() OVER (PARTITION BY page_number ORDER BY reliable DESC, inliers DESC, score DESC) = 1""", TRANSFORMS)
def choose_transform(spark, folder):
    base = transforms(spark, folder)
    names = [*ID, "rot", "inliers", "reliable", "score", "method"]
    candidates = (base.withColumn("method", F.lit("orb")).select(*names)
                  .unionByName(base.withColumn("method", F.lit("akaze")).withColumn("rot", F.col("rot") + 1).withColumn("reliable", ~F.col("reliable") | (F.col("inliers") % 2 == 0)).withColumn("inliers", (F.col("inliers") * 7) % 400).select(*names))
                  .unionByName(base.withColumn("method", F.lit("phase")).withColumn("rot", F.col("rot") + 2).withColumn("score", F.col("score") + 1).select(*names)))
    return Q.choose_transform(candidates)


@register("blank_pages", "long page_number, boolean blank, string status", "SELECT page_number, k % 97 < 15 AS blank, CASE WHEN k % 97 < 15 THEN 'WARNING' ELSE 'OK' END AS status FROM pages", PAGES)
def blank_pages(spark, folder):
    return Q.blank_pages(D.pages(spark, folder).drop("blank").withColumn("variance", ((F.col("page_number") - 1) % 97).cast("double")))


@register("checkbox_verdicts", "long l_orderkey, long l_linenumber, double ink_ratio, string value, double confidence, string status", """
SELECT l_orderkey, l_linenumber, l_discount * 10 AS ink_ratio, CASE WHEN l_discount * 10 BETWEEN 0.02 AND 0.9 THEN 'marked' ELSE 'empty' END AS value,
  round_even(round(least(1.0, abs(l_discount * 10 - 0.02) / 0.1 + 0.5), 9), 3) AS confidence, CASE WHEN l_discount * 10 BETWEEN 0.02 AND 0.9 THEN 'OK' ELSE 'WARNING' END AS status FROM lineitem""")
def checkbox_verdicts(spark, folder):
    return Q.checkbox_verdicts(D.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("ink_ratio")))


EXCLUDED = DISCREPANCIES + f"""
keys AS (SELECT *, coalesce(matricula, 'sin_matricula') AS avion, {MONTH_KEY} AS mes, category IS NOT NULL AS excluded FROM pages LEFT JOIN (SELECT k AS fk, category FROM found WHERE category = 'missing') ON fk = k WHERE NOT blank),
labels AS (SELECT *, CASE WHEN mes = 'sf' THEN 'sf' ELSE mes[1:5] || ['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'][CAST(mes[6:7] AS INT)] END AS mes_name FROM keys),
assigned AS (SELECT *, CASE WHEN matricula IS NULL THEN 'revisar.pdf' WHEN NOT excluded THEN avion || '_' || mes_name || '.pdf' END AS output FROM labels),
"""


def excluded_pages(spark, folder):
    return Q.classify_discrepancies(D.pages(spark, folder)).where("category = 'missing'").select("file", "page_number")


@register("assign_groups", "long page_number, string output", "SELECT page_number, output FROM assigned WHERE output IS NOT NULL", EXCLUDED)
def assign_groups(spark, folder):
    return V.assign_groups(D.pages(spark, folder), ("avion", "mes"), excluded_pages(spark, folder))


@register("delivery_coverage", "string output, long pages, long distributed, long excluded, long left_over", """
SELECT output, count(*) AS pages, (SELECT count(*) FROM assigned WHERE output IS NOT NULL) AS distributed, (SELECT count(*) FROM assigned WHERE output IS NULL) AS excluded, 0 AS left_over
FROM assigned WHERE output IS NOT NULL GROUP BY output""", EXCLUDED)
def delivery_coverage(spark, folder):
    return V.delivery_coverage(D.pages(spark, folder), ("avion", "mes"), excluded_pages(spark, folder))


@register("discrepancy_exclusion", "long page_number, boolean kept", "SELECT page_number, NOT excluded AS kept FROM keys", EXCLUDED)
def discrepancy_exclusion(spark, folder):
    keys, excluded = V.page_keys(D.pages(spark, folder)), excluded_pages(spark, folder)
    kept = V.exclude(keys, excluded).select("page_number", F.lit(True).alias("kept"))
    return kept.unionByName(V.exclude(keys, excluded, keep=True).select("page_number", F.lit(False).alias("kept")))


@register("group_labels", "long page_number, string label, string separator", """
SELECT page_number, mes_name AS label, CASE WHEN mes = 'sf' THEN 'SIN FECHA' ELSE mes_name[6:8] || ' ' || mes_name[1:4] END AS separator FROM labels""", EXCLUDED)
def group_labels(spark, folder):
    keys = V.page_keys(D.pages(spark, folder))
    return keys.select("page_number", T.month_label(F.col("mes")).alias("label"), T.separator_label(F.col("mes")).alias("separator"))


DELIVERY = EXCLUDED + """
body AS (SELECT CASE WHEN matricula IS NULL THEN 2 WHEN excluded THEN 1 ELSE 0 END AS cls, CASE WHEN matricula IS NULL OR excluded THEN 0 ELSE CAST(avion[4:7] AS INT) END AS num,
  CASE WHEN matricula IS NULL OR excluded THEN '' ELSE avion[8:10] END AS suf, CASE WHEN matricula IS NULL OR excluded THEN '' WHEN mes = 'sf' THEN '9999-99' ELSE mes END AS mon,
  CASE WHEN matricula IS NULL THEN 'REVISAR' WHEN excluded THEN 'POSIBLES DISCREPANCIAS' ELSE avion || chr(10) || CASE WHEN mes = 'sf' THEN 'SIN FECHA' ELSE mes_name[6:8] || ' ' || mes_name[1:4] END END AS sep,
  file_seq, page_number, log_ord, 1 AS is_body FROM labels),
entries AS (SELECT * FROM body UNION ALL SELECT DISTINCT cls, num, suf, mon, sep, NULL, NULL, NULL, 0 FROM body),
seq AS (SELECT *, row_number() OVER (ORDER BY cls, num, suf, mon, is_body, log_ord, file_seq, page_number) AS pos FROM entries),
"""


def sequence(spark, folder):
    return V.delivery_sequence(D.pages(spark, folder), ("avion", "mes"), excluded_pages(spark, folder), discrepancies_last=True)


@register("delivery_sequence", "long pos, string separator, long page_number", "SELECT pos, CASE WHEN is_body = 0 THEN sep END AS separator, page_number FROM seq", DELIVERY)
def delivery_sequence(spark, folder):
    return sequence(spark, folder)


@register("delivery_sequence_plain", "long pos, string separator, long page_number", """
SELECT row_number() OVER (ORDER BY cls, is_body, log_ord, file_seq, page_number) AS pos, sep AS separator, page_number FROM (
 SELECT CASE WHEN matricula IS NULL THEN 2 ELSE 0 END AS cls, NULL AS sep, log_ord, file_seq, page_number, 1 AS is_body FROM keys UNION ALL SELECT 2, 'REVISAR', NULL, NULL, NULL, 0)""", EXCLUDED)
def delivery_sequence_plain(spark, folder):
    return V.delivery_sequence(D.pages(spark, folder))


# Greedy packing, section by section, as a recursive query. ``used`` is the size of the open part.
PARTS = DELIVERY + """
sections AS (SELECT cls, num, suf, mon, count(*) AS size, min(pos) AS start_pos, row_number() OVER (ORDER BY min(pos)) AS i FROM seq GROUP BY ALL),
fold AS (SELECT i, size, start_pos, CAST(1 AS BIGINT) AS first_part, CAST(0 AS BIGINT) AS base, CAST(CASE WHEN size > 50 THEN 1 + ceil((size - 1) / 49) - 1 ELSE 1 END AS BIGINT) AS part,
   CAST(CASE WHEN size > 50 THEN (size - 1) - (ceil((size - 1) / 49) - 1) * 49 + 1 ELSE size END AS BIGINT) AS used FROM sections WHERE i = 1
 UNION ALL SELECT s.i, s.size, s.start_pos, CAST(CASE WHEN s.size > 50 OR f.used + s.size > 50 THEN f.part + 1 ELSE f.part END AS BIGINT), CAST(CASE WHEN s.size > 50 OR f.used + s.size > 50 THEN 0 ELSE f.used END AS BIGINT),
   CAST(CASE WHEN s.size > 50 THEN f.part + 1 + ceil((s.size - 1) / 49) - 1 WHEN f.used + s.size > 50 THEN f.part + 1 ELSE f.part END AS BIGINT),
   CAST(CASE WHEN s.size > 50 THEN (s.size - 1) - (ceil((s.size - 1) / 49) - 1) * 49 + 1 WHEN f.used + s.size > 50 THEN s.size ELSE f.used + s.size END AS BIGINT)
   FROM fold f JOIN sections s ON s.i = f.i + 1),
placed AS (SELECT q.*, f.size, f.start_pos, f.first_part, f.base FROM seq q JOIN sections USING (cls, num, suf, mon) JOIN fold f USING (i)),
parts AS (SELECT page_number, CASE WHEN is_body = 0 THEN sep END AS separator, first_part + CASE WHEN size > 50 THEN (pos - start_pos - 1) // 49 ELSE 0 END AS part,
   CASE WHEN size > 50 THEN (pos - start_pos - 1) % 49 + 2 ELSE base + pos - start_pos + 1 END AS part_pos FROM placed WHERE is_body = 1 OR size <= 50
 UNION ALL SELECT NULL, sep, first_part + c, 1 FROM placed, range(100000) t(c) WHERE is_body = 0 AND size > 50 AND c < ceil((size - 1) / 49)),
"""


@register("split_parts", "long part, long part_pos, string separator, long page_number", "SELECT part, part_pos, separator, page_number FROM parts", PARTS, recursive=True)
def split_parts(spark, folder):
    return V.split_parts(sequence(spark, folder), 50)


@register("part_numbers", "long run, long pos, long number, long numbered_parts", """
SELECT l_orderkey AS run, l_linenumber AS pos, CAST(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS number, CAST(sum(n) OVER (PARTITION BY l_orderkey) AS BIGINT) AS numbered_parts
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN 1 ELSE 0 END AS n FROM lineitem GROUP BY ALL)""")
def part_numbers(spark, folder):
    parts = D.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("pos")).distinct()
    return V.part_numbers(parts.withColumn("is_review", F.col("pos") % 3 == 0))


@register("missing_files", "string file", "SELECT DISTINCT file FROM pages WHERE file_seq % 3 = 0", PAGES)
def missing_files(spark, folder):
    index = D.pages(spark, folder).select("file", "file_seq")
    return V.missing_files(index, index.where("file_seq % 3 <> 0"))
