"""Readers, writers and the stream, exercised on files written from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.batches import PLAN, plan, report_rows
from catalog.dates import CORRECTED
from catalog.pages import FIELDS
from catalog.registry import register
from catalog.reports import DELIVERY, EXCLUDED, PARTS, WIDE, excluded_pages, sequence
from catalog.tables import FIELD_ROWS, FLEET, PAGES
from foliant.operators import delivery as V
from foliant.operators import reports as R
from foliant.operators import summaries as S
from foliant.operators.quality import to_readings
from foliant.plans import derived as D
from foliant.plans import outputs as O
from foliant.session import save, save_rows, scratch
from foliant.sources import readers, writers
from foliant.streaming import ingest as I

ROW_SQL = "SELECT file, CAST(page_number AS VARCHAR) AS page, coalesce(log, '') AS log_number, CAST(dup AS VARCHAR) AS dup, CAST(disc AS VARCHAR) AS disc, coalesce(month, '') AS month, CASE WHEN moved THEN 'Día OCR sin resolver; se usó el último día calendario del mes en el CSV' ELSE CASE day_status WHEN 'ERROR' THEN 'Required field empty' WHEN 'WARNING' THEN 'Low confidence (' || printf('%.2f', c2) || ')' ELSE 'OK' END END AS day_comment FROM wide"


@register("write_complete_csv", "string file, string page, string log_number, string dup, string disc, string month, string day_comment", ROW_SQL, WIDE)
def write_complete_csv(spark, folder):
    path = scratch(spark, "complete")
    writers.write_complete_csv(R.wide_page_rows(D.pages(spark, folder), FIELDS), path)
    return readers.read_run_csv(spark, path)


@register("write_minimal_csv", "string file, string page, string log_number, string month", "SELECT file, CAST(page_number AS VARCHAR) AS page, coalesce(log, '') AS log_number, coalesce(month, '') AS month FROM pages", PAGES)
def write_minimal_csv(spark, folder):
    path = scratch(spark, "minimal")
    writers.write_minimal_csv(R.wide_page_rows(D.pages(spark, folder), FIELDS), path, ("log_number", "month"))
    return readers.read_run_csv(spark, path)


@register("read_run_csv", "long doc_id, string text, string lang", "SELECT doc_id, text, lang FROM documents")
def read_run_csv(spark, folder):
    """Whole documents, with their quotes and line breaks, through the report reader."""
    path = scratch(spark, "csv")
    writers.write_csv(D.table(spark, folder, "documents").select("doc_id", "text", "lang"), path)
    return readers.read_run_csv(spark, path)


@register("read_run_json", "long page_number, string file, string field_id, string value, double confidence, string status, long alternatives", """
SELECT page_number, file, field_id, value, confidence, f.status, alternatives FROM pages, """ + FIELD_ROWS, PAGES)
def read_run_json(spark, folder):
    path = scratch(spark, "json")
    writers.write_run_json(D.pages(spark, folder), list(FIELDS), path)
    rows = readers.page_readings(readers.read_run_pages(spark, path))
    return rows.withColumn("alternatives", F.size("alternatives"))


def report_documents(spark, folder, indented):
    """One document per file of up to 200 pages, as other programs write them, and one broken document."""
    pages = writers.page_rows(D.pages(spark, folder), FIELDS)
    documents = pages.groupBy("pdf_path", F.floor(F.col("page.page_number") / 200).alias("piece")).agg(F.array_sort(F.collect_list("page")).alias("pages"))
    text = F.to_json(F.struct("pdf_path", "pages"))
    rows = documents.select((F.regexp_replace(text, r'"pages":\[', '"pages":[\n  ') if indented else text).alias("value"))
    path = scratch(spark, "documents")
    broken = spark.createDataFrame([('{"pdf_path": "x.pdf", "pages": [',)], "value string")
    # A task writes its documents to one file, whether a document is a line or many.
    rows.unionByName(broken).write.option("compression", "gzip").option("lineSep", readers.DOCUMENT_END if indented else "\n").text(path)
    return path


DOCUMENTS_SQL = "SELECT page_number, file, 10 AS fields, 1 AS unreadable FROM pages"


@register("read_report_documents", "long page_number, string file, long fields, long unreadable", DOCUMENTS_SQL, PAGES)
def read_report_documents(spark, folder):
    path = report_documents(spark, folder, False)
    bad = readers.unreadable_reports(spark, path).count()
    return readers.report_pages(readers.read_run_json(spark, path)).select("page_number", "file", F.size("fields").alias("fields"), F.lit(bad).alias("unreadable"))


@register("read_report_documents_indented", "long page_number, string file, long fields, long unreadable", DOCUMENTS_SQL, PAGES)
def read_report_documents_indented(spark, folder):
    path = report_documents(spark, folder, True)
    bad = readers.unreadable_reports(spark, path, sequence=True).count()
    return readers.report_pages(readers.read_run_json(spark, path, sequence=True)).select("page_number", "file", F.size("fields").alias("fields"), F.lit(bad).alias("unreadable"))


@register("write_run_json", "string file, long pages, long fields", "SELECT file, count(*) AS pages, count(*) * 10 AS fields FROM pages GROUP BY file", PAGES)
def write_run_json(spark, folder):
    path = scratch(spark, "json")
    writers.write_run_json(D.pages(spark, folder), FIELDS, path)
    pages = readers.read_run_pages(spark, path)
    return pages.groupBy("file").agg(F.count("*").alias("pages"), F.sum(F.size("fields")).alias("fields"))


@register("pages_round_trip", "long page_number, string log, string day, string status", "SELECT page_number, log, day, 'OK' AS status FROM pages", PAGES)
def pages_round_trip(spark, folder):
    path = scratch(spark, "json")
    writers.write_run_json(D.pages(spark, folder), FIELDS, path)
    wide = readers.wide_pages(readers.read_run_pages(spark, path), FIELDS)
    return wide.select("page_number", F.col("log_number.value").alias("log"), F.col("day.value").alias("day"), "status")


@register("to_readings", "long page_number, string field_id, string value, double confidence", """
SELECT page_number, field_id, value, confidence FROM pages, """ + FIELD_ROWS, PAGES)
def readings_long(spark, folder):
    return to_readings(D.pages(spark, folder), list(FIELDS))


def run_folders(spark, folder):
    """One run folder per file of the batch, its report in ``datos/``."""
    root = scratch(spark, "runs")
    rows = D.pages(spark, folder).select("page_number", "file_seq")
    rows.withColumn("run", F.concat(F.lit("run_"), F.lpad(F.col("file_seq").cast("string"), 2, "0"))).repartition("run").write.partitionBy("run").option("header", True).csv(root)
    return root


@register("find_runs", "string run, long files", "SELECT DISTINCT 'run=run_' || lpad(CAST(file_seq AS VARCHAR), 2, '0') AS run, 1 AS files FROM pages", PAGES)
def find_runs(spark, folder):
    return readers.find_runs(spark, run_folders(spark, folder))


@register("find_csv_files", "long files, long folders", "SELECT count(DISTINCT file_seq) AS files, count(DISTINCT file_seq) AS folders FROM pages", PAGES)
def find_csv_files(spark, folder):
    found = readers.find_csv_files(spark, run_folders(spark, folder))
    return found.agg(F.count("*").alias("files"), F.countDistinct(F.split("file", "/")[0]).alias("folders"))


@register("batch_inputs", "long file_seq, string name", "SELECT row_number() OVER (ORDER BY file_seq) - 1 AS file_seq, 'f=' || lpad(CAST(file_seq AS VARCHAR), 2, '0') AS name FROM (SELECT DISTINCT file_seq FROM pages)", PAGES)
def batch_inputs(spark, folder):
    root = scratch(spark, "inputs")
    rows = D.pages(spark, folder).select("page_number", F.lpad(F.col("file_seq").cast("string"), 2, "0").alias("f"))
    rows.repartition("f").sortWithinPartitions("f").write.partitionBy("f").parquet(root)
    listing = readers.batch_inputs(spark, root + "/*", "*.parquet")
    # Part files of one run have names in order of their partition; numbers follow name and path.
    own = listing.select("file_seq", F.element_at(F.split("path", "/"), -2).alias("name"), "file", "path")
    place = F.row_number().over(Window.orderBy("file", "path")) - 1
    return own.withColumn("place", place).where(F.col("file_seq") == F.col("place")).select("name", F.dense_rank().over(Window.orderBy("name")).alias("n")).select(
        "name", (F.col("n") - 1).alias("file_seq"))


def document(spark, name, df):
    """Write a one-row table of a single text column as one document."""
    path = scratch(spark, name)
    df.coalesce(1).write.text(path)
    return path


@register("load_fleet", "string registration", "SELECT registration FROM fleet", PAGES + FLEET)
def load_fleet(spark, folder):
    listed = D.fleet(spark, folder).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.concat(F.array(F.lit("x")), F.collect_list(F.lower("registration"))).alias("matriculas"))).alias("v"))
    return readers.load_fleet(spark, document(spark, "fleet", listed))


@register("load_template", "long field_pos, string field_id, string field_type, boolean required", """
SELECT n_nationkey AS field_pos, lower(n_name) AS field_id, CASE WHEN n_regionkey = 0 THEN 'signature' ELSE 'ocr' END AS field_type, n_regionkey % 2 = 0 AS required FROM nation""")
def load_template(spark, folder):
    return readers.load_template(spark, template_document(spark, folder))


def template_document(spark, folder):
    key = F.col("n_nationkey")
    field = F.struct(key.alias("pos"), F.lower("n_name").alias("id"), F.when(F.col("n_regionkey") == 0, "signature").otherwise("ocr").alias("type"), (F.col("n_regionkey") % 2 == 0).alias("required"),
                     F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.when(key % 5 == 1, 0.95).otherwise(0.2).alias("w"), F.lit(0.1).alias("h"), F.lit(0.12).alias("min_ink_peak"),
                     F.when(key % 5 == 2, 0.2).otherwise(0.05).alias("max_empty_peak"), F.when(key % 5 == 3, "[0-9").when(key % 5 == 4, "^[0-9]{7}$").alias("regex"))
    doc = D.table(spark, folder, "nation").agg(F.to_json(F.struct(F.lit("form").alias("name"), F.array_sort(F.collect_list(field)).alias("fields"))).alias("v"))
    return document(spark, "template", doc)


@register("template_problems", "string field_id, string problem", """
SELECT lower(n_name) AS field_id, CASE n_nationkey % 5 WHEN 1 THEN 'box outside the page' WHEN 2 THEN 'inverted ink peaks' ELSE 'pattern does not compile' END AS problem FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)""")
def template_problems(spark, folder):
    return readers.template_problems(readers.load_template(spark, template_document(spark, folder)))


@register("read_delivery_index", "long part_pos, long seq, string separator, long page, boolean is_review", """
SELECT dense_rank() OVER (ORDER BY part) - 1 AS part_pos, part_pos AS seq, coalesce(separator, '') AS separator, coalesce(page_number, 0) AS page, bool_and(cls = 2) OVER (PARTITION BY part) AS is_review
FROM (SELECT p.*, CASE WHEN q.cls IS NULL THEN s.cls ELSE q.cls END AS cls FROM parts p LEFT JOIN (SELECT page_number AS pn, cls FROM body) q ON q.pn = p.page_number LEFT JOIN (SELECT DISTINCT sep, cls FROM body) s ON s.sep = p.separator)""", PARTS, recursive=True)
def read_delivery_index(spark, folder):
    parts = V.split_parts(sequence(spark, folder), 50)
    docs = writers.delivery_index_documents(parts, 50)
    # One document per part keeps every document bounded by the part size.
    path = scratch(spark, "index")
    docs.select(F.to_json(F.struct(F.lit(2).alias("version"), F.array(F.struct("pdf", "revisar", "paginas")).alias("partes"))).alias("value")).write.option("lineSep", readers.DOCUMENT_END).text(path)
    index = readers.read_delivery_index(spark, path)
    number = F.regexp_extract("pdf", r"-(\d+)\.pdf", 1).cast("long")
    return index.withColumn("part_pos", number - 1)


@register("write_delivery_index", "long part, long part_pos, string separador, long pagina", "SELECT part, part_pos, coalesce(separator, '') AS separador, page_number AS pagina FROM parts", PARTS, recursive=True)
def write_delivery_index(spark, folder):
    path = scratch(spark, "index")
    writers.write_delivery_index(V.split_parts(sequence(spark, folder), 50), path)
    return spark.read.schema("part long, part_pos long, separador string, archivo string, pagina long, revisar boolean").json(path)


def documents(spark, name, df):
    """Write one document per row of ``(block, value)``."""
    path = scratch(spark, name)
    df.repartition("block").write.partitionBy("block").text(path)
    return path


@register("read_ground_truth", "string file, string log_number, string date", """
SELECT CAST(page_number AS VARCHAR) AS file, log AS log_number, '20' || year || '/' || lpad(CAST(month_n AS VARCHAR), 2, '0') || '/' || day AS date FROM pages WHERE day IS NOT NULL AND month IS NOT NULL AND year IS NOT NULL AND log IS NOT NULL""", PAGES)
def read_ground_truth(spark, folder):
    """One truth document per thousand pages."""
    from foliant.functions import dates as T
    date = T.date_text(T.year_number(F.col("year")["value"]) + 2000, T.month_number(F.col("month")["value"]), T.day_number(F.col("day")["value"]))
    rows = D.pages(spark, folder).select(F.floor(F.col("page_number") / 1000).alias("block"), F.col("page_number").cast("string").alias("file"), F.col("log_number.value").alias("log_number"), date.alias("date"))
    docs = rows.where("log_number is not null and date is not null").groupBy("block").agg(
        F.to_json(F.struct(F.lit(1).alias("schema"), F.collect_list(F.struct("file", "log_number", "date")).alias("samples"))).alias("value"))
    return readers.read_ground_truth(spark, documents(spark, "truth", docs))


@register("read_labels", "string sample_id, string label", """
SELECT CAST(doc_id AS VARCHAR) AS sample_id, CASE WHEN quality = 1 THEN 'firma' ELSE 'ausente' END AS label FROM labels WHERE doc_id % 2 = 0 AND NOT (quality = 0 AND toxic = 1)""")
def read_labels(spark, folder):
    """Manifest and label documents per thousand ids; half of the labels are unknown words."""
    from foliant.operators.evaluate import labelled_samples
    sid = F.col("doc_id").cast("string")
    label = F.when(F.col("doc_id") % 2 == 1, "otra").when(F.col("quality") == 1, "firma").when(F.col("toxic") == 1, "dudosa").otherwise("ausente")
    rows = D.table(spark, folder, "labels").withColumn("block", F.floor(F.col("doc_id") / 1000))
    labels = rows.groupBy("block").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(sid, label))).alias("labels"))).alias("value"))
    item = F.struct(sid.alias("id"), F.lit("a.pdf").alias("pdf"), F.col("doc_id").alias("page"), F.lit("pilot_signature").alias("field_id"), F.lit("ok").alias("alignment"))
    manifest = rows.groupBy("block").agg(F.to_json(F.struct(F.collect_list(item).alias("samples"))).alias("value"))
    return labelled_samples(readers.read_samples(spark, documents(spark, "manifest", manifest)), readers.read_labels(spark, documents(spark, "labels", labels)))


@register("read_fleet_cache", "string registration, string fleet, string lessor", """
SELECT registration, 'F' || registration[4:4] AS fleet, '' AS lessor FROM fleet WHERE CAST(registration[4:7] AS INT) % 3 > 0""", PAGES + FLEET)
def read_fleet_cache(spark, folder):
    """Cache documents per leading digit; every third registration is written in a form that is not valid."""
    number = F.substring("registration", 4, 4)
    key = F.when(number.cast("int") % 3 > 0, F.lower("registration")).otherwise(F.concat(F.lit("XX"), number))
    rows = D.fleet(spark, folder).select(F.substring("registration", 4, 1).alias("block"), key.alias("key"), F.concat(F.lit("F"), F.substring("registration", 4, 1)).alias("fleet"))
    pairs = F.map_from_entries(F.collect_list(F.struct("key", F.struct("fleet"))))
    docs = rows.groupBy("block").agg(F.to_json(F.struct(F.lit(1).alias("version"), pairs.alias("matriculas"))).alias("value"))
    return readers.read_fleet_cache(spark, documents(spark, "cache", docs))


@register("feature_cache", "string setting, long samples, double peaks", """
SELECT s.setting, count(*) AS samples, round(sum(peak), 4) AS peaks FROM (SELECT l_orderkey, round(min(l_discount) * 100) * 2 / 100.0 AS peak FROM lineitem GROUP BY l_orderkey), (VALUES ('a'), ('b')) s(setting) GROUP BY s.setting""")
def feature_cache(spark, folder):
    """Two appends: half of the samples, then the ones still missing under each setting."""
    from catalog.evaluation import features
    from foliant.operators.evaluate import missing_features
    measured = features(spark, folder).select("sample_id", "peak")
    path = scratch(spark, "features")
    for setting in ("a", "b"):
        readers.append_features(measured.where("sample_id % 2 = 0").withColumn("setting", F.lit(setting)), path)
        rest = missing_features(measured, readers.read_feature_cache(spark, path), setting)
        readers.append_features(rest.withColumn("setting", F.lit(setting)), path)
    return readers.read_feature_cache(spark, path).groupBy("setting").agg(F.count("*").alias("samples"), F.round(F.sum("peak"), 4).alias("peaks"))


@register("write_grouped", "long export_no, string output, long pages", """
SELECT e.n AS export_no, CASE WHEN matricula IS NULL THEN 'revisar.pdf' ELSE mes_name || '.pdf' END AS output, count(*) AS pages FROM labels, (VALUES (1), (2)) e(n) WHERE matricula IS NULL OR NOT excluded GROUP BY ALL""", EXCLUDED)
def write_grouped(spark, folder):
    assigned = save(V.assign_groups(D.pages(spark, folder), ("mes",), excluded_pages(spark, folder)).select("page_number", "output"))
    path = scratch(spark, "groups")
    for _ in range(2):
        writers.write_grouped(assigned, path)
    return spark.read.parquet(path).groupBy("export_no", "output").agg(F.count("*").alias("pages"))


@register("write_review_csv", "string lote, string seq, string accion, string avisos", "SELECT 'LOTE -2' AS lote, CAST(seq AS VARCHAR) AS seq, accion, avisos FROM actions", PLAN)
def write_review_csv(spark, folder):
    from foliant.operators.reconcile import plan_rows
    path = scratch(spark, "review")
    writers.write_review_csv(plan_rows(plan(spark, folder)), path, "LOTE -2")
    return readers.read_run_csv(spark, path)


@register("write_stats", "string file, long total_pages, long blank_pages", "SELECT file, count(*) AS total_pages, count(*) FILTER (blank) AS blank_pages FROM pages GROUP BY file", PAGES)
def write_stats(spark, folder):
    path = scratch(spark, "stats")
    pages = D.pages(spark, folder)
    writers.write_stats({"header": R.run_header(pages), "files": S.file_summary(pages)}, path)
    return spark.read.json(f"{path}/files")


@register("run_outputs", "long complete, long minimal, long reports, long entries, long files", """
SELECT (SELECT count(*) FROM pages) AS complete, (SELECT count(*) FROM pages) AS minimal, (SELECT count(*) FROM pages) AS reports, (SELECT count(*) FROM pages WHERE NOT blank) AS entries, (SELECT count(DISTINCT file) FROM pages) AS files""", PAGES)
def run_outputs(spark, folder):
    path = scratch(spark, "run")
    O.run_outputs(save_rows(D.pages(spark, folder)), FIELDS, path, max_pages=200)
    counts = [readers.read_run_csv(spark, f"{path}/datos/completo").agg(F.count("*")).scalar().alias("complete"), readers.read_run_csv(spark, f"{path}/datos/minimo").agg(F.count("*")).scalar().alias("minimal"),
              readers.read_run_pages(spark, f"{path}/datos/json").agg(F.count("*")).scalar().alias("reports"),
              spark.read.json(f"{path}/datos/paginas").where("pagina is not null").agg(F.count("*")).scalar().alias("entries"), spark.read.json(f"{path}/stats/files").agg(F.count("*")).scalar().alias("files")]
    return spark.range(1).select(*counts)


@register("reexport", "long page, string log_number, string month", "SELECT page_number AS page, coalesce(log, '') AS log_number, coalesce(month, '') AS month FROM pages", PAGES)
def reexport(spark, folder):
    path = scratch(spark, "run")
    writers.write_run_json(D.pages(spark, folder), FIELDS, f"{path}/datos/json")
    O.reexport(spark, f"{path}/datos/json", FIELDS, f"{path}/again", data_only=True)
    return readers.read_run_csv(spark, f"{path}/again/datos/completo")


@register("ingest_stream", "long page_number, string file, string log", "SELECT page_number, file, log FROM pages", PAGES)
def ingest_stream(spark, folder):
    """Pages written as files and streamed into the page table."""
    source, table, state = (scratch(spark, n) for n in ("arrivals", "table", "state"))
    pages = D.pages(spark, folder)
    pages.write.parquet(source)
    I.ingest_stream(I.page_stream(spark, source, pages.schema), table, state).awaitTermination()
    return spark.read.parquet(table).select("page_number", "file", F.col("log_number.value").alias("log"))


@register("archive_committed", "long file_seq, long pages, long waiting, long failed", "SELECT file_seq, count(*) AS pages, 0 AS waiting, 0 AS failed FROM pages GROUP BY file_seq", PAGES)
def archive_committed(spark, folder):
    """After the stream has taken them in, all files lie in the archive and none in the source."""
    source, table, state, archive = (scratch(spark, n) for n in ("arrivals", "table", "state", "archive"))
    pages = D.pages(spark, folder)
    pages.write.parquet(source)
    I.ingest_stream(I.page_stream(spark, source, pages.schema), table, state).awaitTermination()
    failed = I.archive_committed(spark, table, source, archive)
    waiting = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source).select("path").count()
    moved = spark.read.schema(pages.schema).parquet(archive).groupBy("file_seq").agg(F.count("*").alias("pages"))
    return moved.select("file_seq", "pages", F.lit(waiting).alias("waiting"), F.lit(len(failed)).alias("failed"))


@register("correct_stream", "long page_number, string book, string date, string day, string year_method, long versions",
          "SELECT page_number, book, date, day, year_method, 1 AS versions FROM corrected", CORRECTED, recursive=True)
def correct_stream(spark, folder):
    """Two arrivals of the same books, and of pages without a number: every page once, corrected as in a run over the whole table."""
    source, table, state, output, redo = (scratch(spark, n) for n in ("arrivals", "table", "state", "corrected", "redo"))
    pages = D.pages(spark, folder)
    for part in (0, 1):
        pages.where(F.col("page_number") % 2 == part).write.mode("append").parquet(source)
        I.ingest_stream(I.page_stream(spark, source, pages.schema), table, state).awaitTermination()
        I.correct_stream(I.page_stream(spark, source, pages.schema), table, output, redo, FIELDS).awaitTermination()
    once = F.count("*").over(Window.partitionBy("page_number"))
    return I.current_pages(spark, output).select("page_number", "book", "date", F.col("day.value").alias("day"), F.col("year.inference_method").alias("year_method"), once.alias("versions"))


@register("correct_touched_books", "long page_number, string book, string date", """
SELECT page_number, book, date FROM corrected WHERE book IN (SELECT book FROM pages WHERE file_seq >= 17)""", CORRECTED, recursive=True)
def correct_touched_books(spark, folder):
    """The books of every page read from the last three files, corrected from the whole table."""
    source, table, state = (scratch(spark, n) for n in ("arrivals", "table", "state"))
    pages = D.pages(spark, folder)
    pages.write.parquet(source)
    I.ingest_stream(I.page_stream(spark, source, pages.schema), table, state).awaitTermination()
    return I.correct_touched_books(spark, table, pages.where("file_seq >= 17"), FIELDS)
