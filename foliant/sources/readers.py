"""Readers for the files a run, its delivery and its remote index are described by."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.fields import READING
from foliant.functions.registrations import fleet_entry, index_registration
from foliant.functions.text import unescape_name
from foliant.operators.skew import positions

FIELD = f"struct<field_id:string,{READING.simpleString()[len('struct<'):]}"
PAGE = (f"struct<page_number:bigint,printed_number:bigint,status:string,blank:boolean,alignment_quality:string,processing_ms:double,discrepancy:boolean,"
        f"date:string,fields:array<{FIELD}>>")
REPORT = (f"pdf_path string, template_name string, processing_ms double, started_at double, cancelled boolean, pages array<{PAGE}>")


def read_run_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Report table with every column a text and empty cells as empty texts.

    ``multiline=False`` lets large files be split when no cell holds a line break.
    """
    df = spark.read.csv(path, header=True, multiLine=multiline, inferSchema=False, escape='"', encoding="UTF-8")
    if not df.columns:
        raise ValueError(f"no header in {path}")
    return df.na.fill("")


#: Ends a document in a file of several (RFC 7464). No JSON text can hold it unescaped.
DOCUMENT_END = "\x1e"


def read_run_json(spark: SparkSession, path: str, multiline: bool | None = None, sequence: bool = False) -> DataFrame:
    """Reports, one JSON document each (or a consolidated document with ``reportes``); ``unreadable_reports`` has the rest.

    ``multiline``: whether a document spans lines, as indented ones do; None looks at the first line, which is a whole
    document where each line is one. ``sequence``: files hold documents, of any number of lines, that ``DOCUMENT_END`` parts.
    """
    raw = _report_documents(spark, path, multiline, sequence).where("_unreadable IS NULL")
    single = F.when(F.col("pdf_path").isNotNull(), F.array(F.struct(*_report_names())))
    return raw.select(F.explode(F.coalesce("reportes", single)).alias("r")).select("r.*")


def unreadable_reports(spark: SparkSession, path: str, multiline: bool | None = None, sequence: bool = False) -> DataFrame:
    """(path, text) of what is no JSON document."""
    # Spark parses only if another column is asked for as well; this condition always holds.
    parsed = F.col("pdf_path").isNull() | (F.length("pdf_path") >= 0)
    return _report_documents(spark, path, multiline, sequence).where(F.col("_unreadable").isNotNull() & parsed).select(F.col("_metadata.file_path").alias("path"), F.col("_unreadable").alias("text"))


def _report_documents(spark: SparkSession, path: str, multiline: bool | None, sequence: bool) -> DataFrame:
    if multiline is None and not sequence:
        first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.get_json_object("value", "$").isNull()).first()
        multiline = bool(first and first[0])
    ended = {"lineSep": DOCUMENT_END} if sequence else {"multiLine": multiline}
    return spark.read.schema(f"{_consolidated()}, _unreadable string").json(path, **ended, mode="PERMISSIVE", columnNameOfCorruptRecord="_unreadable")


def read_run_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a run written by ``write_run_json``, as ``report_pages`` gives them."""
    rows = spark.read.schema(f"file_seq long, pdf_path string, page {PAGE}").json(f"{path}/pages", mode="FAILFAST")
    return rows.select(*_page_columns(F.col("page")))


def _report_names() -> list[str]:
    return ["pdf_path", "template_name", "processing_ms", "started_at", "cancelled", "pages"]


def _consolidated() -> str:
    inner = f"pdf_path:string,template_name:string,processing_ms:double,started_at:double,cancelled:boolean,pages:array<{PAGE}>"
    return f"{REPORT}, reportes array<struct<{inner}>>"


def _page_columns(page: Column) -> list[Column]:
    return [F.col("pdf_path").alias("path"), F.element_at(F.split("pdf_path", "/"), -1).alias("file"), page["page_number"].alias("page_number"), page["printed_number"].alias("printed_number"),
            F.coalesce(page["blank"], F.lit(False)).alias("blank"), F.coalesce(page["alignment_quality"], F.lit("ok")).alias("alignment"),
            page["status"].alias("status"), page["date"].alias("date"), page["processing_ms"].alias("processing_ms"), page["fields"].alias("fields")]


def report_pages(reports: DataFrame) -> DataFrame:
    """One row per page of the reports."""
    return reports.select("pdf_path", F.explode("pages").alias("p")).select(*_page_columns(F.col("p")))


def page_readings(pages: DataFrame) -> DataFrame:
    """One row per field of every page."""
    return pages.select("path", "file", "page_number", F.posexplode("fields").alias("field_pos", "f")).select(
        "path", "file", "page_number", "field_pos", "f.*")


def report_readings(reports: DataFrame) -> DataFrame:
    """One row per field of every page of the reports."""
    return page_readings(report_pages(reports))


def wide_pages(pages: DataFrame, fields) -> DataFrame:
    """Struct column per field from the nested field list (no shuffle)."""
    def pick(f: str) -> Column:
        found = F.get(F.filter("fields", lambda x: x["field_id"] == f), F.lit(0))
        return F.when(found.isNotNull(), F.struct(*[found[m.name].alias(m.name) for m in READING])).alias(f)

    return pages.select("*", *[pick(f) for f in fields]).drop("fields")


def _csv_listing(spark: SparkSession, root: str) -> DataFrame:
    """CSV files under a folder (names and times only; contents are not read)."""
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", "true").load(root)
               .select("path", "modificationTime"))
    base = root.rstrip("/")
    return listing.select("path", "modificationTime", F.split(F.regexp_replace("path", r"^.*?\Q" + base + r"/\E", ""), "/").alias("parts"))


def find_runs(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Run folders that hold a CSV (directly or in ``datos/``), newest first, ties by name descending."""
    parts = F.col("parts")
    own = (F.size(parts) == 2) | ((F.size(parts) == 3) & (F.lower(parts[1]) == "datos"))
    runs = _csv_listing(spark, root).where(own).groupBy(parts[0].alias("run")).agg(F.max("modificationTime").alias("modified"), F.count("*").alias("files"))
    newest = runs.orderBy(F.desc("modified"), F.desc(F.lower("run")))
    return newest.limit(limit) if limit else newest


def find_csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files in ``datos/`` and the folder itself, or anywhere below when there are none; by path, ignoring case."""
    parts = F.col("parts")
    near = (F.size(parts) == 1) | ((F.size(parts) == 2) & (F.lower(parts[0]) == "datos"))
    tiered = _csv_listing(spark, folder).withColumn("tier", F.when(near, 0).otherwise(1))
    best = tiered.agg(F.min("tier")).scalar()
    return tiered.where(F.col("tier") == best).select(F.array_join("parts", "/").alias("file")).distinct().orderBy(F.lower("file"))


def batch_inputs(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """Input files of a batch in name order with their ``file_seq`` (from 0); fails when there is none."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file"))
    if listing.isEmpty():
        raise ValueError(f"no input files in {path}")
    return positions(listing, ["file", "path"], "file_seq", start=0)


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole configuration documents as text."""
    return spark.read.text(path, wholetext=True)


def load_fleet(spark: SparkSession, path: str) -> DataFrame:
    """Valid distinct registrations of a fleet file: a list, or an object with one."""
    text = F.col("value")
    listed = F.coalesce(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), F.from_json(text, "struct<matriculas:array<string>>")["matriculas"])
    entries = _documents(spark, path).select(F.explode(listed).alias("v"))
    return entries.select(fleet_entry(F.col("v")).alias("registration")).where("registration is not null").distinct().orderBy("registration")


TEMPLATE = ("struct<name:string,version:string,fields:array<struct<id:string,type:string,required:boolean,x:double,y:double,w:double,h:double,regex:string,"
            "min_length:int,max_length:int,postprocess:string,localize:string,min_ink_ratio:double,max_ink_ratio:double,ink_delta:double,"
            "min_ink_peak:double,max_empty_peak:double,min_ink_span:double,sig_present_conf:double,sig_absent_conf:double>>>")


def load_template(spark: SparkSession, path: str) -> DataFrame:
    """Field definitions of a form, one row per field with its position."""
    return (_documents(spark, path).select(F.from_json("value", TEMPLATE).alias("t")).select(F.col("t.name").alias("template_name"), F.posexplode("t.fields").alias("field_pos", "f"))
            .select("template_name", "field_pos", F.col("f.id").alias("field_id"), F.col("f.type").alias("field_type"), "f.*").drop("id", "type"))


def template_problems(template: DataFrame) -> DataFrame:
    """Reasons a template cannot be used: repeated ids, boxes outside the page, inverted limits, bad patterns."""
    repeated = template.groupBy("field_id").count().where("count > 1").select("field_id", F.lit("duplicate id").alias("problem"))
    f = {c: F.col(c) for c in ("x", "y", "w", "h", "min_ink_ratio", "max_ink_ratio", "min_ink_peak", "max_empty_peak", "min_length", "max_length")}
    outside = (f["x"] < 0) | (f["y"] < 0) | (f["w"] <= 0) | (f["h"] <= 0) | (f["x"] + f["w"] > 1) | (f["y"] + f["h"] > 1)
    checks = ((outside, "box outside the page"), (f["min_ink_ratio"] > f["max_ink_ratio"], "inverted ink ratios"),
              (f["max_empty_peak"] > f["min_ink_peak"], "inverted ink peaks"), (f["min_length"] > f["max_length"], "inverted lengths"),
              (~F.coalesce(F.col("field_type"), F.lit("")).isin("ocr", "text", "date", "signature", "checkbox"), "unknown type"))
    rows = template.select("field_id", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))).alias("problem"))
    return repeated.unionByName(rows).unionByName(template.select("field_id", "regex").mapInPandas(_bad_patterns, "field_id string, problem string"))


def _bad_patterns(parts):
    """Fields whose pattern does not compile; a template has a few dozen fields."""
    for fields in parts:
        bad = []
        for pattern in fields["regex"]:
            try:
                re.compile(pattern or "")
                bad.append(False)
            except re.error:
                bad.append(True)
        yield fields.loc[bad, ["field_id"]].assign(problem="pattern does not compile")


ENTRY = "struct<separador:string,archivo:string,pagina:string>"


def read_delivery_index(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a delivery index (both versions): part, position, separator or file and page, review flag; empty parts drop out.

    A file is a document, or several that ``DOCUMENT_END`` parts.
    """
    part = f"struct<pdf:string,revisar:boolean,paginas:array<{ENTRY}>>"
    doc = F.from_json("value", f"struct<version:int,partes:array<{part}>,pdf:string,paginas:array<{ENTRY}>>")
    docs = spark.read.text(path, lineSep=DOCUMENT_END).select(doc.alias("d"))
    whole = F.array(F.struct(F.coalesce("d.pdf", F.lit("")).alias("pdf"), F.lit(False).alias("revisar"), F.col("d.paginas").alias("paginas")))
    parts = docs.select(F.posexplode(F.coalesce("d.partes", whole)).alias("part_pos", "p")).where(F.size("p.paginas") > 0)
    return parts.select("part_pos", F.col("p.pdf").alias("pdf"), F.coalesce("p.revisar", F.lit(False)).alias("is_review"), F.posexplode("p.paginas").alias("i", "e")).select(
        "part_pos", "pdf", "is_review", (F.col("i") + 1).alias("seq"), F.coalesce("e.separador", F.lit("")).alias("separator"),
        F.coalesce("e.archivo", F.lit("")).alias("file"), F.coalesce(F.col("e.pagina").try_cast("long"), F.lit(0)).alias("page"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    doc = F.from_json("value", "struct<samples:array<struct<file:string,log_number:string,date:string>>>")
    return _documents(spark, path).select(F.inline(doc["samples"]))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of labelled crops in order (``sample_seq``)."""
    item = "struct<id:string,pdf:string,page:bigint,field_id:string,file:string,dpi:int,alignment:string,rect:array<int>>"
    doc = F.from_json("value", f"struct<samples:array<{item}>>")
    return _documents(spark, path).select(F.posexplode(doc["samples"]).alias("sample_seq", "s")).select("sample_seq", F.col("s.id").alias("sample_id"), "s.*").drop("id")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Human labels (``sample_id, label``); unknown labels are dropped."""
    doc = F.from_json("value", "struct<labels:map<string,string>>")
    return (_documents(spark, path).select(F.explode(doc["labels"]).alias("sample_id", "label")).where(F.col("label").isin("firma", "ausente", "dudosa")))


def read_fleet_cache(spark: SparkSession, path: str) -> DataFrame:
    """registration -> fleet, lessor; invalid registrations are dropped."""
    pair = "map<string,struct<fleet:string,lessor:string>>"
    doc = F.coalesce(F.from_json("value", f"struct<matriculas:{pair}>")["matriculas"], F.from_json("value", pair))
    return (_documents(spark, path).select(F.explode(doc).alias("k", "v"))
            .select(index_registration(F.col("k")).alias("registration"), F.coalesce("v.fleet", F.lit("")).alias("fleet"), F.coalesce("v.lessor", F.lit("")).alias("lessor"))
            .where("registration <> ''"))


# Columns of a batch listing, in the order of its positional form.
BATCH_COLUMNS = ("batchid", "userbatchname", "imagecount", "appid", "appname", "eventlabel", "lockedusername", "batchreceivedate")


def remote_batches(raw: DataFrame) -> DataFrame:
    """Batch listing from rows whose ``cell`` is a JSON object or a positional list; bad integers are 0."""
    named, listed = F.from_json("cell", "map<string,string>"), F.from_json("cell", "array<string>")

    def cell(name: str) -> Column:
        by_name = F.try_element_at(named, F.lit(name))
        return F.trim(F.coalesce(F.when(F.startswith(F.trim("cell"), F.lit("[")), F.get(listed, F.lit(BATCH_COLUMNS.index(name)))).otherwise(by_name), F.lit("")))

    def number(name: str) -> Column:
        return F.coalesce(cell(name).try_cast("long"), F.lit(0))

    return raw.select(cell("batchid").alias("batch_id"), unescape_name(cell("userbatchname")).alias("name"), number("imagecount").alias("pages"),
                      number("appid").alias("repo_id"), cell("appname").alias("repository"), cell("eventlabel").alias("step"),
                      cell("lockedusername").alias("locked_by"), cell("batchreceivedate").alias("received"))


def picklist_values(views: DataFrame, field_id: int) -> DataFrame:
    """Values of the first view (``view_no, field_id, items``) that names the field and has any."""
    named = views.where((F.col("field_id").cast("string") == str(field_id)))
    items = named.select("view_no", F.posexplode("items").alias("item_no", "value")).where("value <> ''")
    first = items.agg(F.min("view_no")).scalar()
    return items.where(F.col("view_no") == first).select(F.trim("value").alias("value"), "item_no")


def read_feature_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored measurements, partitioned by crop setting."""
    return spark.read.parquet(path)


def append_features(measured: DataFrame, path: str) -> None:
    measured.write.mode("append").partitionBy("setting").parquet(path)
