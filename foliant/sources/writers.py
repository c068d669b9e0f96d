"""Writers for run reports, delivery indexes and review tables."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.books import PAGE_ID
from foliant.operators.reports import minimal_rows


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Header CSV; with ``order`` the part files follow each other in that order."""
    rows = df if order is None else df.orderBy(*order).drop(*[c for c in order if c.startswith("_")])
    rows.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_complete_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Complete report in batch order (rows of ``wide_page_rows``)."""
    write_csv(rows, path, ["_" + c for c in PAGE_ID], mode)


def write_minimal_csv(rows: DataFrame, path: str, selected: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Column subset of the complete report; the unused columns are never computed."""
    keys = ["_" + c for c in PAGE_ID]
    chosen = minimal_rows(rows.drop(*keys), selected).columns
    write_csv(rows.select(*keys, *chosen), path, keys, mode)


def page_rows(pages: DataFrame, fields) -> DataFrame:
    """One row per page with its fields nested, under the file's path: a report's content, whatever its number of pages."""
    listed = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.col(f).withField("field_id", F.lit(f))) for f in fields]))
    printed = [c for c in pages.columns if c == "printed_number"]
    page = F.struct("page_number", *printed, "status", "blank", F.col("alignment").alias("alignment_quality"), "processing_ms", "date", listed.alias("fields"))
    return pages.select("file_seq", F.col("file").alias("pdf_path"), page.alias("page"))


def report_headers(pages: DataFrame, template: str | None = None) -> DataFrame:
    """One row per file: path, template, pages and their total time."""
    return (pages.groupBy("file_seq", F.col("file").alias("pdf_path"))
            .agg(F.count("*").alias("page_count"), F.sum("processing_ms").alias("processing_ms")).withColumn("template_name", F.lit(template)))


def write_run_json(pages: DataFrame, fields, path: str, mode: str = "errorifexists", template: str | None = None,
                   compression: str = "gzip") -> None:
    """A run as JSON rows: ``pages`` (one line per page, in file and page order) and ``headers`` (one line per file).

    A report is the header and the page lines of its path; no line grows with the pages of a file. The lines repeat their names
    and texts, so their files are compressed unless ``compression`` is "none"; the reader takes both.
    """
    page_rows(pages, fields).repartitionByRange("file_seq", "page.page_number").sortWithinPartitions("file_seq", "page.page_number").write.mode(mode).option("compression", compression).json(f"{path}/pages")
    report_headers(pages, template).write.mode(mode).json(f"{path}/headers")


def write_stats(blocks: dict[str, DataFrame], path: str, mode: str = "errorifexists", summary: DataFrame | None = None) -> None:
    """Statistics tables as JSON rows, one folder per block; the one-row ``summary`` as one object in ``stats``."""
    for name, block in blocks.items():
        block.write.mode(mode).json(f"{path}/{name}")
    if summary is not None:
        summary.coalesce(1).write.mode(mode).json(f"{path}/stats")


def index_rows(parts: DataFrame) -> DataFrame:
    """Delivery index as rows in order: part, position, separator or file and page, review flag."""
    return parts.select("part", "part_pos", F.coalesce("separator", F.lit("")).alias("separador"), F.coalesce("file", F.lit("")).alias("archivo"),
                        F.col("page_number").alias("pagina"), (F.col("s_class") == 2).alias("revisar"))


def write_delivery_index(parts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Index rows sorted by part and position; a part of any size stays distributed."""
    index_rows(parts).orderBy("part", "part_pos").write.mode(mode).json(path)


def delivery_index_documents(parts: DataFrame, max_pages: int) -> DataFrame:
    """Index documents (one per part, entries in order) for parts cut to ``max_pages``."""
    if max_pages <= 0:
        raise ValueError("documents need parts of a bounded size")
    entry = F.struct("part_pos", F.col("separador"), "archivo", "pagina")
    rows = index_rows(parts).groupBy("part").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.bool_and("revisar").alias("revisar"))
    entries = F.transform("e", lambda x: F.struct(x["separador"].alias("separador"), x["archivo"].alias("archivo"), x["pagina"].alias("pagina")))
    return rows.select("part", F.concat(F.lit("bitacoras -"), F.col("part").cast("string"), F.lit(".pdf")).alias("pdf"), "revisar", entries.alias("paginas"))


def write_review_csv(rows: DataFrame, path: str, batch: str | None = None, mode: str = "errorifexists") -> None:
    """Planned pages for review; with several batches their name leads (column ``lote``)."""
    named = rows if batch is None else rows.select(F.lit(batch).alias("lote"), *rows.columns)
    write_csv(named, path, ["pagina_lote"] if batch is None else ["lote", "pagina_lote"], mode)


def write_grouped(assigned: DataFrame, path: str) -> int:
    """Page lists partitioned by output under a new export number; earlier exports stay.

    A number is claimed by creating its file, which the store lets one writer do, so two exports at once get two numbers.
    """
    spark = assigned.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    claims = hadoop.Path(f"{path}/_claims")
    store = claims.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(claims)
    known = [f.getPath().getName() for folder in (claims.getParent(), claims) for f in store.listStatus(folder)]
    number = max((int(n.rpartition("=")[2]) for n in known if re.fullmatch(r"(export_no=)?\d+", n)), default=0)
    while True:
        number += 1
        try:
            store.create(hadoop.Path(claims, str(number)), False).close()
            break
        except Py4JJavaError as taken:
            if "FileAlreadyExists" not in str(taken.java_exception):
                raise
    # Rebalancing keeps one task per small output and splits an output that holds most of the pages.
    balanced = assigned.hint("rebalance", F.col("output"))
    # A folder of its own, so that exports at once do not share the committer's temporary files either.
    balanced.write.partitionBy("output").parquet(f"{path}/export_no={number}")
    return number
