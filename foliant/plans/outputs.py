"""Everything a finished run writes, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from foliant.operators import delivery, reports, summaries
from foliant.operators.quality import classify_discrepancies, sort_discrepancies
from foliant.session import save_rows
from foliant.sources import readers, writers


def run_outputs(pages: DataFrame, fields: dict[str, str], folder: str, criteria: tuple[str, ...] = ("avion", "mes"), single: bool = True,
                max_pages: int = 200, month_end: bool = False, exclude_discrepancies: bool = True, data_only: bool = False,
                selected: tuple[str, ...] = (), files: DataFrame | None = None, name: str = "", runs: DataFrame | None = None) -> None:
    """Complete and minimal CSV, JSON, delivery groups or parts with their index, and statistics.

    The pages feed every output, so callers pass a saved table (``session.save_rows`` or parquet).
    ``data_only`` keeps a cancelled run's data and skips the delivery. ``files`` has the clock of each file, ``runs`` what the
    second reader did (``reports.verifier_stats``).
    """
    # Five outputs use the discrepancies, which are few columns of wide pages.
    found = save_rows(classify_discrepancies(pages))
    excluded = found.select("file", "page_number") if exclude_discrepancies else None
    # Both reports are sorted and written from the same rows.
    rows = save_rows(reports.wide_page_rows(pages, fields, month_end, files))
    writers.write_complete_csv(rows, f"{folder}/datos/completo", mode="overwrite")
    writers.write_minimal_csv(rows, f"{folder}/datos/minimo", selected, mode="overwrite")
    writers.write_run_json(pages, fields, f"{folder}/datos/json", mode="overwrite")
    blocks = {"header": reports.run_header(pages), "counts": summaries.counts_by_registration_and_month(pages),
              "files": summaries.file_summary(pages), "discrepancies": reports.discrepancy_stats(found), "detail": sort_discrepancies(found)}
    if not data_only:
        if single or not criteria:
            sequence = delivery.delivery_sequence(pages, criteria, excluded, discrepancies_last=exclude_discrepancies)
            writers.write_delivery_index(delivery.split_parts(sequence, max_pages), f"{folder}/datos/paginas", mode="overwrite")
        else:
            writers.write_grouped(delivery.assign_groups(pages, criteria, excluded), f"{folder}/grupos")
        if criteria:
            blocks["delivery"] = delivery.delivery_coverage(pages, criteria, excluded)
    summary = reports.run_stats(pages, name, found, files, runs, blocks.get("delivery"))
    writers.write_stats(blocks, f"{folder}/stats", mode="overwrite", summary=summary)


def reexport(spark, json_path: str, fields: dict[str, str], folder: str, **options) -> None:
    """Read a run's reports back and write its outputs again."""
    pages = readers.wide_pages(readers.read_run_pages(spark, json_path), fields)
    order = pages.select("path").distinct()
    numbered = readers.positions(order, ["path"], "file_seq", start=0)
    # The reports are parsed once, not for every output.
    run_outputs(save_rows(pages.join(numbered, "path").drop("path")), fields, folder, **options)
