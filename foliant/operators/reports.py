"""Wide output rows, table views and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.constants import DATE_FIELDS, NO_REGISTRATION, WARNING
from foliant.functions.dates import output_date
from foliant.operators.books import PAGE_ID, mark_duplicates
from foliant.operators.quality import discrepancy_flags, gated_value
from foliant.operators.skew import join_groups
from foliant.operators.summaries import counts_by_registration_and_month

METADATA = ("_conf", "_status", "_comment", "_source")
# Columns a summary view always has, and those it adds without a template (fixed values).
ROW_COLUMNS = ("file", "page", "date", "time_ms", "dup", "disc")
FALLBACK_COLUMNS = ("log_number", "matricula", "flight_number", "captain_license")


def output_columns(fields: dict[str, str]) -> list[str]:
    """Column order of the complete report."""
    columns = ["file", "page"]
    for field, kind in fields.items():
        columns += [field, *(["dup", "disc"] if field == "log_number" else []), field + "_conf",
                    *([] if kind == "signature" else [field + "_status", field + "_comment"]), field + "_source"]
    return columns + ([] if "dup" in columns else ["dup", "disc"]) + ["date", "time_ms"]


def wide_page_rows(pages: DataFrame, fields: dict[str, str], month_end: bool = False, files: DataFrame | None = None) -> DataFrame:
    """One report row per page, values gated to their canonical form, with the CSV date policy."""
    rows = discrepancy_flags(mark_duplicates(pages))
    factor = run_time_factor(pages, files) if files is not None else F.lit(1.0)
    if all(f in fields for f in DATE_FIELDS):
        rows = rows.withColumn("_policy", output_date(month_end))
    else:
        rows = rows.withColumn("_policy", F.lit(None).cast("struct<day:string,date:string,changed:boolean,reason:string>"))
    policy, moved = F.col("_policy"), F.coalesce(F.col("_policy")["changed"], F.lit(False))
    cells: dict[str, Column] = {"file": F.col("file"), "page": F.col("page_number"), "dup": F.col("dup").cast("string"),
                                "disc": F.col("discrepancy").cast("string"), "time_ms": F.bround(F.col("processing_ms") * factor, 1)}
    for field in fields:
        col = F.col(field)
        cells[field] = gated_value(field, col["value"])
        cells[field + "_conf"] = F.bround(col["confidence"], 3)
        for member in ("status", "comment", "source"):
            cells[f"{field}_{member}"] = F.coalesce(col[member], F.lit(""))
    if "day" in fields:
        shared = F.coalesce(F.least(*[F.col(f)["confidence"] for f in ("month", "year") if f in fields]), F.lit(0.0))
        for name, new in (("day", policy["day"]), ("day_conf", F.bround(shared, 3)), ("day_status", F.lit(WARNING)),
                          ("day_comment", policy["reason"]), ("day_source", F.lit("csv_date_policy"))):
            cells[name] = F.when(moved & F.col("day").isNotNull(), new).otherwise(cells[name])
    cells["date"] = F.coalesce(policy["date"], F.col("date"), F.lit(""))
    return rows.select(*[F.col(c).alias("_" + c) for c in PAGE_ID], *[cells[c].alias(c) for c in output_columns(fields)])


def default_minimum_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if not c.endswith(METADATA)]


def important_columns(columns: list[str], template: dict[str, tuple[str, bool]] | None = None) -> list[str]:
    """Summary columns: row ids plus required and signature fields (``template``: id -> type, required)."""
    if template is not None:
        wanted = {f for f, (kind, required) in template.items() if required or kind == "signature"}
        wanted |= {"captain_license", "flight_number"} & set(columns)
    else:
        wanted = {c for c in default_minimum_columns(columns) if c in FALLBACK_COLUMNS or c.endswith("_signature")}
        wanted |= set() if "date" in columns else set(DATE_FIELDS)
    if "date" in columns:
        wanted -= set(DATE_FIELDS)
    return [c for c in columns if c in ROW_COLUMNS or c in wanted]


def minimal_rows(complete: DataFrame, selected: tuple[str, ...] = ()) -> DataFrame:
    """Column subset of the complete report; file and page are always kept."""
    wanted = set(selected or default_minimum_columns(complete.columns)) | {"file", "page"}
    return complete.select(*[c for c in complete.columns if c in wanted])


def search_rows(df: DataFrame, text: str, columns: list[str], order: list[str]) -> DataFrame:
    """Rows with a cell equal to the text first, then those containing it, with the first such column."""
    needle = text.lower()

    def hit(c: str) -> Column:
        cell = F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
        return F.when(cell == needle, F.struct(F.lit(0).alias("match_class"), F.lit(c).alias("match_column"))).when(
            F.contains(cell, F.lit(needle)), F.struct(F.lit(1).alias("match_class"), F.lit(c).alias("match_column")))

    found = df.withColumn("_m", F.coalesce(*[hit(c) for c in columns])).where("_m is not null")
    return found.select("*", "_m.*").drop("_m").orderBy("match_class", *order)


def cell_status(column: str, columns: list[str]) -> Column:
    """Status shown for a cell of the wide report."""
    if column == "dup":
        return F.when(F.lower("dup") == "true", WARNING)
    suffix = next((s for s in METADATA if column.endswith(s) and column[:-len(s)] in columns), "")
    field = column[:-len(suffix)] if suffix else column
    status = F.upper(F.col(field + "_status")) if field + "_status" in columns else F.lit(None).cast("string")
    known = F.when(status.isin("OK", "WARNING", "ERROR"), status)
    if field.endswith("_signature"):
        value = F.lower(F.trim(F.col(field)))
        known = F.coalesce(known, F.when(value == "true", "OK").when(value == "unclear", "WARNING").when(value == "false", "ERROR"))
    return known


def sort_by_column(df: DataFrame, column: str, descending: bool, order: list[str]) -> DataFrame:
    """Numbers compare as numbers before text, text ignores case, empty cells stay last; ties keep batch order."""
    text = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    plain = F.when(text.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"), F.regexp_replace(text, "_", ""))
    number = plain.try_cast("double")
    number = F.when(F.abs(number) < float("inf"), number)
    direction = F.desc if descending else F.asc
    keyed = df.select("*", (text == "").alias("_blank"), F.when(number.isNull(), 1).otherwise(0).alias("_class"),
                      F.coalesce(number, F.lit(0.0)).alias("_number"), F.when(number.isNull(), F.lower(text)).otherwise("").alias("_text"))
    filled = [F.when(~F.col("_blank"), F.col(c)) for c in ("_class", "_number", "_text")]
    return keyed.orderBy("_blank", *[direction(c) for c in filled], *order).drop("_blank", "_class", "_number", "_text")


def review_worklist(readings: DataFrame, template: DataFrame, limit: int = 120) -> DataFrame:
    """Fields to read again: all dates first, then doubtful signatures and empty doubtful critical fields."""
    joined = readings.where(~F.col("blank")).join(F.broadcast(template.select("field_id", "postprocess", F.col("field_type").alias("t_type"))), "field_id")
    rule = F.coalesce(F.col("postprocess"), F.lit(""))
    dates = rule.isin(*DATE_FIELDS)
    signature = (F.col("t_type") == "signature") & (F.col("value") == "unclear")
    critical = ((F.col("t_type") != "signature") & rule.isin("matricula", "digits") & (F.col("status") != "OK")
                & (F.coalesce(F.col("value"), F.lit("")) == ""))
    return (joined.withColumn("priority", F.when(dates, 0).when(signature | critical, 1)).where("priority is not null")
            .orderBy("priority", *PAGE_ID, "field_pos").limit(limit).select("priority", *PAGE_ID, "field_id"))


def attach_source(rows: DataFrame, companion: DataFrame) -> DataFrame:
    """Source path of each report row (``pos, file, page``) from the companion (``pos, path, page``).

    By position if the whole batch agrees on file and page; otherwise by a (file, page) key that
    names a single path; otherwise null.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    source = companion.select("pos", "path", name.alias("_file"), F.col("page").cast("string").alias("_page"))
    left = rows.withColumn("_file", F.lower("file")).withColumn("_page", F.col("page").cast("string"))
    pairs = left.select("pos", "_file", "_page").join(source.select("pos", F.col("_file").alias("f"), F.col("_page").alias("p")), "pos", "full")
    aligned = pairs.agg(F.coalesce(F.bool_and(F.col("_file").eqNullSafe(F.col("f")) & F.col("_page").eqNullSafe(F.col("p"))), F.lit(True))).scalar()
    single = source.groupBy("_file", "_page").agg(F.count("*").alias("_n"), F.min("path").alias("_key_path")).where("_n = 1")
    by_pos = left.join(source.select("pos", F.col("path").alias("_pos_path")), "pos", "left").join(single, ["_file", "_page"], "left")
    return by_pos.withColumn("source_path", F.when(aligned, F.col("_pos_path")).otherwise(F.col("_key_path"))).drop("_file", "_page", "_n", "_key_path", "_pos_path")


def drop_pages(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Remove the pages named by ``keys`` (``path`` or null, ``file``, ``page_number``).

    A path always identifies its page; a bare file name only when no other file of the run has
    it. Removing everything is refused: the run is returned whole.
    """
    lowered = pages.withColumn("_path", F.lower("path")).withColumn("_file", F.lower("file"))
    names = lowered.groupBy("_file").agg(F.countDistinct("_path").alias("_paths"))
    named = join_groups(lowered, names, ["_file"], ["_path", "page_number"])
    by_path = keys.where("path is not null").select(F.lower("path").alias("_path"), "page_number", F.lit(True).alias("_hit_path")).distinct()
    by_file = keys.select(F.lower("file").alias("_file"), "page_number", F.lit(True).alias("_hit_file")).distinct()
    marked = named.join(by_path, ["_path", "page_number"], "left").join(by_file, ["_file", "page_number"], "left")
    gone = F.coalesce(F.col("_hit_path"), F.lit(False)) | ((F.col("_paths") == 1) & F.coalesce(F.col("_hit_file"), F.lit(False)))
    marked = marked.withColumn("_gone", gone)
    left_over = marked.agg(F.count_if(~F.col("_gone"))).scalar()
    return marked.where(~F.col("_gone") | (left_over == 0)).drop("_path", "_file", "_paths", "_hit_path", "_hit_file", "_gone")


def source_documents(rows: DataFrame) -> DataFrame:
    """Distinct source paths (``path, seq``), ignoring case, in first-seen order."""
    return rows.where("path <> ''").groupBy(F.lower("path").alias("key")).agg(F.min_by("path", "seq").alias("path"), F.min("seq").alias("seq")).orderBy("seq")


def discrepancy_stats(found: DataFrame) -> DataFrame:
    """Total and per-registration discrepancies (``level`` 0: registration, 1: total)."""
    registration = F.coalesce("registration", F.lit(NO_REGISTRATION))
    return found.select(registration.alias("registration"), "category").rollup("registration").agg(
        F.count("*").alias("total"), F.count_if(F.col("category") == "missing").alias("confirmed"),
        F.count_if(F.col("category") != "missing").alias("uncertain"), F.grouping_id().alias("level"))


def verifier_stats(runs: DataFrame) -> DataFrame:
    """Sums over the enabled second-reader rows, their models, and the first reason one was disabled."""
    on = F.col("enabled")
    counters = ("date_targets", "date_fields_resolved", "crops", "signatures_resolved", "fields_resolved")
    return runs.agg(
        F.coalesce(F.bool_or(on), F.lit(False)).alias("active"), F.count_if(on).alias("files"),
        F.sort_array(F.collect_set(F.when(on & (F.col("model") != ""), F.col("model")))).alias("models"),
        *[F.coalesce(F.sum(F.when(on, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).alias(c) for c in counters],
        F.min_by("disabled", F.when(F.col("disabled") != "", F.col("seq"))).alias("disabled_by"))


def run_wall_clock(files: DataFrame) -> DataFrame:
    """Milliseconds from first start to last end, or the sum when a file has no start stamp."""
    stamped = (F.col("started_at") > 0) & (F.col("processing_ms") > 0)
    span = (F.max(F.col("started_at") + F.col("processing_ms") / 1000.0) - F.min("started_at")) * 1000.0
    total = F.coalesce(F.sum("processing_ms"), F.lit(0.0))
    return files.agg(F.when((F.count("*") > 0) & (F.count_if(stamped) == F.count("*")), F.greatest(F.lit(0.0), span)).otherwise(total).alias("wall_ms"))


def run_time_factor(pages: DataFrame, files: DataFrame) -> Column:
    """Scale from measured page time to the run's clock (1 when there is nothing to compare)."""
    measured = pages.agg(F.coalesce(F.sum("processing_ms"), F.lit(0.0))).scalar()
    wall = run_wall_clock(files).scalar()
    return F.when((measured > 0) & (wall > 0), wall / measured).otherwise(F.lit(1.0))


def page_time_share(pages: DataFrame, files: DataFrame, per_file: bool = False) -> DataFrame:
    """``time_ms``: each page's time scaled to the clock of the run, or of its own file."""
    if not per_file:
        return pages.withColumn("time_ms", F.col("processing_ms") * run_time_factor(pages, files))
    sums = pages.groupBy("file_seq").agg(F.sum("processing_ms").alias("_measured"))
    clocks = sums.join(files.select("file_seq", F.col("processing_ms").alias("_clock")), "file_seq", "left")
    joined = join_groups(pages, clocks, ["file_seq"], PAGE_ID)
    usable = (F.col("_clock") > 0) & (F.col("_measured") > 0)
    scaled = F.when(usable, F.col("processing_ms") * F.col("_clock") / F.col("_measured")).otherwise(F.col("processing_ms"))
    return joined.withColumn("time_ms", scaled).drop("_measured", "_clock")


def run_header(pages: DataFrame) -> DataFrame:
    """One row of run totals."""
    return pages.agg(F.countDistinct("file_seq").alias("files"), F.count("*").alias("total_pages"),
                     F.count_if("blank").alias("blank_pages"), F.count_if(~F.col("blank")).alias("valid_pages"))


def run_stats(pages: DataFrame, name: str, found: DataFrame | None = None, files: DataFrame | None = None, runs: DataFrame | None = None,
              coverage: DataFrame | None = None) -> DataFrame:
    """The statistics of a run as one object (one row): totals, pages by registration and by month, discrepancies, the second reader's
    sums, the run's clock and the delivery's totals. Parts that are not given are null.

    Registrations and months are few by format; lists that grow with the run (its files, its outputs) stay tables of their own.
    """
    counts = counts_by_registration_and_month(pages)

    def by(level: int, key: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct(key, "pages"))))).alias(f"by_{key}")

    counted = counts.agg(F.struct(by(1, "registration"), by(2, "month"), *[F.coalesce(F.max(F.when(F.col("level") == 3, F.col(c))), F.lit(0).cast("long")).alias(c) for c in ("no_registration", "no_month")])).scalar()
    parts = {"counts": counted}
    if found is not None:
        each = F.struct("total", "confirmed", "uncertain")
        parts["discrepancies"] = discrepancy_stats(found).agg(F.struct(
            F.max(F.when(F.col("level") == 1, each)).alias("all"),
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("registration", each.alias("n")))))).alias("by_registration"))).scalar()
    if runs is not None:
        table = verifier_stats(runs)
        parts["verifier"] = table.select(F.struct(*table.columns)).scalar()
    if files is not None:
        parts["wall_ms"] = run_wall_clock(files).scalar()
    if coverage is not None:
        totals = [F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in ("distributed", "excluded", "left_over")]
        parts["delivery"] = coverage.agg(F.struct(F.count("*").alias("outputs"), *totals)).scalar()
    return run_header(pages).select(F.lit(name).alias("run"), F.current_timestamp().alias("made_at"), "*", *[c.alias(n) for n, c in parts.items()])
