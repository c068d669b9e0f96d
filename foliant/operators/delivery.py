"""Ordered delivery: groups, sections, separators, parts and their coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.constants import NO_MONTH, NO_REGISTRATION, UNREADABLE_ORDER
from foliant.functions.dates import as_int, month_key, month_label, separator_label
from foliant.functions.fields import canonical_registration, log_number, log_order
from foliant.operators.books import PAGE_ID
from foliant.operators.skew import in_ranges, join_groups, positions

REVIEW_LABEL, DISCREPANCY_LABEL = "REVISAR", "POSIBLES DISCREPANCIAS"
REVIEW_FILE = "revisar.pdf"
CRITERIA = ("avion", "mes")


def page_keys(pages: DataFrame) -> DataFrame:
    """Non-blank pages with their registration, month and sort position."""
    return pages.where(~F.col("blank")).select(
        *PAGE_ID, "file", F.coalesce(canonical_registration(), F.lit(NO_REGISTRATION)).alias("avion"), month_key().alias("mes"),
        log_order(log_number(pages.columns)).alias("log_ord"))


def exclude(keys: DataFrame, excluded: DataFrame | None, keep: bool = False) -> DataFrame:
    """Drop (or keep only) the pages listed by (file, page_number)."""
    if excluded is None:
        return keys.where(F.lit(False)) if keep else keys
    return keys.join(excluded.select("file", "page_number").distinct(), ["file", "page_number"], "left_semi" if keep else "left_anti")


def assign_groups(pages: DataFrame, criteria: tuple[str, ...], excluded: DataFrame | None = None) -> DataFrame:
    """Page -> output file. Pages without a registration go to the review file, excluded ones nowhere."""
    unknown = [c for c in criteria if c not in CRITERIA]
    if unknown:
        raise ValueError(f"unknown criterion: {unknown[0]}")
    keys = page_keys(pages)
    grouped = exclude(keys.where(F.col("avion") != NO_REGISTRATION), excluded)
    parts = {"avion": F.col("avion"), "mes": month_label(F.col("mes"))}
    name = F.concat_ws("_", *[parts[c] for c in CRITERIA if c in criteria]) if criteria else F.lit("bitacoras")
    named = grouped.withColumn("output", F.concat(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), F.lit(".pdf")))
    return named.unionByName(keys.where(F.col("avion") == NO_REGISTRATION).withColumn("output", F.lit(REVIEW_FILE)))


def delivery_coverage(pages: DataFrame, criteria: tuple[str, ...], excluded: DataFrame | None = None) -> DataFrame:
    """Pages per output file with the batch's totals; ``left_over`` must be 0."""
    assigned = assign_groups(pages, criteria, excluded)
    total, valid = F.count("*"), F.count_if(~F.col("blank"))
    totals = pages.agg(F.struct(total.alias("total"), valid.alias("valid"))).scalar()
    dropped = exclude(page_keys(pages).where(F.col("avion") != NO_REGISTRATION), excluded, keep=True).agg(F.count("*")).scalar()
    placed = assigned.agg(F.count("*")).scalar()
    return assigned.groupBy("output").agg(F.count("*").alias("pages")).select(
        "*", placed.alias("distributed"), dropped.alias("excluded"), (totals["valid"] - dropped - placed).alias("left_over"))


def _section_columns(criteria: tuple[str, ...]) -> dict[str, Column]:
    """Sort columns and separator text of a section."""
    number = as_int(F.regexp_extract("avion", r"HP-(\d{4})(CMP|WWP)", 1))
    columns, label = {}, []
    if "avion" in criteria:
        columns |= {"s_number": F.coalesce(number, F.lit(UNREADABLE_ORDER)), "s_suffix": F.substring("avion", 8, 3)}
        label.append(F.when(F.col("avion") == NO_REGISTRATION, "SIN MATRICULA").otherwise(F.col("avion")))
    if "mes" in criteria:
        columns["s_month"] = F.when(F.col("mes") == NO_MONTH, "9999-99").otherwise(F.col("mes"))
        label.append(separator_label(F.col("mes")))
    empty = {"s_number": F.lit(0), "s_suffix": F.lit(""), "s_month": F.lit("")}
    return empty | columns | {"separator": F.concat_ws("\n", *label) if label else F.lit(None).cast("string")}


SECTION = ["s_class", "s_number", "s_suffix", "s_month"]
ENTRY_ORDER = [*SECTION, "body", "log_ord", *PAGE_ID]


def delivery_sequence(pages: DataFrame, criteria: tuple[str, ...] = (), excluded: DataFrame | None = None,
                      discrepancies_last: bool = False, with_review: bool = True) -> DataFrame:
    """Entries of the delivery in order (``pos`` from 1): section headers and pages.

    Sections follow registration number, suffix and month; then come the discrepancies (when
    asked for) and the pages to review.
    """
    keys = page_keys(pages)
    confirmed = keys.where(F.col("avion") != NO_REGISTRATION)
    sections = _section_columns(criteria)

    def plain(df: DataFrame, rank: int, label: str) -> DataFrame:
        return df.select("*", F.lit(rank).alias("s_class"), F.lit(0).alias("s_number"), F.lit("").alias("s_suffix"), F.lit("").alias("s_month"),
                         F.lit(label).alias("separator"))

    body = exclude(confirmed, excluded).select("*", F.lit(0).alias("s_class"), *[c.alias(n) for n, c in sections.items()])
    if discrepancies_last and excluded is not None:
        body = body.unionByName(plain(exclude(confirmed, excluded, keep=True), 1, DISCREPANCY_LABEL))
    if with_review:
        body = body.unionByName(plain(keys.where(F.col("avion") == NO_REGISTRATION), 2, REVIEW_LABEL))
    headers = body.where("separator is not null").groupBy(*SECTION, "separator").agg(F.count("*").alias("_n"))
    none = {"file_seq": "long", "page_number": "long", "file": "string", "log_ord": "long"}
    headers = headers.select(*SECTION, "separator", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(0).alias("body"))
    entries = body.select(*SECTION, "separator", *none, F.lit(1).alias("body")).unionByName(headers)
    numbered = positions(entries, ENTRY_ORDER, "pos")
    return numbered.select("pos", F.when(F.col("body") == 0, F.col("separator")).alias("separator"), *none, *SECTION, "body")


def _cut(size: int, header: bool, max_pages: int) -> tuple[int, int]:
    """How many parts a section takes that is too large for one, and how full it leaves the last."""
    repeat = bool(header) and max_pages > 1
    step, body = (max_pages - 1 if repeat else max_pages), size - int(header)
    pieces = -(-body // step)
    return pieces, body - (pieces - 1) * step + repeat


def _effect(max_pages: int):
    """What a range of sections does to any open part: the parts it adds, and how full the last is then, for each size from 0 to ``max_pages``."""
    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        parts, used = np.zeros(max_pages + 1, np.int64), np.arange(max_pages + 1)
        for size, header in zip(pdf["size"], pdf["header"]):
            if size > max_pages:
                pieces, left = _cut(size, header, max_pages)
                parts, used = parts + (used > 0) + pieces - 1, np.full(max_pages + 1, left)
            else:
                over = (used > 0) & (used + size > max_pages)
                parts, used = parts + over, np.where(over, size, used + size)
        return pd.DataFrame({"_chunk": [pdf["_chunk"].iloc[0]], "parts": [parts.tolist()], "used": [used.tolist()]})
    return effect


def _pack(max_pages: int):
    """Sections of a range in order -> first part number and the size that part already has."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        part, used, firsts, bases = int(pdf["part"].iloc[0]), int(pdf["used"].iloc[0]), [], []
        for size, header in zip(pdf["size"], pdf["header"]):
            if size > max_pages:
                # Too large for one part: cut, and leave the last piece open for what follows.
                pieces, left = _cut(size, header, max_pages)
                part += used > 0
                firsts.append(part)
                bases.append(0)
                part, used = part + pieces - 1, left
                continue
            if used and used + size > max_pages:
                part, used = part + 1, 0
            firsts.append(part)
            bases.append(used)
            used += size
        return pdf.drop(columns=["part", "used"]).assign(first_part=firsts, base=bases)
    return pack


def pack_sections(sections: DataFrame, max_pages: int) -> DataFrame:
    """``sections`` (``start, size, header``) with ``first_part`` and ``base``, the size of that part before them.

    Sections are packed range by range: each range is first summed up as a function of the open part that it meets, these
    functions are applied one after the other, and then every range packs its own sections from the part that reaches it.
    """
    ranges = in_ranges(sections, ["start"])
    effects = ranges.select("_chunk", "start", "size", "header").groupBy("_chunk").applyInPandas(_effect(max_pages), "_chunk int, parts array<long>, used array<long>")
    # One row per range, so the fold is over a few thousand rows at most.
    state = F.struct(F.lit(1).cast("long").alias("part"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<_chunk:int,part:bigint,used:bigint>>").alias("met"))

    def meet(s, e):
        at = s["used"].cast("int")
        return F.struct((s["part"] + F.get(e["parts"], at)).alias("part"), F.get(e["used"], at).alias("used"),
                        F.array_append(s["met"], F.struct(e["_chunk"].alias("_chunk"), s["part"].alias("part"), s["used"].alias("used"))).alias("met"))

    chain = effects.agg(F.array_sort(F.collect_list(F.struct("_chunk", "parts", "used"))).alias("effects"))
    met = chain.select(F.inline(F.aggregate("effects", state, meet)["met"]))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranges.schema)
    return ranges.join(F.broadcast(met), "_chunk").groupBy("_chunk").applyInPandas(_pack(max_pages), f"{types}, first_part long, base long").drop("_chunk")


def split_parts(sequence: DataFrame, max_pages: int = 0) -> DataFrame:
    """Delivery entries with ``part`` and ``part_pos``, at most ``max_pages`` per part (0: one part).

    Parts break between sections where possible. Section sizes are packed by ranges
    (``pack_sections``); the pages stay distributed.
    """
    sections = sequence.groupBy(*SECTION).agg(F.count("*").alias("size"), F.min("pos").alias("start"), (F.min("body") == 0).alias("header"))
    total = sequence.agg(F.count("*")).scalar()
    whole = F.lit(max_pages <= 0) | (total <= max_pages)
    if max_pages <= 0:
        return sequence.select("*", F.lit(1).alias("part"), F.col("pos").alias("part_pos"))
    placed = join_groups(sequence, pack_sections(sections, max_pages), SECTION, ["pos"], "inner", rows_in="size")
    big, header = F.col("size") > max_pages, F.col("header")
    repeat = big & header & F.lit(max_pages > 1)
    step = F.when(repeat, max_pages - 1).otherwise(max_pages)
    index = F.col("pos") - F.col("start") - header.cast("int")
    pieces = F.ceil((F.col("size") - header.cast("int")) / step)
    # A header opens every piece of a cut section, except with one page per part.
    copies = (F.when(big & (F.col("body") == 0), F.when(repeat, F.sequence(F.lit(0).cast("long"), pieces - 1)).otherwise(F.array().cast("array<bigint>")))
              .otherwise(F.array(F.when(big, F.floor(index / step)).otherwise(F.lit(0).cast("long")))))
    cut = placed.withColumn("_piece", F.explode(copies))
    inside = F.when(big, F.when(F.col("body") == 0, 1).otherwise(index % step + 1 + repeat.cast("int"))).otherwise(F.col("base") + F.col("pos") - F.col("start") + 1)
    return cut.select(*sequence.columns, F.when(whole, 1).otherwise(F.col("first_part") + F.col("_piece")).cast("long").alias("part"),
                      F.when(whole, F.col("pos")).otherwise(inside).cast("long").alias("part_pos"), whole.alias("_whole"), "_piece"
                      ).where(~F.col("_whole") | (F.col("_piece") == 0)).drop("_whole", "_piece")


def part_numbers(parts: DataFrame) -> DataFrame:
    """Number the parts of a run (``run, pos, is_review``): the review part is not counted."""
    order = Window.partitionBy("run").orderBy("pos")
    counted = F.when(~F.col("is_review"), 1).otherwise(0)
    return parts.select("*", F.sum(counted).over(order).alias("number"), F.sum(counted).over(Window.partitionBy("run")).alias("numbered_parts"))


def missing_files(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Files the delivery index names that are not in the folder listing."""
    return index.select("file").distinct().join(listing.select("file").distinct(), "file", "left_anti")
