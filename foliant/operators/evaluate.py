"""Scoring against human labels, threshold tuning and the per-book signature band."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.constants import (COST_FALSE_ABSENT, COST_FALSE_PRESENT, COST_UNCLEAR, EMPTY_GRID, MAX_INK_RATIO, MIN_RESOLVED, PEAK_GRID, SPAN_GRID)
from foliant.operators.quality import signature_verdict, verdict_status
from foliant.operators.skew import in_ranges, join_groups

PRESENT, ABSENT, UNSURE = "firma", "ausente", "dudosa"
FEATURES = ("peak", "weak_peak", "coverage", "span", "dark_ratio")


def labelled_samples(samples: DataFrame, labels: DataFrame, include_unsure: bool = False) -> DataFrame:
    """Samples with a known label (``sample_id, label``)."""
    wanted = [PRESENT, ABSENT] + ([UNSURE] if include_unsure else [])
    return samples.join(labels.where(F.col("label").isin(*wanted)), "sample_id")


def missing_features(samples: DataFrame, cached: DataFrame, setting: str) -> DataFrame:
    """Samples not yet measured under a crop setting."""
    return samples.join(cached.where(F.col("setting") == setting).select("sample_id"), "sample_id", "left_anti")


def _score_columns(label: Column, verdict: Column) -> dict[str, Column]:
    known = label.isin(PRESENT, ABSENT) & verdict.isNotNull()
    present, absent = known & (label == PRESENT), known & (label == ABSENT)
    unclear = verdict == "unclear"
    return {"total": F.count_if(known), "correct": F.count_if((present & (verdict == "true")) | (absent & (verdict == "false"))),
            "false_present": F.count_if(absent & (verdict == "true")), "false_absent": F.count_if(present & (verdict == "false")),
            "unclear_present": F.count_if(present & unclear), "unclear_absent": F.count_if(absent & unclear)}


def mean_cost() -> Column:
    cost = (F.col("false_present") * COST_FALSE_PRESENT + F.col("false_absent") * COST_FALSE_ABSENT
            + (F.col("unclear_present") + F.col("unclear_absent")) * COST_UNCLEAR)
    return F.when(F.col("total") > 0, cost / F.col("total"))


def score_verdicts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits, mistakes and mean cost of ``verdict`` against ``label``; doubtful labels do not count."""
    counts = _score_columns(F.col("label"), F.col("verdict"))
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()]).withColumn("cost", mean_cost())


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", F.coalesce("verdict", F.lit("None")).alias("verdict")).agg(F.count("*").alias("samples"))


# Threshold search. Every measurement matters only through the grid steps it has passed, so
# the samples are counted per step first: the search then runs on a table whose size is fixed
# by the grid (31 x 12 cells x 3 flags), however many samples there are.
PEAK_STEPS = tuple(sorted({*PEAK_GRID, *EMPTY_GRID}))
CELL = ["peak_step", "span_step", "usable", "guarded", "present"]


def _steps_passed(value: Column, grid: tuple[float, ...]) -> Column:
    return sum((value >= g).cast("int") for g in grid)


def threshold_cells(features: DataFrame, keys: list[str], max_dark: float = MAX_INK_RATIO) -> DataFrame:
    """Labelled samples counted per grid cell and key."""
    usable = F.col("peak").isNotNull() & (F.col("dark_ratio") <= max_dark)
    guarded = (F.col("coverage") < 0.03) & (F.col("weak_peak") < 0.08)
    cells = features.where(F.col("label").isin(PRESENT, ABSENT)).select(
        *keys, F.coalesce(_steps_passed(F.col("peak"), PEAK_STEPS), F.lit(0)).alias("peak_step"),
        F.coalesce(_steps_passed(F.col("span"), SPAN_GRID), F.lit(0)).alias("span_step"),
        F.coalesce(usable, F.lit(False)).alias("usable"), F.coalesce(guarded, F.lit(False)).alias("guarded"), (F.col("label") == PRESENT).alias("present"))
    return cells.groupBy(*keys, *CELL).agg(F.count("*").alias("n"))


TUNED = ("min_ink_peak double, max_empty_peak double, min_ink_span double, total long, correct long, false_present long, "
         "false_absent long, unclear_present long, unclear_absent long, cost double, resolved boolean")


def _search(cells: pd.DataFrame, min_resolved: float) -> tuple:
    """First cheapest (peak, empty, span) of the grid among those that resolve enough samples."""
    shape = (len(PEAK_STEPS) + 1, len(SPAN_GRID) + 1)
    used, low = np.zeros((2, *shape), dtype=np.int64), np.zeros((2, shape[0]), dtype=np.int64)
    present = cells["present"].to_numpy(dtype=int)
    peak, span, n = (cells[c].to_numpy(dtype=np.int64) for c in ("peak_step", "span_step", "n"))
    usable, guarded = cells["usable"].to_numpy(dtype=bool), cells["guarded"].to_numpy(dtype=bool)
    np.add.at(used, (present[usable], peak[usable], span[usable]), n[usable])
    empty = usable & guarded
    np.add.at(low, (present[empty], peak[empty]), n[empty])
    totals = np.bincount(present, weights=n, minlength=2).astype(np.int64)
    at_least = used[:, ::-1, ::-1].cumsum(axis=1).cumsum(axis=2)[:, ::-1, ::-1]
    below = np.concatenate([np.zeros((2, 1), dtype=np.int64), low.cumsum(axis=1)], axis=1)
    p, e, s = (a.ravel() for a in np.meshgrid(*[np.arange(len(g)) for g in (PEAK_GRID, EMPTY_GRID, SPAN_GRID)], indexing="ij"))
    keep = np.array(EMPTY_GRID)[e] <= np.array(PEAK_GRID)[p]
    p, e, s = p[keep], e[keep], s[keep]
    hi = np.array([PEAK_STEPS.index(g) for g in PEAK_GRID])[p] + 1
    lo = np.array([PEAK_STEPS.index(g) for g in EMPTY_GRID])[e] + 1
    yes = at_least[:, hi, 0] + at_least[:, lo, s + 1] - at_least[:, hi, s + 1]
    no = below[:, lo]
    unclear = totals[:, None] - yes - no
    cost = COST_FALSE_PRESENT * yes[0] + COST_FALSE_ABSENT * no[1] + COST_UNCLEAR * unclear.sum(axis=0)
    total = int(totals.sum())
    enough = (total - unclear.sum(axis=0)) / total >= min_resolved
    pool = np.flatnonzero(enough) if enough.any() else np.arange(len(cost))
    best = pool[np.argmin(cost[pool])]
    return (PEAK_GRID[p[best]], EMPTY_GRID[e[best]], SPAN_GRID[s[best]], total, int(yes[1, best] + no[0, best]), int(yes[0, best]), int(no[1, best]),
            int(unclear[1, best]), int(unclear[0, best]), float(cost[best] / total), bool(enough.any()))


def tune_cells(cells: DataFrame, keys: list[str], min_resolved: float = MIN_RESOLVED) -> DataFrame:
    """Best thresholds per key from cell counts."""
    names = [c.split()[0] for c in TUNED.split(", ")]
    if not keys:
        return tune_cells(cells.withColumn("_all", F.lit(0)), ["_all"], min_resolved).drop("_all")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = [*pdf[keys].iloc[0], *_search(pdf, min_resolved)]
        return pd.DataFrame([row], columns=[*keys, *names])

    return cells.groupBy(*keys).applyInPandas(solve, f"{schema}, {TUNED}")


def tune_thresholds(features: DataFrame, keys: tuple[str, ...] = (), min_resolved: float = MIN_RESOLVED) -> DataFrame:
    """Best thresholds (per key) over the grid of peak, empty-peak and span limits."""
    return tune_cells(threshold_cells(features, list(keys)), list(keys), min_resolved)


def tune_over_settings(features: DataFrame, current: tuple[float, float, float], min_resolved: float = MIN_RESOLVED) -> DataFrame:
    """Best crop setting (``pad_x, pad_y, delta``), preferring the current one unless strictly better, and the
    best one that keeps the current margins (``applicable``)."""
    pad_x, pad_y, delta = current
    tuned = tune_thresholds(features, ("pad_x", "pad_y", "delta"), min_resolved)
    same = (F.col("pad_x") == pad_x) & (F.col("pad_y") == pad_y)
    # Costs are ratios of integers over one common sample count; rounding makes ties exact.
    # One row per crop setting: a handful.
    order = F.struct(F.round("cost", 12), (~same).cast("int"), F.abs(F.col("delta") - delta), "pad_x", "pad_y", "delta")
    row = F.struct(*tuned.columns)
    picked = tuned.agg(F.min_by(row, order).alias("best"), F.min_by(F.when(same, row), F.when(same, order)).alias("applicable"))
    return picked.select(F.inline(F.array(
        F.struct(F.lit("best").alias("choice"), *[F.col("best")[c].alias(c) for c in tuned.columns]),
        F.struct(F.lit("applicable").alias("choice"), *[F.col("applicable")[c].alias(c) for c in tuned.columns]))))


def tune_fields(features: DataFrame, min_samples: int = 40, min_resolved: float = MIN_RESOLVED) -> DataFrame:
    """Own thresholds of every field with enough labelled samples."""
    cells = threshold_cells(features, ["field_id"])
    enough = cells.groupBy("field_id").agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_samples).select("field_id")
    return tune_cells(cells.join(enough, "field_id", "left_semi"), ["field_id"], min_resolved)


def with_folds(samples: DataFrame, k: int, order: str = "sample_seq") -> DataFrame:
    """Round-robin folds inside each (field, label), in sample order.

    The running number comes from counts per range of the order, so that a label holding most
    of the samples is not numbered in one task.
    """
    groups = ["field_id", "label"]
    ranged = in_ranges(samples, [*groups, order])
    sizes = ranged.groupBy(*groups, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_chunk")) - F.col("_n")
    offsets = sizes.select(*groups, "_chunk", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*groups, "_chunk").orderBy(order))
    return (ranged.withColumn("_rank", rank).join(F.broadcast(offsets), [*groups, "_chunk"])
            .withColumn("fold", ((F.col("_before") + F.col("_rank") - 1) % k).cast("int")).drop("_chunk", "_rank", "_before"))


def cross_validate(features: DataFrame, k: int, min_resolved: float = MIN_RESOLVED) -> DataFrame:
    """Tune on all folds but one, score on that one; one row per fold."""
    cells = threshold_cells(with_folds(features, k), ["fold"])
    # Every fold's cells serve the k-1 searches that leave another fold out.
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    training = (cells.withColumn("test_fold", F.explode(others)).groupBy("test_fold", *CELL).agg(F.sum("n").alias("n")))
    tuned = tune_cells(training, ["test_fold"], min_resolved).select("test_fold", "min_ink_peak", "max_empty_peak", "min_ink_span")
    step = {g: i + 1 for i, g in enumerate(PEAK_STEPS)}
    limits = tuned.select("test_fold", "min_ink_peak", "max_empty_peak", "min_ink_span",
                          *[F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(c)].alias(n) for c, n, table in (
                              ("min_ink_peak", "hi", step), ("max_empty_peak", "lo", step), ("min_ink_span", "wide", {g: i + 1 for i, g in enumerate(SPAN_GRID)}))])
    scored = cells.join(F.broadcast(limits), cells["fold"] == limits["test_fold"])
    yes = F.col("usable") & ((F.col("peak_step") >= F.col("hi")) | ((F.col("peak_step") >= F.col("lo")) & (F.col("span_step") >= F.col("wide"))))
    no = F.col("usable") & ~yes & (F.col("peak_step") < F.col("lo")) & F.col("guarded")
    n, present = F.col("n"), F.col("present")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    return scored.groupBy("test_fold", "min_ink_peak", "max_empty_peak", "min_ink_span").agg(
        F.sum("n").alias("total"), total((present & yes) | (~present & no)).alias("correct"), total(~present & yes).alias("false_present"),
        total(present & no).alias("false_absent"), total(present & ~yes & ~no).alias("unclear_present"),
        total(~present & ~yes & ~no).alias("unclear_absent")).withColumn("cost", mean_cost())


def serious_errors(rows: DataFrame, limit: int) -> DataFrame:
    """First samples whose verdict is the opposite of their label."""
    kind = (F.when((F.col("label") == PRESENT) & (F.col("verdict") == "false"), "false_absent")
            .when((F.col("label") == ABSENT) & (F.col("verdict") == "true"), "false_present"))
    return rows.withColumn("kind", kind).where("kind is not null").orderBy("sample_seq").limit(limit).select("sample_seq", "sample_id", "kind")


MIN_BAND_PAGES, MAX_OUTLIERS, MIN_BAND = 3, 2, 0.03


def uncertain_band(rows: DataFrame) -> DataFrame:
    """Per book and field (``book, field_id, peak, verdict``): the band between empty and signed boxes.

    Only the three extreme values of each class matter, so each task passes on at most three
    rows per group. Fewer extremes are dropped first; the first band wide enough wins, else the widest.
    """
    known = rows.where(F.col("peak").isNotNull() & F.col("verdict").isin("true", "false")).select(
        "book", "field_id", "verdict", F.when(F.col("verdict") == "true", F.col("peak")).otherwise(-F.col("peak")).alias("v"))
    counts = known.groupBy("book", "field_id").agg(F.count_if(F.col("verdict") == "true").alias("signed"), F.count_if(F.col("verdict") == "false").alias("empty"))
    rank = F.row_number().over(Window.partitionBy("book", "field_id", "verdict").orderBy("v"))
    extremes = known.withColumn("r", rank).where(F.col("r") <= MAX_OUTLIERS + 1).groupBy("book", "field_id").agg(
        *[F.max(F.when((F.col("verdict") == c) & (F.col("r") == i + 1), F.abs("v"))).alias(f"{c}{i}") for c in ("true", "false") for i in range(MAX_OUTLIERS + 1)])
    options = [(signed, dropped - signed) for dropped in range(2 * MAX_OUTLIERS + 1) for signed in range(min(dropped, MAX_OUTLIERS) + 1) if dropped - signed <= MAX_OUTLIERS]
    bands = F.array_compact(F.array(*[F.when(
        (F.col("signed") - s >= MIN_BAND_PAGES) & (F.col("empty") - e >= MIN_BAND_PAGES) & (F.col(f"true{s}") > F.col(f"false{e}")),
        F.struct((F.col(f"true{s}") - F.col(f"false{e}")).alias("width"), F.lit(-i).alias("order"), F.col(f"false{e}").alias("ceiling"), F.col(f"true{s}").alias("floor")))
        for i, (s, e) in enumerate(options)]))
    wide = F.filter("_bands", lambda b: b["width"] >= MIN_BAND)
    return (counts.join(extremes, ["book", "field_id"]).withColumn("_bands", bands)
            .withColumn("_band", F.coalesce(F.get(wide, F.lit(0)), F.array_max("_bands"))).where("_band is not null")
            .select("book", "field_id", "_band.ceiling", "_band.floor"))


def signature_review(rows: DataFrame, band: DataFrame, required: Column | None = None, min_pages: int = 8) -> DataFrame:
    """Second opinion on unclear signatures (``book, field_id, page_number, alignment, blank, value,
    confidence, peak``) outside their book's band, in books with enough aligned pages."""
    usable = ~F.col("blank") & (F.col("alignment") == "ok")
    # Each page has one row per signature field: the rows of any field count the book's pages.
    counts = rows.groupBy("book", "field_id").agg(F.count_if(usable).alias("_pages"), F.count("*").alias("_rows"))
    pages = counts.groupBy("book").agg(F.max("_pages").alias("_pages"), F.sum("_rows").alias("_rows"))
    # Pages without a readable number are one book, which may hold a large share of them.
    joined = join_groups(rows.join(band, ["book", "field_id"], "left"), pages, ["book"], ["page_number", "field_id"], rows_in="_rows")
    peak, floor, ceiling = F.col("peak"), F.col("floor"), F.col("ceiling")
    open_case = (F.col("value") == "unclear") & (F.col("alignment") == "ok") & (F.col("_pages") >= min_pages)
    signed, empty = open_case & (peak >= floor), open_case & (peak <= ceiling)
    def sure(distance: Column) -> Column:
        return F.bround(F.round(F.least(F.lit(0.90), 0.72 + 0.18 * F.least(F.lit(1.0), distance)), 9), 3)
    reviewed = F.when(signed, "true").when(empty, "false").otherwise(F.col("value"))
    confidence = (F.when(signed, sure((peak - floor) / F.greatest(floor, F.lit(1e-6))))
                  .when(empty, sure((ceiling - peak) / F.greatest(ceiling, F.lit(1e-6)))).otherwise(F.col("confidence")))
    return joined.select(*rows.columns, reviewed.alias("reviewed"), confidence.alias("reviewed_confidence"),
                         F.when(signed | empty, verdict_status(reviewed, F.lit(False) if required is None else required)).alias("reviewed_status"))


def tally_before_after(rows: DataFrame) -> DataFrame:
    """Right, unclear and seriously wrong verdicts before and after review, per book and in total."""
    labelled = rows.where(F.col("label").isin(PRESENT, ABSENT)).withColumn("_want", F.when(F.col("label") == PRESENT, "true").otherwise("false"))
    columns = []
    for stage in ("verdict", "reviewed"):
        v = F.col(stage)
        columns += [F.count_if(v == F.col("_want")).alias(f"{stage}_correct"), F.count_if((v != F.col("_want")) & (v == "unclear")).alias(f"{stage}_unclear"),
                    F.count_if((v != F.col("_want")) & (v != "unclear")).alias(f"{stage}_serious")]
    return labelled.rollup("book").agg(F.grouping_id().alias("level"), *columns)


def date_accuracy(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Exact dates and exact parts of predictions (``file, date``) against the labelled truth."""
    joined = truth.select("file", F.col("date").alias("want")).join(predictions.select("file", F.col("date").alias("got")), "file", "left")
    def part(name: str, i: int) -> Column:
        pieces = F.split(F.col(name), "/")
        return F.when(F.size(pieces) == 3, F.get(pieces, F.lit(i)))
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("got") == F.col("want")).alias("date_exact"),
                      F.count_if(F.coalesce(F.col("got"), F.lit("")) != "").alias("date_detected"),
                      *[F.count_if(part("want", i).eqNullSafe(part("got", i))).alias(n) for i, n in enumerate(("year_exact", "month_exact", "day_exact"))])


def classify_features(features: DataFrame, **kwargs) -> DataFrame:
    """Add ``verdict`` (null when unmeasured) to feature rows."""
    return features.withColumn("verdict", signature_verdict(**kwargs)["value"])
