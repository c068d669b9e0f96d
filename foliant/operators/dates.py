"""Date inference along the printed page numbers of a book.

The rules run on a narrow table, a row of numbers and marks for each page: what was read, whether it may be propagated, what has
been decided so far. Each step adds its decision to the row and changes the numbers that later steps see. The decisions are then
joined to the pages once and written into the readings, with their comments and confidences.

Books are segments (``operators/segments``): what a step needs of a whole book is a partial aggregate of at most 50 log numbers,
what it needs of the pages before and after is one edge row for each segment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.constants import (ANCHOR_STOP_WORDS, DERIVED_SOURCES, ERROR, MAX_EDGE_SPAN, MIN_ANCHOR_CONFIDENCE,
                               MIN_POSITIONAL_MONTH_CONFIDENCE, OK, POSITIONAL_METHODS, POSITIONAL_STOP_WORDS, WARNING,
                               YEAR_MIN_COUNT, YEAR_MIN_RATIO, YEAR_MIN_READINGS)
from foliant.functions.dates import combine, day_number, month_end, month_name, month_number, year_number
from foliant.functions.fields import add_comment, log_order, update, with_alternative
from foliant.operators.books import PAGE_ID
from foliant.operators.segments import Segments, segmented
from foliant.operators.sequence import sequence_choices

NORMALISERS = {"day": day_number, "month": month_number, "year": year_number}
COMPONENTS = ("year", "month")
COUNTERS = ("years_consensus", "sequence_candidates", "years_filled", "months_filled", "days_filled",
            "flagged", "regressions", "unresolved")
ORDER = ["log_ord", *reversed(PAGE_ID)]
KEY = ["log_no", *reversed(PAGE_ID)]
STEPS = ("years", "sequence", "between", "edges", "consensus", "days", "regressions")


def with_parts(books: DataFrame) -> DataFrame:
    """Add the normalised parts."""
    return books.select("*", *[fn(F.col(f)["value"]).alias(f + "_n") for f, fn in NORMALISERS.items()])


def recombine(df: DataFrame) -> DataFrame:
    """Refresh ``date`` from the normalised parts."""
    blocked = reduce(lambda a, b: a | b, [F.col(f).isNull() | (F.col(f)["status"] == ERROR) for f in NORMALISERS])
    return df.withColumn("date", F.when(~blocked, combine(F.col("day_n"), F.col("month_n"), F.col("year_n"))))


def formatted(field: str, number: Column) -> Column:
    return month_name(number) if field == "month" else F.lpad(number.cast("string"), 2, "0")


def is_anchor(field: str) -> Column:
    """A direct, confident reading whose value may be propagated to other pages."""
    col, comment = F.col(field), F.lower(F.coalesce(F.col(field)["comment"], F.lit("")))

    def free_of(words) -> Column:
        return reduce(lambda a, b: a & b, [~comment.contains(w) for w in words])

    base = (F.col("log_no").isNotNull() & (F.col("alignment") == "ok") & F.col(field + "_n").isNotNull()
            & ~F.coalesce(col["source"], F.lit("")).isin(*DERIVED_SOURCES)
            & (F.coalesce(F.size(col["alternatives"]), F.lit(0)) == 0))
    direct = (col["status"] == OK) & (col["confidence"] >= MIN_ANCHOR_CONFIDENCE) & free_of(ANCHOR_STOP_WORDS)
    if field == "month":
        positional = ((col["status"] == WARNING) & (col["confidence"] >= MIN_POSITIONAL_MONTH_CONFIDENCE)
                      & F.coalesce(col["inference_method"], F.lit("")).isin(*POSITIONAL_METHODS) & free_of(POSITIONAL_STOP_WORDS))
        direct = direct | positional
    return F.coalesce(base & direct, F.lit(False))


def inferred_confidence(anchors: Column, span: Column) -> Column:
    raw = 0.64 + F.least(anchors, F.lit(5)) * 0.05 - F.when(span > 0, F.least(F.lit(0.10), span * 0.005)).otherwise(0.0)
    # The first rounding removes binary noise, the second rounds half to even.
    return F.bround(F.round(F.least(F.lit(0.90), F.greatest(F.lit(0.60), raw)), 9), 3)


def narrow(books: DataFrame) -> DataFrame:
    """What the rules need of a page: numbers of its parts and their alternatives, and which of them are in error or anchors."""
    parts = with_parts(books)

    def alternatives(field: str, normalise) -> Column:
        return F.array_compact(F.transform(F.coalesce(F.col(field)["alternatives"], F.array().cast("array<string>")), normalise))

    return parts.select(
        *PAGE_ID, "book", "log_no", log_order(F.col("log_no")).alias("log_ord"), "blank", (F.coalesce(F.col("alignment"), F.lit("")) == "ok").alias("aligned"),
        *[c for f, fn in NORMALISERS.items() for c in (
            F.col(f + "_n"), F.col(f).isNotNull().alias(f + "_has"), F.coalesce(F.col(f)["status"] == ERROR, F.lit(False)).alias(f + "_err"), alternatives(f, fn).alias(f + "_alts"))],
        *[is_anchor(f).alias(f + "_anchor") for f in COMPONENTS])


def _settle(rows: DataFrame, field: str, value: Column, when: Column) -> DataFrame:
    """A part that a step has decided: its number, no longer in error, never propagated again."""
    changes = {f"{field}_n": F.when(when, value).otherwise(F.col(f"{field}_n")), f"{field}_err": F.col(f"{field}_err") & ~when}
    if field in COMPONENTS:
        changes[f"{field}_anchor"] = F.col(f"{field}_anchor") & ~when
    return rows.withColumns(changes)


def decide_years(books: Segments) -> Segments:
    """``fix``: isolated years of a book give way to a clear majority, but for a real turn of the year."""
    read = F.col("log_no").isNotNull() & ~F.col("blank") & F.col("year_n").isNotNull()
    key = F.struct(*KEY)
    # At most one row for each book and year.
    years = books.rows.where(read).groupBy("book", "year_n").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    best = years.groupBy("book").agg(F.sum("n").alias("read"), F.max("n").alias("top"), F.collect_list("n").alias("all"),
                                     F.max_by(F.struct("year_n", "first", "last"), "n").alias("lead"))
    ties = F.size(F.filter("all", lambda n: n == F.col("top")))
    clear = (F.col("read") >= YEAR_MIN_READINGS) & (F.col("top") >= YEAR_MIN_COUNT) & (ties == 1) & (F.col("top") / F.col("read") >= YEAR_MIN_RATIO)
    books = books.attach(best.where(clear).select("book", F.struct(F.col("lead.year_n").alias("v"), "top", "read", "lead.first", "lead.last").alias("_lead")))
    lead, delta = F.col("_lead"), F.col("year_n") - F.col("_lead")["v"]
    turn = ((delta == -1) & (key < lead["first"])) | ((delta == 1) & (key > lead["last"]))
    fix = F.coalesce(read & (delta != 0) & ~turn, F.lit(False))
    rows = books.rows.withColumn("fix", F.when(fix, F.struct(lead["v"].alias("v"), lead["top"].alias("top"), lead["read"].alias("read"))))
    fixed = F.col("fix").isNotNull()
    # The year that was read becomes an alternative.
    rows = rows.withColumn("year_alts", F.when(fixed, F.array_append("year_alts", F.col("year_n"))).otherwise(F.col("year_alts")))
    return books.having(_settle(rows, "year", F.col("fix")["v"], fixed).drop("_lead"))


def decide_sequence(books: Segments) -> Segments:
    """``move_day``, ``move_month``, ``move_year``: alternatives chosen so that the book runs forward."""
    books = books.saved()
    rows = books.rows.join(sequence_choices(books), PAGE_ID, "left")
    for field in NORMALISERS:
        pick = F.col(f"c_{field}")
        moved = F.coalesce(F.col(field + "_has") & pick.isNotNull() & ~F.col(field + "_n").eqNullSafe(pick), F.lit(False))
        rows = _settle(rows.withColumn(f"move_{field}", F.when(moved, pick)), field, F.col(f"move_{field}"), F.col(f"move_{field}").isNotNull())
    return books.having(rows.drop("c_day", "c_month", "c_year"))


def _sheets(books: Segments, field: str) -> DataFrame:
    """Per book: ``sheets``, what each of its log numbers (at most 50) has on either side, and ``sole``, the value when all anchors agree."""
    page, anchor = F.struct(*reversed(PAGE_ID)), F.col(field + "_anchor")
    values = (books.rows.where(F.col("log_no").isNotNull()).groupBy("book", "log_no", F.when(anchor, F.col(field + "_n")).alias("v"))
              .agg(F.count_if(anchor).alias("n"), F.min(F.when(anchor, page)).alias("low"), F.max(F.when(anchor, page)).alias("high")))
    read = F.when(F.col("n") > 0, F.struct("v", "n"))
    levels = values.groupBy("book", "log_no").agg(F.sum("n").alias("here"), F.min_by("v", "low").alias("low"), F.max_by("v", "high").alias("high"), F.collect_list(read).alias("counts"))
    known, up, down = F.col("here") > 0, *(Window.partitionBy("book").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("log_no"), F.desc("log_no")))
    levels = levels.select("*", F.last(F.when(known, F.struct(F.col("log_no").alias("l"), F.col("high").alias("v"))), True).over(up).alias("left"),
                           F.last(F.when(known, F.struct(F.col("log_no").alias("r"), F.col("low").alias("w"))), True).over(down).alias("right"))
    agree = F.aggregate("counts", F.lit(0).cast("long"), lambda total, c: total + F.when(c["v"] == F.col("left.v"), c["n"]).otherwise(0))
    books_ = levels.groupBy("book").agg(
        F.map_from_entries(F.collect_list(F.struct("log_no", F.struct("left.l", "left.v", "right.r", "right.w", "here", agree.alias("agree"))))).alias(f"sheets_{field}"),
        F.sum("here").alias("n"), F.array_distinct(F.flatten(F.collect_list(F.transform("counts", lambda c: c["v"])))).alias("every"), F.array_sort(F.collect_list(F.when(known, F.col("log_no")))).alias("logs"))
    sole = F.when((F.col("n") >= 2) & (F.size("every") == 1), F.struct(F.col("every")[0].alias("v"), "n", "logs"))
    return books_.select("book", f"sheets_{field}", sole.alias(f"sole_{field}"))


def with_sheets(books: Segments, fields=COMPONENTS) -> Segments:
    """``sheets_year``, ``sole_year`` and so on: the anchors of each page's book as they are before any inference."""
    books = books.saved()
    return books.attach(reduce(lambda a, b: a.join(b, "book", "full"), [_sheets(books, f) for f in fields]))


def decide_between(books: Segments, fields=COMPONENTS) -> Segments:
    """``between_year`` and so on: values filled between two agreeing anchors, readings that contradict them (needs ``with_sheets``)."""
    rows = books.rows
    for field in fields:
        n, rows = F.col(field + "_n"), rows.withColumn("_sheet", F.try_element_at(f"sheets_{field}", F.col("log_no")))
        sheet, own = F.col("_sheet"), F.col(field + "_anchor").cast("int")
        contrary = sheet["here"] - sheet["agree"] - (F.col(field + "_anchor") & (n != sheet["v"])).cast("int")
        inside = F.col(field + "_has") & F.col("aligned") & (sheet["v"] == sheet["w"]) & (contrary == 0)
        usable = n.isNotNull() & ~F.col(field + "_err")
        fill, flag = (F.coalesce(inside & c, F.lit(False)) for c in (~usable, usable & (n != sheet["v"])))
        rows = rows.withColumn(f"between_{field}", F.when(fill | flag, F.struct(fill.alias("fill"), sheet["v"].alias("v"), sheet["l"].alias("l"), sheet["r"].alias("r"), (sheet["here"] - own).alias("others"))))
        done = F.col(f"between_{field}")
        rows = _settle(rows, field, F.when(done["fill"], done["v"]).otherwise(n), done.isNotNull()).drop("_sheet", f"sheets_{field}")
    return books.having(rows)


def decide_edges(books: Segments, fields=COMPONENTS) -> Segments:
    """``edge_year`` and so on: two agreeing anchors at the start or end of a book reach up to ten log numbers further."""
    books = books.saved()
    anchors = reduce(DataFrame.unionByName, [books.rows.where(F.col(f + "_anchor")).select("book", F.lit(f).alias("field"), F.struct(*KEY).alias("at"), F.col(f + "_n").alias("v")) for f in fields])
    ends = None
    for name, by in (("a", F.asc("at")), ("z", F.desc("at"))):
        # A rank limit is pushed below the shuffle: two rows per book and field leave each task.
        rank = F.row_number().over(Window.partitionBy("book", "field").orderBy(by))
        two = anchors.withColumn("r", rank).where("r <= 2").groupBy("book").agg(*[
            F.max(F.when((F.col("field") == f) & (F.col("r") == i), F.struct(F.col("at.log_no").alias("log_no"), "v"))).alias(f"_{f}_{name}{i}") for f in fields for i in (1, 2)])
        ends = two if ends is None else ends.join(two, "book", "full")
    books = books.attach(ends)
    rows, log = books.rows, F.col("log_no")
    for field in fields:
        a1, a2, z1, z2 = (F.col(f"_{field}_{e}") for e in ("a1", "a2", "z1", "z2"))
        target = F.col(field + "_has") & F.col("aligned") & (F.col(field + "_n").isNull() | F.col(field + "_err"))
        at_start = target & (a1["v"] == a2["v"]) & (log < a1["log_no"]) & (a1["log_no"] - log <= MAX_EDGE_SPAN)
        at_end = target & (z1["v"] == z2["v"]) & (log > z1["log_no"]) & (log - z1["log_no"] <= MAX_EDGE_SPAN)
        rows = rows.withColumn(f"edge_{field}", F.when(at_start, F.struct(a1["v"].alias("v"), a1["log_no"].alias("f"), a2["log_no"].alias("l")))
                               .when(at_end, F.struct(z1["v"].alias("v"), z2["log_no"].alias("f"), z1["log_no"].alias("l"))))
        rows = _settle(rows, field, F.col(f"edge_{field}")["v"], F.col(f"edge_{field}").isNotNull())
    return books.having(rows.drop(*[f"_{f}_{e}" for f in fields for e in ("a1", "a2", "z1", "z2")]))


def decide_consensus(books: Segments, fields=COMPONENTS) -> Segments:
    """``sole_year`` and so on stay where a part is still unreadable and all anchors of the book agree (needs ``with_sheets``)."""
    rows = books.rows
    for field in fields:
        fill = ~F.col("blank") & F.col(field + "_has") & F.col(field + "_n").isNull()
        rows = rows.withColumn(f"sole_{field}", F.when(fill, F.col(f"sole_{field}")))
        rows = _settle(rows, field, F.col(f"sole_{field}")["v"], F.col(f"sole_{field}").isNotNull())
    return books.having(rows)


def decide_days(books: Segments) -> Segments:
    """``last_day``: unread days become the last day that fits, not before the previous page, not after the next, at most month end."""
    if books.cut:
        books = books.saved()
    takes_part = ~F.col("blank") & F.col("day_has") & F.col("month_n").isNotNull() & F.col("year_n").isNotNull()
    books = books.having(books.rows.withColumn("_ym", F.when(takes_part, F.col("year_n") * 12 + F.col("month_n"))))
    read = F.when(F.col("_ym").isNotNull() & F.col("day_n").isNotNull(), F.struct(F.col("_ym").alias("ym"), F.col("day_n").alias("day"), *ORDER))
    books = books.nearest(before={"_pym": F.col("_ym"), "_prev": read}, after={"_next": read})
    # A run is a stretch of pages in the same month; a day read before the run started does not count.
    starts = F.when(F.col("_ym").isNotNull() & ~F.col("_ym").eqNullSafe(F.col("_pym")), F.struct(*ORDER))
    books = books.having(books.rows.withColumn("_start", starts))
    books = (books.saved() if books.cut else books).nearest(before={"_run": F.col("_start")})
    run = F.coalesce("_start", "_run")
    end = month_end(F.col("year_n") + 2000, F.col("month_n"))
    after = F.when(F.col("_next")["ym"] == F.col("_ym"), F.col("_next")["day"])
    prev = F.when(F.struct(*[F.col("_prev")[c].alias(c) for c in ORDER]) >= run, F.col("_prev")["day"])
    rows = books.rows.withColumn("last_day", F.when(F.col("_ym").isNotNull() & F.col("day_n").isNull(), F.greatest(F.least(end, F.coalesce(after, end)), F.coalesce(prev, F.lit(1)))))
    return books.having(_settle(rows, "day", F.col("last_day"), F.col("last_day").isNotNull()).drop("_ym", "_pym", "_prev", "_next", "_start", "_run"))


def decide_regressions(books: Segments) -> Segments:
    """``back``: pages dated before the previous dated page of their book."""
    if books.cut:
        books = books.saved()
    blocked = reduce(lambda a, b: a | b, [~F.col(f + "_has") | F.col(f + "_err") for f in NORMALISERS])
    date = F.when(~blocked & F.col("log_no").isNotNull(), combine(F.col("day_n"), F.col("month_n"), F.col("year_n")))
    books = books.having(books.rows.withColumn("_date", date)).nearest(before={"_before": F.col("_date")})
    back = F.coalesce((F.col("_date") < F.col("_before")) & F.col("year_has") & ~F.col("year_err"), F.lit(False))
    return books.having(books.rows.withColumn("back", back).drop("_date", "_before"))


def decisions(books: DataFrame, steps=STEPS, fields=COMPONENTS) -> DataFrame:
    """Each page's id with the decisions of ``steps``, the numbers of its parts after them, and its date."""
    segments = segmented(narrow(books), "book", ORDER)
    made = {"years": decide_years, "sequence": decide_sequence, "between": lambda b: decide_between(b, fields), "edges": lambda b: decide_edges(b, fields),
            "consensus": lambda b: decide_consensus(b, fields), "days": decide_days, "regressions": decide_regressions}
    for step in STEPS:
        if step == "between" and ("between" in steps or "consensus" in steps):
            segments = with_sheets(segments, fields)
        if step in steps:
            segments = made[step](segments)
    blocked = reduce(lambda a, b: a | b, [~F.col(f + "_has") | F.col(f + "_err") for f in NORMALISERS])
    segments = segments.having(segments.rows.withColumn("date", F.when(~blocked, combine(F.col("day_n"), F.col("month_n"), F.col("year_n")))))
    kept = {"date", *(f + "_n" for f in NORMALISERS), "fix", "last_day", "back", *(f"move_{f}" for f in NORMALISERS), *(f"{d}_{f}" for d, step in (("between", "between"), ("edge", "edges"), ("sole", "consensus")) if step in steps for f in fields)}
    return segments.rows.select(*PAGE_ID, *[c for c in segments.rows.columns if c in kept])


def _inferred(df: DataFrame, field: str, when: Column, text: Column, method: str, anchors: Column, span: Column, numbers: Column) -> DataFrame:
    return df.withColumn(field, update(
        field, when, value=text, status=F.lit(WARNING), source=F.lit("inferred"), inference_method=F.lit(method), confidence=inferred_confidence(anchors, span),
        comment=F.concat(F.lit(f"Inferred {field} from log_number anchors "), numbers, F.lit(": "), text),
        alternatives=with_alternative(field, ~F.col(field)["value"].eqNullSafe(text))))


def _write_years(df: DataFrame) -> DataFrame:
    fix = F.col("fix")
    text = F.lpad(fix["v"].cast("string"), 2, "0")
    note = F.concat(F.lit("Year corrected by book majority ("), fix["top"].cast("string"), F.lit("/"), fix["read"].cast("string"),
                    F.lit("): '"), F.col("year")["value"], F.lit("' -> '"), text, F.lit("'"))
    confidence = F.bround(F.round(F.least(F.lit(0.95), 0.55 + fix["top"] / fix["read"] * 0.40), 9), 3)
    return df.withColumn("year", update("year", fix.isNotNull(), value=text, confidence=confidence, status=F.lit(WARNING), source=F.lit("book_correction"),
                                        inference_method=F.lit("log_number_year_consensus"), comment=note, alternatives=with_alternative("year")))


def _write_sequence(df: DataFrame) -> DataFrame:
    for field in NORMALISERS:
        pick = F.col(f"move_{field}")
        text = {"day": pick.cast("string"), "month": month_name(pick), "year": F.lpad(pick.cast("string"), 2, "0")}[field]
        before = F.coalesce(F.concat(F.lit("'"), F.col(field)["value"], F.lit("'")), F.lit("None"))
        df = df.withColumn(field, update(
            field, pick.isNotNull(), value=text, status=F.lit(WARNING), source=F.lit("book_correction"),
            inference_method=F.lit("log_number_sequence_candidate"), alternatives=with_alternative(field),
            comment=F.concat(F.lit("OCR alternative selected by nondecreasing book sequence: "), before, F.lit(" -> '"), text, F.lit("'"))))
    return df


def _write_between(df: DataFrame, field: str) -> DataFrame:
    done = F.col(f"between_{field}")
    # Anchors at the page's own number are listed once, however many scans of it exist.
    numbers = F.concat_ws(", ", done["l"].cast("string"), F.when(done["others"] > 0, F.col("log_no").cast("string")), done["r"].cast("string"))
    text = formatted(field, done["v"])
    df = _inferred(df, field, F.coalesce(done["fill"], F.lit(False)), text, "log_number_interval", done["others"] + 2, done["r"] - done["l"], numbers)
    return df.withColumn(field, update(
        field, F.coalesce(~done["fill"], F.lit(False)), status=F.lit(WARNING), inference_method=F.lit("log_number_interval_conflict"),
        comment=add_comment(F.col(field)["comment"], F.concat(F.lit(f"Conflicts with {field} interval "), text, F.lit(" (log_number anchors "), numbers, F.lit(")")))))


def _write_edges(df: DataFrame, field: str) -> DataFrame:
    edge = F.col(f"edge_{field}")
    numbers = F.concat_ws(", ", edge["f"].cast("string"), edge["l"].cast("string"))
    return _inferred(df, field, edge.isNotNull(), formatted(field, edge["v"]), "log_number_local_consensus", F.lit(2), edge["l"] - edge["f"], numbers)


def _write_consensus(df: DataFrame, field: str) -> DataFrame:
    sole = F.col(f"sole_{field}")
    return _inferred(df, field, sole.isNotNull(), formatted(field, sole["v"]), "book_consensus", sole["n"], F.array_max(sole["logs"]) - F.array_min(sole["logs"]),
                     F.array_join(sole["logs"].cast("array<string>"), ", "))


def _write_days(df: DataFrame) -> DataFrame:
    text = F.lpad(F.col("last_day").cast("string"), 2, "0")
    return df.withColumn("day", update(
        "day", F.col("last_day").isNotNull(), value=text, status=F.lit(WARNING), source=F.lit("inferred"), inference_method=F.lit("month_end_fallback"),
        confidence=inferred_confidence(F.lit(1), F.lit(0)), comment=F.concat(F.lit("Day not read; last day that fits the book sequence: "), text),
        alternatives=with_alternative("day")))


def _write_regressions(df: DataFrame) -> DataFrame:
    return df.withColumn("year", update("year", F.col("back"), status=F.lit(WARNING), inference_method=F.lit("log_number_regression"),
                                        comment=add_comment(F.col("year")["comment"], F.lit("Date regression by log_number"))))


def infer_dates(books: DataFrame, steps=STEPS, fields=COMPONENTS) -> DataFrame:
    """Pages with the decisions of ``steps`` written into their day, month and year, their date anew, and the counters of what was done.

    The pages are moved once, to meet their decisions; a page is one row, known by its file and number.
    """
    df = books.drop("date").join(decisions(books, steps, fields), PAGE_ID, "left")

    def counted(*names: str) -> Column:
        return sum((F.coalesce(F.col(c).isNotNull().cast("int"), F.lit(0)) for c in names if c in df.columns), F.lit(0))

    def filled(field: str) -> Column:
        between = F.coalesce(F.col(f"between_{field}")["fill"].cast("int"), F.lit(0)) if f"between_{field}" in df.columns else F.lit(0)
        return between + counted(f"edge_{field}", f"sole_{field}")

    flags = sum((F.coalesce((~F.col(f"between_{f}")["fill"]).cast("int"), F.lit(0)) for f in fields if f"between_{f}" in df.columns), F.lit(0))
    back = F.coalesce(F.col("back"), F.lit(False)) if "back" in df.columns else F.lit(False)
    made = {"years_consensus": counted("fix"), "sequence_candidates": counted(*(f"move_{f}" for f in NORMALISERS)), "years_filled": filled("year"), "months_filled": filled("month"),
            "days_filled": counted("last_day"), "flagged": flags, "regressions": back.cast("int")}
    decided = [c for c in df.columns if c not in books.columns]
    df = df.withColumns(made)
    if "years" in steps:
        df = _write_years(df)
    if "sequence" in steps:
        df = _write_sequence(df)
    for field in fields:
        for step, write in (("between", _write_between), ("edges", _write_edges), ("consensus", _write_consensus)):
            if step in steps:
                df = write(df, field)
    if "days" in steps:
        df = _write_days(df)
    if "regressions" in steps:
        df = _write_regressions(df)
    return df.drop(*[c for c in decided if c != "date" and not c.endswith("_n")])


def year_consensus(books: DataFrame) -> DataFrame:
    """Replace isolated years of a book with a clear majority, keeping a real turn of the year."""
    return infer_dates(books, ("years",))


def sequence_candidates(books: DataFrame) -> DataFrame:
    """Write the alternatives that make a book run forward, and count the changed parts."""
    return infer_dates(books, ("sequence",))


def infer_between_anchors(books: DataFrame, field: str) -> DataFrame:
    """Fill unreadable values between two agreeing anchors and mark readings that contradict them."""
    return infer_dates(books, ("between",), (field,))


def infer_edges(books: DataFrame, field: str) -> DataFrame:
    """Extend two agreeing anchors at the start or end of a book by up to ten log numbers."""
    return infer_dates(books, ("edges",), (field,))


def fill_book_consensus(books: DataFrame, field: str) -> DataFrame:
    """Fill what is unreadable when all anchors of the book agree."""
    return infer_dates(books, ("consensus",), (field,))


def fill_missing_day(books: DataFrame) -> DataFrame:
    """Unread days become the last day that fits: not before the previous page, not after the next, at most month end."""
    return infer_dates(books, ("days",))


def check_regressions(books: DataFrame) -> DataFrame:
    """Mark the year of a page dated before the previous dated page of its book."""
    return infer_dates(books, ("regressions",))


def flag_unresolved(df: DataFrame) -> DataFrame:
    """Explain which part of the date is still missing on pages without one."""
    df = df.withColumn("_open", ~F.col("blank") & F.col("date").isNull())
    open_page = F.col("_open")
    fixed_texts = {"day": ("date_incomplete", "Day unresolved; date left incomplete"),
                   "month": ("date_unresolved", "Month unresolved after log_number inference"),
                   "year": ("date_unresolved", "Year unresolved after log_number inference")}
    complete = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & F.col(f + "_n").isNotNull() for f in fixed_texts])
    df = df.withColumn("_invalid", open_page & complete)
    for field, (method, text) in fixed_texts.items():
        df = df.withColumn(field, update(field, open_page & F.col(field).isNotNull() & F.col(field + "_n").isNull(), status=F.lit(WARNING),
                                         inference_method=F.lit(method), comment=F.lit(text)))
    df = df.withColumn("year", update("year", F.col("_invalid"), status=F.lit(WARNING), inference_method=F.lit("invalid_calendar_date"),
                                      comment=F.lit("Date is not a valid calendar date")))
    return df.withColumn("unresolved", F.col("_open").cast("int")).drop("_open", "_invalid")
