"""Books: grouping pages by printed number, duplicates and the registration vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.constants import (AMBIGUOUS_REGISTRATION_NOTE, DERIVED_SOURCES, ERROR, MIN_VOTE_WEIGHT, OK, QUALITY_AMBIGUOUS,
                               QUALITY_CLEAN, QUALITY_WEAK, REGISTRATION_RE, UNKNOWN_BOOK, VERIFIED_SOURCES)
from foliant.functions.fields import book_key, let, log_number, page_status, update, with_alternative
from foliant.functions.registrations import normalise_registration
from foliant.operators.skew import join_groups
from foliant.session import save_rows

PAGE_ID = ["file_seq", "page_number"]


def with_books(pages: DataFrame, unknown: str = "group") -> DataFrame:
    """Add ``log_no`` and ``book``. Pages without a readable number join the only known book, or
    form one group of their own; ``unknown="apart"`` makes that group in any case, ``"isolate"`` one for each of them."""
    keyed = pages.withColumn("log_no", log_number(pages.columns)).withColumn("_known", book_key())
    if unknown == "apart":
        return keyed.withColumn("book", F.coalesce("_known", F.lit(UNKNOWN_BOOK))).drop("_known")
    # One row: the first and last book key, equal when a single book is known.
    only = keyed.agg(F.when(F.min("_known") == F.max("_known"), F.min("_known")).alias("only"))
    lone = F.concat_ws("-", F.lit(UNKNOWN_BOOK), *PAGE_ID) if unknown == "isolate" else F.lit(UNKNOWN_BOOK)
    return keyed.withColumn("book", F.coalesce("_known", only.scalar(), lone)).drop("_known")


def mark_duplicates(pages: DataFrame) -> DataFrame:
    """``dup`` is true on later batch occurrences of a readable log number.

    The first occurrence comes from a partial aggregate and is joined back, so a number
    scanned a million times does not land in one task. Only numbers seen more than once are kept and joined.
    """
    # Unreadable numbers get scattered keys that match nothing.
    scattered = -1 - F.pmod(F.xxhash64(*PAGE_ID), F.lit(1_000_003))
    numbered = pages.withColumn("log_no", log_number(pages.columns)).withColumn("_key", F.coalesce("log_no", scattered))
    first = (numbered.where(F.col("log_no").isNotNull()).groupBy("_key")
             .agg(F.min(F.struct(*PAGE_ID)).alias("_first"), F.count("*").alias("_rows")).where("_rows > 1"))
    known = join_groups(numbered, save_rows(first), ["_key"], PAGE_ID, rows_in="_rows")
    return known.withColumn("dup", F.coalesce(F.struct(*PAGE_ID) != F.col("_first"), F.lit(False))).drop("_key", "_first", "_rows")


def duplicate_groups(pages: DataFrame) -> DataFrame:
    """Log numbers seen more than once, one row per location."""
    numbered = pages.withColumn("log_no", log_number(pages.columns)).where(F.col("log_no").isNotNull())
    repeated = numbered.groupBy("log_no").agg(F.count("*").alias("times")).where("times > 1")
    return join_groups(numbered.select("log_no", *PAGE_ID, "file"), repeated, ["log_no"], PAGE_ID, "inner", rows_in="times")


def _evidence() -> Column:
    """Number, suffix and weight a page votes with (null if it has no usable reading)."""
    field = F.col("matricula")
    weight = F.greatest(field["confidence"].cast("decimal(12,6)"), F.lit(MIN_VOTE_WEIGHT).cast("decimal(12,6)"))

    def vote(text: Column, w: Column) -> Column:
        return F.when(text.rlike(REGISTRATION_RE), F.struct(
            F.substring(text, 4, 4).alias("number"), F.substring(text, 8, 3).alias("suffix"), w.cast("decimal(12,6)").alias("weight")))

    def raw_vote(raw: Column) -> Column:
        quality = (F.when(raw["note"] == "", QUALITY_CLEAN).when(raw["note"] == AMBIGUOUS_REGISTRATION_NOTE, QUALITY_AMBIGUOUS)
                   .otherwise(QUALITY_WEAK).cast("decimal(3,2)"))
        return vote(raw["value"], weight * quality)

    from_raw = F.when(field["raw_value"] != "", let(normalise_registration(field["raw_value"]), raw_vote))
    from_value = F.when(~field["source"].isin(*DERIVED_SOURCES), vote(field["value"], weight))
    # A second reader's value outranks the raw text that had already failed.
    return (F.when(field["source"].isin(*VERIFIED_SOURCES), F.coalesce(from_value, from_raw))
            .otherwise(F.coalesce(from_raw, from_value)))


def book_votes(books: DataFrame) -> DataFrame:
    """Winner, readers and confidence per book: per-position weighted vote, one vote per log number."""
    votes = (books.where(F.col("matricula").isNotNull()).withColumn("_e", _evidence()).where(F.col("_e").isNotNull()))
    sheet = F.when(F.col("log_no") != 0, F.col("log_no"))
    alone = F.when(sheet.isNull(), F.struct(*PAGE_ID))
    unique = (votes.groupBy("book", sheet.alias("_sheet"), alone.alias("_alone"))
              .agg(F.min_by("_e", F.struct(-F.col("_e")["weight"], F.col("page_number"), F.col("file_seq"))).alias("_e"))
              .select("book", "_e.*"))
    wide = "decimal(38,6)"
    per_number = unique.groupBy("book", "number").agg(
        F.sum("weight").cast(wide).alias("w"),
        *[F.sum(F.when(F.col("suffix") == x, F.col("weight"))).cast(wide).alias(x) for x in ("CMP", "WWP")])
    slots = [(p, str(d)) for p in range(4) for d in range(10)]
    tally = per_number.groupBy("book").agg(
        *[F.sum(F.when(F.substring("number", p + 1, 1) == d, F.col("w"))).alias(f"v{p}{d}") for p, d in slots],
        F.sum("CMP").alias("CMP"), F.sum("WWP").alias("WWP"),
        F.max_by("number", F.struct("w", -F.col("number").cast("int"))).alias("heaviest"),
        # A number has four digits, so at most 10,000 entries whatever the book's size.
        F.map_from_entries(F.collect_list(F.struct("number", "w"))).alias("observed"))

    def top(p: int):
        options = [F.when(F.col(f"v{p}{d}").isNotNull(), F.struct(F.col(f"v{p}{d}").alias("w"), F.lit(-d).alias("d"))) for d in range(10)]
        return (-F.greatest(*options)["d"]).cast("string")

    mixed = F.concat(*[top(p) for p in range(4)])
    tally = tally.withColumn("_number", F.when(F.map_contains_key("observed", mixed), mixed).otherwise(F.col("heaviest")))
    suffix = F.when(F.coalesce(F.col("WWP"), F.lit(0)) > F.coalesce(F.col("CMP"), F.lit(0)), "WWP").otherwise("CMP")
    tally = tally.select("book", F.concat(F.lit("HP-"), "_number", suffix).alias("winner"),
                         F.element_at("observed", F.col("_number")).alias("_w"))
    readers = (books.where(F.col("matricula")["value"].rlike(REGISTRATION_RE) & ~F.col("matricula")["source"].isin(*DERIVED_SOURCES))
               .groupBy("book", F.col("matricula")["value"].alias("winner"))
               .agg(F.sum(F.col("matricula")["confidence"].cast("decimal(12,6)")).cast("decimal(38,6)").alias("_sum"), F.count("*").alias("_n")))
    mean = (F.col("_sum") / F.col("_n")).cast("double")
    return (tally.join(readers, ["book", "winner"], "left")
            .select("book", "winner", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).alias("readers"),
                    F.bround(F.coalesce(mean, F.least(F.col("_w").cast("double"), F.lit(1.0))), 3).alias("winner_confidence")))


def book_vote(pages: DataFrame, fields: dict[str, str], unknown: str = "group") -> DataFrame:
    """Write each book's registration on all of its pages, keeping what was read as an alternative."""
    books = with_books(pages, unknown)
    joined = join_groups(books, book_votes(books), ["book"], PAGE_ID)
    field, winner = F.col("matricula"), F.col("winner")
    joined = joined.withColumn("vote_change", F.when(
        field.isNotNull() & winner.isNotNull() & ~field["value"].eqNullSafe(winner),
        F.when(F.coalesce(field["value"], F.lit("")) != "", "overwritten").otherwise("filled")))
    changed = F.col("vote_change").isNotNull()
    comment = F.when(F.col("vote_change") == "overwritten", F.concat(
        F.lit("Corrected from '"), field["value"], F.lit("' by book consensus ("), F.col("readers").cast("string"), F.lit(" vote(s))"))
    ).otherwise(F.concat(F.lit("Inferred from book readings: "), winner, F.lit(" ("), F.col("readers").cast("string"), F.lit(" vote(s))")))
    voted = joined.withColumn("matricula", update(
        "matricula", changed, value=winner, confidence=F.col("winner_confidence"), status=F.lit(OK), source=F.lit("book_correction"),
        inference_method=F.lit("book_digit_consensus"), comment=comment, alternatives=with_alternative("matricula")))
    refreshed = F.when(changed & ~F.col("blank"), page_status(fields)).otherwise(F.col("status"))
    return voted.withColumn("status", refreshed).drop("winner", "readers", "winner_confidence")


def file_majority(pages: DataFrame, pattern: str = REGISTRATION_RE) -> DataFrame:
    """Most frequent valid registration of each file written on its pages; differing pages are marked."""
    value = F.col("matricula")["value"]
    counts = pages.where(value.rlike(pattern)).groupBy("file_seq", value.alias("v")).count()
    best = counts.groupBy("file_seq").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("majority"))
    joined = join_groups(pages, best, ["file_seq"], PAGE_ID)
    majority = F.col("majority")
    differs = majority.isNull() | ~value.eqNullSafe(majority)
    fix = majority.isNotNull() & differs & F.col("matricula").isNotNull()
    text = F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None"))
    return (joined.withColumn("discrepancy", differs)
            .withColumn("matricula", update("matricula", fix, value=majority, status=F.lit(ERROR),
                                            comment=F.concat(F.lit("corrected from "), text, F.lit(" by majority vote")))))


def group_books(pages: DataFrame) -> DataFrame:
    """Pages per book with its first and last log number."""
    return with_books(pages).groupBy("book").agg(
        F.count("*").alias("pages"), F.min("log_no").alias("first_log"), F.max("log_no").alias("last_log"))
