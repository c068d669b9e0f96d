"""Aircraft registration readings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.fields import let
from foliant.constants import (AMBIGUOUS_REGISTRATION_NOTE, INDEX_REGISTRATION_RE, LOG_NUMBER_RE, NO_REGISTRATION_NOTE,
                               WEAK_REGISTRATION_NOTE, WWP_NUMBERS)

# Upper-case characters read for a digit inside the number, and those digits.
LOOKALIKES, LOOKALIKE_DIGITS = "OQILZSBGF", "001125867"


def _best_window(text: Column) -> Column:
    """Best four-character window that reads as digits: struct(score, -start, digits, real)."""
    def window(start: Column) -> Column:
        def rated(piece: Column) -> Column:
            digits = F.translate(piece, LOOKALIKES, LOOKALIKE_DIGITS)
            real = F.length(F.regexp_replace(piece, "[^0-9]", ""))
            tail = F.substring(text, start + 5, F.lit(1))
            suffix = (F.when(tail.isin("C", "W"), 3).when(tail == "", 1)
                      .when(tail.rlike("[0-9]"), -3).otherwise(-1))
            prefix = F.when(start == 2, 2).when(start.isin(1, 3), 1).when(start == 0, 0).otherwise(-2)
            return F.when(digits.rlike("^[0-9]{4}$") & (real >= 2), F.struct(
                (suffix + prefix + real).alias("score"), (-start).alias("back"), digits.alias("digits"), real.alias("real")))
        return let(F.substring(text, start + 1, F.lit(4)), rated)

    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 4, F.lit(0)))
    return F.array_max(F.transform(starts, window))


def normalise_registration(value: Column) -> Column:
    """struct(value, note): HP-nnnnCMP / HP-nnnnWWP, or an empty value with the reason."""
    def result(text: Column, number: Column, note) -> Column:
        suffix = F.when(text.contains("WWP") | number.isin(*WWP_NUMBERS), "WWP").otherwise("CMP")
        return F.struct(F.concat(F.lit("HP-"), number, suffix).alias("value"), note.alias("note"))

    def rebuilt(text: Column, best: Column) -> Column:
        fits = (best["score"] >= 4) | ((best["real"] == 4) & (best["score"] >= 3))
        digits = F.regexp_replace(text, "[^0-9]", "")
        return (F.when(fits, result(text, best["digits"], F.when(best["real"] == 4, "").otherwise(AMBIGUOUS_REGISTRATION_NOTE)))
                .when(F.length(digits) == 4, result(text, digits, F.lit(WEAK_REGISTRATION_NOTE)))
                .otherwise(F.struct(F.lit("").alias("value"), F.lit(NO_REGISTRATION_NOTE).alias("note"))))

    def read(text: Column) -> Column:
        return let(F.regexp_extract(text, "(?<![0-9])[0-9]{4}(?![0-9])", 0),
                   lambda clean: F.when(clean != "", result(text, clean, F.lit("")))
                   .otherwise(let(_best_window(text), lambda best: rebuilt(text, best))))

    return let(F.regexp_replace(F.upper(value), "[^A-Z0-9]", ""), read)


def index_registration(value: Column) -> Column:
    """Registration as the remote picklist writes it, or an empty text."""
    text = F.regexp_replace(F.upper(F.trim(F.coalesce(value, F.lit("")))), " ", "")
    return F.when(text.rlike(INDEX_REGISTRATION_RE), text).otherwise("")


def index_log_number(value: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")
    return F.when(digits.rlike(LOG_NUMBER_RE), digits).otherwise("")


def fleet_entry(value: Column) -> Column:
    """Fleet list entry: bare digits become HP-nnnnCMP, a missing hyphen is added; null if invalid."""
    text = F.regexp_replace(F.upper(F.trim(value)), " ", "")
    full = (F.when(text.rlike("^[0-9]{4}$"), F.concat(F.lit("HP-"), text, F.lit("CMP")))
            .when(text.rlike("^HP[0-9]{4}"), F.concat(F.lit("HP-"), F.substring(text, 3, 100))).otherwise(text))
    return F.when(full.rlike("^HP-[0-9]{4}(CMP|WWP)$"), full)
