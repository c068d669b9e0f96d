"""Date parts as column expressions: normalising, combining and the output policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.constants import DATE_RE, ERROR, MONTH_NAMES, MONTH_NAMES_EN, MONTH_WORDS, NO_MONTH
from foliant.functions.fields import let


def as_int(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int"))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def month_word(text: Column) -> Column:
    """Number of a month word written exactly (null otherwise)."""
    pairs = ", ".join(f"'{word}', {number}" for word, number in MONTH_WORDS)
    return F.element_at(F.expr(f"map({pairs})"), text)


def _closest_month(letters: Column) -> Column:
    # One constant: each word, its number, and the pattern of two of its letters in order.
    known = F.expr("array({})".format(", ".join(
        f"named_struct('word', '{w}', 'number', {n}, 'pair', '{w[0]}.*{w[1]}|{w[0]}.*{w[2]}|{w[1]}.*{w[2]}')" for w, n in MONTH_WORDS)))

    def nearest(limit: int, close) -> Column:
        near = F.filter(known, lambda x: (F.levenshtein(letters, x["word"]) < limit) & close(x))
        return -F.array_min(F.transform(near, lambda x: F.struct(F.levenshtein(letters, x["word"]).alias("d"), (-x["number"]).alias("m"))))["m"]

    def two_in_place(x: Column) -> Column:
        return sum((F.substring(letters, i, 1) == F.substring(x["word"], i, 1)).cast("int") for i in (1, 2, 3)) >= 2

    contained = F.get(F.filter(known, lambda x: letters.contains(x["word"])), F.lit(0))["number"]
    return F.coalesce(contained, nearest(2, two_in_place), F.when(F.length(letters).between(3, 5), nearest(3, lambda x: F.regexp_like(letters, x["pair"]))))


def parse_month(value: Column) -> Column:
    """Month number from digits or letters; near misses resolve to the closest word, ties to the later month."""
    def read(upper: Column) -> Column:
        letters = F.regexp_replace(F.translate(upper, "0158I", "OLSBL"), "[^A-Z]", "")
        own = F.length(F.regexp_replace(upper, "[^A-Z]", ""))
        number = as_int(F.substring(only_digits(upper), 1, 3))
        return (F.when(month_word(upper).isNotNull(), month_word(upper))
                .when(own == 0, F.when(number.between(1, 12), number))
                .when((F.length(letters) < 2) | (upper.rlike("[0-9]") & (own < 2)), F.lit(None))
                .otherwise(let(letters, _closest_month)))

    return let(F.upper(F.trim(value)), read)


def month_number(value: Column) -> Column:
    text = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    number = as_int(text)
    return (F.when(month_word(value).isNotNull(), month_word(value))
            .when(text.rlike("^[0-9]+$"), F.when(number.between(1, 12), number))
            .when(text != "", parse_month(text)))


def year_number(value: Column) -> Column:
    """Two-digit year as 0..99; three-digit and out-of-range readings are null."""
    digits = only_digits(value)
    number = as_int(digits)
    return (F.when((F.length(digits) == 4) & number.between(2000, 2100), number % 100)
            .when(F.length(digits) == 2, number))


def day_number(value: Column) -> Column:
    number = only_digits(value).try_cast("decimal(38,0)")
    return F.when(number.between(1, 31), number.cast("int"))


def month_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), number)


def month_end(year: Column, month: Column) -> Column:
    """Last day of the month; ``month`` must be 1..12 where not null."""
    return F.day(F.last_day(F.make_date(year, month, F.when(month.isNotNull(), 1))))


def date_text(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("/"), F.lpad(month.cast("string"), 2, "0"), F.lit("/"),
                    F.lpad(day.cast("string"), 2, "0"))


def combine(day: Column, month: Column, year: Column) -> Column:
    """YYYY/MM/DD from normalised parts, null if a part is missing or the day does not exist."""
    full = year + 2000
    return F.when(day <= month_end(full, month), date_text(full, month, day))


def page_date() -> Column:
    """The page's date from its three parts; a part in ERROR or missing blocks it."""
    parts = [F.col(f) for f in ("day", "month", "year")]
    blocked = reduce(lambda a, b: a | b, [p.isNull() | (p["status"] == ERROR) for p in parts])
    return F.when(~blocked, combine(day_number(parts[0]["value"]), month_number(parts[1]["value"]), year_number(parts[2]["value"])))


def plain_month(value: Column) -> Column:
    """Month from an exact word or a plain number 1..12 (the writers do not guess)."""
    text = F.upper(value)
    number = as_int(value)
    return F.coalesce(month_word(text), F.when(number.between(1, 12), number))


def plain_year(value: Column) -> Column:
    number = as_int(value)
    return (F.when(value.rlike("^[0-9]{2}$"), number + 2000)
            .when(value.rlike("^[0-9]{4}$") & number.between(2000, 2100), number))


def month_key() -> Column:
    """YYYY-MM of a page, from its date or else from month and year; ``sin_fecha`` otherwise."""
    month, year = F.col("month"), F.col("year")
    usable = month.isNotNull() & year.isNotNull() & (month["status"] != ERROR) & (year["status"] != ERROR)
    number, full = plain_month(month["value"]), plain_year(year["value"])
    parts = F.when(usable & number.isNotNull() & full.isNotNull(),
                   F.concat(F.lpad(full.cast("string"), 4, "0"), F.lit("-"), F.lpad(number.cast("string"), 2, "0")))
    whole = F.when(F.col("date").rlike(DATE_RE), F.translate(F.substring(F.col("date"), 1, 7), "/", "-"))
    return F.coalesce(whole, parts, F.lit(NO_MONTH))


def month_label(key: Column) -> Column:
    """YYYY-MMM for a month key, ``sf`` without a date."""
    number = as_int(F.substring(key, 6, 2))
    name = F.when(number.between(1, 12), F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES_EN]), number))
    return F.when(key == NO_MONTH, "sf").when(name.isNotNull() & key.rlike(r"^\d{4}-\d{2}$"),
                                              F.concat(F.substring(key, 1, 4), F.lit("-"), name)).otherwise(key)


def separator_label(key: Column) -> Column:
    """MMM YYYY for a month key, ``SIN FECHA`` without a date."""
    label = month_label(key)
    return (F.when(key == NO_MONTH, "SIN FECHA")
            .when(label == key, key).otherwise(F.concat(F.substring(label, 6, 3), F.lit(" "), F.substring(label, 1, 4))))


def output_date(month_end_always: bool) -> Column:
    """struct(day, date, changed, reason) of the CSV date policy; null if month or year is unreadable."""
    year, month = plain_year(F.col("year")["value"]), plain_month(F.col("month")["value"])
    last = month_end(year, month)
    read = F.col("day")["value"]
    number = as_int(read)
    day = F.when(number.between(1, last), number)
    if month_end_always:
        chosen, changed = last, F.coalesce(day != last, F.lit(True))
        reason = F.concat(F.lit("CSV configurado para usar el último día del mes; día OCR: "),
                          F.when(F.coalesce(read, F.lit("")) == "", "vacío").otherwise(read))
    else:
        chosen, changed = F.coalesce(day, last), day.isNull()
        reason = F.when(day.isNull(), "Día OCR sin resolver; se usó el último día calendario del mes en el CSV").otherwise("")
    return F.when(year.isNotNull() & month.isNotNull(), F.struct(
        chosen.cast("string").alias("day"), date_text(year, month, chosen).alias("date"),
        changed.alias("changed"), reason.alias("reason")))


def remote_date(value: Column) -> Column:
    """MM/DD/YYYY from YYYY/MM/DD, otherwise empty."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(text.rlike(DATE_RE), F.concat_ws("/", F.substring(text, 6, 2), F.substring(text, 9, 2), F.substring(text, 1, 4))).otherwise("")
