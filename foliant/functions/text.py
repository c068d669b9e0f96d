"""Named text rules: raw reading -> struct(value, note), as column expressions.

``RULES`` maps a rule name (the template's ``postprocess``) to its column function.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.constants import FLIGHT_CODES, FLIGHT_NOTE, FLIGHT_STROKES, LETTER_DIGITS, MONTH_NAMES, MONTH_WORDS
from foliant.functions.dates import as_int, date_text, month_end, month_name, parse_month
from foliant.functions.fields import let
from foliant.functions.registrations import normalise_registration

# Letters read for a digit in a flight number, and those digits.
FLIGHT_LETTERS, FLIGHT_DIGITS = "OQILZSBGYTF", "00112586477"
# Behind a complete CM prefix two more letters can only be digits.
TAIL_LETTERS, TAIL_DIGITS = FLIGHT_LETTERS + "AD", FLIGHT_DIGITS + "40"


def outcome(value: Column | str, note: Column | str) -> Column:
    value, note = (F.lit(x) if isinstance(x, str) else x for x in (value, note))
    return F.struct(value.alias("value"), note.alias("note"))


def _failed(reason: str, value: Column) -> Column:
    return outcome("", F.concat(F.lit(f"{reason}: "), value))


def letters_before_digits(value: Column) -> Column:
    """Letters that stand for a digit become one when a digit follows them."""
    letters, digits = "".join(LETTER_DIGITS), "".join(LETTER_DIGITS.values())

    def one(i: Column) -> Column:
        char, following = F.substring(value, i, F.lit(1)), F.substring(value, i + 1, F.lit(1))
        return F.when(following.rlike("[0-9]"), F.translate(char, letters, digits)).otherwise(char)

    return F.when(F.length(value) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), ""))


def _runs(value: Column) -> Column:
    """Digit runs; two (or, for the year, four) single digits around a printed separator are one run."""
    return F.regexp_extract_all(value, F.lit("[0-9]+"), 0)


def _joined(runs: Column, sizes: tuple[int, ...]) -> Column:
    single = F.forall(runs, lambda r: F.length(r) == 1) & F.size(runs).isin(*sizes)
    return F.when(single, F.array(F.array_join(runs, ""))).otherwise(runs)


def day(value: Column) -> Column:
    def read(text: Column) -> Column:
        def pick(runs: Column) -> Column:
            twos, ones = F.filter(runs, lambda r: F.length(r) == 2), F.filter(runs, lambda r: F.length(r) == 1)
            digits = F.when(F.size(twos) > 0, F.get(twos, F.lit(0))).when(F.size(ones) == 1, F.get(ones, F.lit(0)))
            return F.when(as_int(digits).between(1, 31), outcome(digits, "")).otherwise(_failed("invalid day", text))
        return let(_joined(_runs(text), (2,)), pick)

    short = (F.length(value) <= 8) & ~value.rlike("[A-Z]{3,}")
    return let(F.when(short, letters_before_digits(value)).otherwise(value), read)


def month(value: Column) -> Column:
    def read(raw: Column) -> Column:
        number = as_int(raw)
        numeric = (F.when(raw.rlike("^[0-9]{1,2}$") & number.between(1, 12),
                          outcome(number.cast("string"), F.concat(F.lit("numeric handwritten month: "), raw)))
                   .otherwise(_failed("invalid month", value)))
        letters = F.regexp_replace(F.translate(raw, "0158", "oisb"), "[^A-Za-z]", "")
        exact = letters.rlike("|".join(w for w, _ in MONTH_WORDS))
        note = F.when(exact | (F.length(letters) == 3), "").otherwise(F.concat(F.lit("month fuzzy: "), value))
        worded = let(parse_month(raw), lambda n: F.when(n.isNotNull(), outcome(month_name(n), note)).otherwise(_failed("invalid month", value)))
        return F.when(raw.rlike("[A-Z]"), worded).otherwise(numeric)

    return let(F.upper(F.trim(value)), read)


def year(value: Column) -> Column:
    def pick(runs: Column) -> Column:
        def of(size: int) -> Column:
            return F.filter(runs, lambda r: F.length(r) == size)

        four = F.get(of(4), F.lit(0))
        two, three = F.try_element_at(of(2), F.lit(-1)), F.try_element_at(of(3), F.lit(-1))
        return (F.when(four.isNotNull(), F.when(as_int(four).between(2000, 2100), outcome(four, "")).otherwise(_failed("invalid year", value)))
                .when(two.isNotNull(), outcome(two, ""))
                .when(three.isNotNull(), outcome(three, F.concat(F.lit("invalid year: "), three)))
                .otherwise(_failed("invalid year", value)))

    return let(_joined(_runs(letters_before_digits(value)), (2, 4)), pick)


def digits(value: Column) -> Column:
    kept = F.regexp_replace(value, "[^0-9]", "")
    return F.when(kept != "", outcome(kept, "")).otherwise(outcome(value, "no digits"))


def char(value: Column) -> Column:
    first = F.upper(F.substring(F.trim(value), 1, 1))
    return (F.when(first == "", outcome("", "empty char cell")).when(first.rlike("^[A-Z0-9]$"), outcome(first, ""))
            .otherwise(_failed("invalid char", value)))


def _calendar(d: Column, m: Column, y: Column) -> Column:
    """ISO text of a plausible date, or null."""
    full = F.when(y < 100, y + 2000).otherwise(y)
    ok = full.between(2000, 2100) & m.between(1, 12) & (d >= 1)
    return F.when(ok & (d <= month_end(full, F.when(ok, m))), date_text(full, m, d))


def date(value: Column) -> Column:
    worded = r"(\d{1,2})\s*(" + "|".join(MONTH_NAMES) + r")\w*\s*(\d{2,4})"
    plain = r"(\d{1,2})\s*[/\-\s]\s*(\d{1,2})\s*[/\-\s]\s*(\d{2,4})"

    def read(raw: Column) -> Column:
        d, word, y = (F.regexp_extract(raw, worded, i) for i in (1, 2, 3))
        m = F.array_position(F.array(*[F.lit(n) for n in MONTH_NAMES]), word).cast("int")
        year_ok = F.when(as_int(y) < 100, True).otherwise(as_int(y).between(2000, 2100))
        by_word = let(_calendar(as_int(d), m, as_int(y)), lambda iso: F.when(iso.isNotNull(), outcome(iso, ""))
                      .when(year_ok, outcome(value, F.concat(F.lit("invalid date: "), value)))
                      .otherwise(outcome(value, F.concat(F.lit("invalid year: "), value))))
        a, b, c = (as_int(F.regexp_extract(raw, plain, i)) for i in (1, 2, 3))
        by_number = let(F.coalesce(_calendar(a, b, c), _calendar(b, a, c)), lambda iso: F.when(iso.isNotNull(), outcome(iso, ""))
                        .otherwise(_failed("invalid date", value)))
        return F.when(word != "", by_word).when(a.isNotNull(), by_number).otherwise(_failed("unrecognized date", value))

    return let(F.upper(F.trim(value)), read)


def _code_inside(text: Column) -> Column:
    found = []
    for code in sorted(FLIGHT_CODES, key=len, reverse=True):
        at = F.instr(text, code)
        following = F.substring(text, at + len(code), F.lit(1))
        found.append(F.when(at > 0, F.concat(F.lit(code), F.when(following.rlike("[0-9]"), following).otherwise(""))))
    return F.coalesce(*found)


def _best_number(text: Column) -> Column:
    """Best run of three or four characters that read as digits: struct(real, length, start, digits)."""
    inner = F.regexp_replace(text, "(?<=[0-9])[CD](?=[0-9])", "0")
    mapped = F.regexp_replace(F.translate(inner, FLIGHT_LETTERS, FLIGHT_DIGITS), "[^0-9]", "#")

    def search(m: Column) -> Column:
        def run(i: Column) -> Column:
            opens = F.substring(m, i, F.lit(1)).rlike("[0-9]") & ((i == 1) | (F.substring(m, i - 1, F.lit(1)) == "#"))
            number = F.regexp_extract(F.substring(m, i, F.lit(1000)), "^[0-9]+", 0)
            real = F.length(F.regexp_replace(F.substring(text, i, F.length(number)), "[^0-9]", ""))
            return F.when(opens & F.length(number).between(3, 4) & (real > 0),
                          F.struct(real.alias("real"), F.length(number).alias("length"), i.alias("start"), number.alias("digits")))
        return F.array_max(F.transform(F.sequence(F.lit(1), F.length(m)), run))

    return let(mapped, search)


def _nearest_code(token: Column) -> Column:
    """The only vocabulary word one stroke away, or null."""
    chars = "".join(FLIGHT_STROKES)
    heads = "".join(g[0] * len(g) for g in FLIGHT_STROKES)

    def ranked(code: str) -> Column:
        seen, wanted = F.translate(token, chars, heads), code.translate(str.maketrans(chars, heads))
        by_stroke = sum((F.substring(seen, i + 1, 1) != wanted[i]).cast("int") for i in range(len(code)))
        distance = F.when(F.length(token) == len(code), by_stroke).otherwise(F.levenshtein(token, F.lit(code)))
        return F.struct(distance.alias("d"), F.abs(F.length(token) - len(code)).alias("l"), F.lit(code).alias("code"))

    def choose(options: Column) -> Column:
        best = F.array_min(options)
        ties = F.filter(options, lambda o: (o["d"] == best["d"]) & (o["l"] == best["l"]))
        return F.when((best["d"] <= 1) & (F.size(ties) == 1), best["code"])

    return F.when(F.length(token) >= 2, let(F.array(*[ranked(c) for c in FLIGHT_CODES]), choose))


def flight_number(value: Column) -> Column:
    def note_unless(same: Column) -> Column:
        return F.when(same, "").otherwise(FLIGHT_NOTE)

    def read(text: Column) -> Column:
        invalid = _failed("invalid flight number", value)
        only_digits = F.when((F.length(text) <= 4) & ~text.rlike("^0+$"), outcome(text, "")).otherwise(invalid)

        def by_run(run: Column) -> Column:
            lead = F.regexp_replace(F.substring(text, F.lit(1), run["start"] - 1), "[^A-Z]", "")
            number = F.when(lead == "", run["digits"]).when(lead == "A", F.concat(F.lit("A"), run["digits"])).otherwise(F.concat(F.lit("CM"), run["digits"]))
            return F.when(run.isNotNull(), outcome(number, note_unless(number == text)))

        tail = F.regexp_extract(text, "^CMP?(.{1,4})$", 1)
        tail_digits = F.translate(tail, TAIL_LETTERS, TAIL_DIGITS)
        prefixed = F.when((tail != "") & tail_digits.rlike("^[0-9]+$") & ((F.length(tail) >= 3) | tail.rlike("[0-9]")),
                          outcome(F.concat(F.lit("CM"), tail_digits), FLIGHT_NOTE))
        numbered = (F.length(text) > 2) & text.rlike("[0-9]$")
        token = F.when(numbered, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
        suffix = F.when(numbered, F.substring(text, F.length(text), F.lit(1))).otherwise("")
        nearest = let(_nearest_code(token), lambda c: F.when(c.isNotNull(), outcome(F.concat(c, suffix), FLIGHT_NOTE)))
        coded = let(_code_inside(text), lambda c: F.when(c.isNotNull(), outcome(c, note_unless(c == text))))
        return (F.when(text == "", outcome("", "empty flight number"))
                .otherwise(F.coalesce(coded, F.when(text.rlike("^[0-9]+$"), only_digits), let(_best_number(text), by_run),
                                      prefixed, nearest, invalid)))

    return let(F.regexp_replace(F.regexp_replace(F.upper(value), r"\b(?:FLT|FLIGHT|NO|CHECK)\b", " "), "[^A-Z0-9]", ""), read)


RULES = {"matricula": normalise_registration, "flight_number": flight_number, "date": date, "digits": digits,
         "day": day, "month": month, "year": year, "char": char}


def normalise(rule: Column, value: Column) -> Column:
    """Apply the rule named in a column; an unknown rule keeps the raw text and says so."""
    branches = None
    for name, fn in RULES.items():
        branches = F.when(rule == name, fn(value)) if branches is None else branches.when(rule == name, fn(value))
    return branches.otherwise(outcome(value, F.concat(F.lit("unknown postprocessor: "), rule)))


@F.pandas_udf(StringType())
def _unescaped(names: pd.Series) -> pd.Series:
    return names.map(html.unescape)


def unescape_name(value: Column) -> Column:
    """Undo the HTML entities of remote names, named and numeric, as HTML 5 reads them. There is one name for each batch, not for each page."""
    return F.trim(_unescaped(F.coalesce(value, F.lit(""))))


def comparable_name(value: Column) -> Column:
    """Lower-case remote name with separators collapsed to one space."""
    return F.trim(F.regexp_replace(F.lower(unescape_name(value)), r"[\s_|\-]+", " "))


def base_name(value: Column) -> Column:
    """Name without a trailing `` - user@host``."""
    return F.regexp_replace(value, r"^(.*) - ((?:(?! - ).)*@(?:(?! - ).)*)$", "$1")
