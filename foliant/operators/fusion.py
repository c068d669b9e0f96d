"""Fusing single-character date cells with the whole-field reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.constants import DATE_FIELDS, ERROR, MONTH_WORDS, OK, WARNING
from foliant.functions.dates import page_date
from foliant.functions.fields import let
from foliant.functions.text import RULES
from foliant.operators.books import PAGE_ID
from foliant.operators.quality import PAGE_COLUMNS, to_pages, to_readings, validate_pages

# Digits a character of a numeric cell may stand for, with the visual weight.
CELL_WEIGHTS = (
    ("O", "0", 0.90), ("Q", "0", 0.80), ("I", "1", 0.85), ("L", "1", 0.70), ("Z", "2", 0.90), ("乙", "2", 0.85), ("二", "2", 0.80),
    ("S", "5", 0.85), ("G", "6", 0.85), ("C", "6", 0.72), ("C", "0", 0.40), ("B", "8", 0.82), ("B", "6", 0.68))
# Letters read in a month cell and the letter meant, per position.
MONTH_CELL = (("3I/", "JJJ"), ("0V", "UU"), ("1IC2", "LLLL"))
# Characters accepted for an expected month letter.
MONTH_LOOKALIKES = {"J": "J3", "U": "UV0", "L": "LI1C", "O": "O0"}
EMPTY_SLOT, MISMATCH_SLOT, WINNER_MARGIN = 0.05, 0.03, 1.5


def observation(raw: Column, value: Column) -> Column:
    return F.trim(F.when(F.coalesce(raw, F.lit("")) != "", raw).otherwise(F.coalesce(value, F.lit(""))))


def digit_scores(observed: Column, confidence: Column, component: str, position: int) -> Column:
    """Map digit -> score of a numeric cell: the best of all its characters."""
    base = F.greatest(F.lit(0.05), confidence)
    extra = {("year", 1): ("4", "0"), ("day", 1): ("7", "9")}.get((component, position))

    def of_char(c: Column) -> Column:
        options = [F.when(c == ch, F.struct(F.lit(d).alias("digit"), (base * w).alias("score"))) for ch, d, w in CELL_WEIGHTS]
        options.append(F.when(c.rlike("^[0-9]$"), F.struct(c.alias("digit"), (base * 1.0).alias("score"))))
        if extra:
            options.append(F.when(c == extra[0], F.struct(F.lit(extra[1]).alias("digit"), (base * 0.35).alias("score"))))
        return F.array_compact(F.array(*options))

    chars = F.filter(F.split(F.upper(observed), ""), lambda c: c != "")
    return F.flatten(F.transform(chars, of_char))


def fuse_numeric_cells(cells: DataFrame, component: str) -> DataFrame:
    """Rank all readings of a two-cell day or year (columns ``c1, conf1, c2, conf2``).

    Adds ``ranked``: array of struct(score, value), best first; equal scores put the larger value first.
    """
    def best_per_digit(scores: Column) -> Column:
        digits = F.array_distinct(F.transform(scores, lambda s: s["digit"]))
        return F.transform(digits, lambda d: F.struct(
            d.alias("digit"), F.array_max(F.transform(F.filter(scores, lambda s: s["digit"] == d), lambda s: s["score"])).alias("score")))

    def pairs(left: Column, right: Column) -> Column:
        joined = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.struct(
            F.bround(F.round((a["score"] + b["score"]) / 2.0, 9), 3).alias("score"), F.concat(a["digit"], b["digit"]).alias("value")))))
        valid = joined if component == "year" else F.filter(joined, lambda p: p["value"].cast("int").between(1, 31))
        return F.sort_array(valid, asc=False)

    ranked = let(digit_scores(F.col("c1"), F.col("conf1"), component, 0), lambda a: let(
        digit_scores(F.col("c2"), F.col("conf2"), component, 1), lambda b: pairs(best_per_digit(a), best_per_digit(b))))
    return cells.withColumn("ranked", ranked)


def month_letter(value: Column, position: int) -> Column:
    """Letter of a month cell after undoing the position's usual confusions; empty if unusable."""
    seen, meant = MONTH_CELL[position]
    letter = F.translate(F.upper(value), seen, meant)
    return F.when((F.length(value) == 1) & letter.rlike("^[A-Z]$"), letter).otherwise("")


def fuse_month_cells(cells: DataFrame) -> DataFrame:
    """Letters and scores per position from cells (``c1..c3, conf1..conf3``) and the whole field (``raw, conf``)."""
    whole = F.regexp_replace(F.coalesce(F.col("raw"), F.lit("")), "[^A-Za-z0-9/]", "")
    letters, scores = [], []
    for i in range(3):
        own = month_letter(F.col(f"c{i + 1}"), i)
        other = F.when(F.length(whole) == 3, month_letter(F.substring(whole, i + 1, 1), i)).otherwise("")
        letter = F.when(own != "", own).otherwise(other)
        letters.append(letter)
        scores.append(F.greatest(F.when(own != "", F.col(f"conf{i + 1}")).otherwise(0.0), F.when(other == letter, F.col("conf")).otherwise(0.0)))
    return cells.select("*", *[c.alias(f"letter{i + 1}") for i, c in enumerate(letters)], *[c.alias(f"score{i + 1}") for i, c in enumerate(scores)])


def decode_month_slots(slots: DataFrame) -> DataFrame:
    """Month word of three slots (``c1..c3, conf1..conf3``): the product of slot scores, clear winners only.

    Adds ``month_word`` (empty when undecided) and ``month_conf``.
    """
    chars = [F.when(F.col(f"c{i}").rlike("^[A-Za-z0-9]$"), F.upper(f"c{i}")).otherwise("") for i in (1, 2, 3)]
    confs = [F.col(f"conf{i}") for i in (1, 2, 3)]

    def matches(i: int, expected: str) -> Column:
        return chars[i].isin(*MONTH_LOOKALIKES.get(expected, expected))

    def rated(word: str) -> Column:
        factors = [F.when(matches(i, c), F.when(confs[i] == 0, EMPTY_SLOT).otherwise(confs[i])).when(chars[i] == "", EMPTY_SLOT).otherwise(MISMATCH_SLOT)
                   for i, c in enumerate(word)]
        hits = sum(matches(i, c).cast("int") for i, c in enumerate(word))
        return F.struct((factors[0] * factors[1] * factors[2]).alias("score"), hits.alias("matches"), F.lit(word).alias("word"))

    ranked = F.sort_array(F.array(*[rated(w) for w, _ in MONTH_WORDS]), asc=False)
    positive = [F.when(c > 0, c) for c in confs]
    count = sum(p.isNotNull().cast("int") for p in positive)
    mean = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in positive]) / count
    seen = sum((c != "").cast("int") for c in chars)
    ranked_df = slots.withColumn("_r", ranked).withColumn("_seen", seen).withColumn("_mean", F.when(count > 0, F.bround(F.round(mean, 9), 3)))
    best, runner = F.col("_r")[0], F.col("_r")[1]
    wins = (F.col("_mean").isNotNull() & (F.col("_seen") >= 2) & (best["matches"] >= 2)
            & ((runner["score"] <= 0) | (best["score"] >= runner["score"] * WINNER_MARGIN)))
    return (ranked_df.withColumn("month_word", F.when(wins, best["word"]).otherwise(""))
            .withColumn("month_conf", F.when(wins, F.bround(F.round(F.col("_mean") * best["matches"] / 3.0, 9), 3)).otherwise(0.0)).drop("_r", "_seen", "_mean"))


def arbitrate(df: DataFrame, component: str) -> DataFrame:
    """Settle a cell reading (``cell_raw, cell_conf``, and whether any cell was read, ``cells_seen``) against
    the whole-field reading (``value, confidence, status, alternatives, method``).

    Replaces the field, keeps the cell reading as an alternative, or rejects two weak readings.
    """
    month = component == "month"
    df = df.withColumn("_rule", RULES[component](F.coalesce(F.col("cell_raw"), F.lit(""))))
    raw, conf, value = F.coalesce(F.col("cell_raw"), F.lit("")), F.col("cell_conf"), F.col("value")
    candidate, note = F.col("_rule")["value"], F.col("_rule")["note"]
    numeric = note.contains("numeric handwritten month") if month else F.lit(False)
    has_value = F.coalesce(value, F.lit("")) != ""
    own_digits = F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")
    usable = (raw != "") & (candidate != "") & ((note == "") | numeric)
    if month:
        usable = usable & ~(numeric & (own_digits != "") & (own_digits.try_cast("int") != candidate.try_cast("int")))
        minimum = F.when(raw.isin(*[w for w, _ in MONTH_WORDS]), 0.18).otherwise(0.35)
    else:
        minimum = F.lit(0.35)
    usable = usable & (conf >= minimum) & ~((value == candidate) & (F.col("status") == OK) & ~numeric)
    conflict = has_value & (value != candidate) & (F.col("status") != ERROR) & (conf < (0.55 if month else 0.65))
    action = (F.when((raw == "") & ~has_value & F.col("cells_seen"), "incomplete").when(~F.coalesce(usable, F.lit(False)), "keep")
              .when(conflict & (F.col("confidence") < 0.5), "reject").when(conflict, "alternative").otherwise("replace"))
    df = df.withColumn("action", action)
    known = F.coalesce(F.col("alternatives"), F.array().cast("array<string>"))

    def added(items: Column, new: Column) -> Column:
        return F.when((F.coalesce(new, F.lit("")) == "") | F.array_contains(items, F.coalesce(new, F.lit(""))), items).otherwise(F.array_append(items, new))

    act = F.col("action")
    df = df.withColumn("_kept", F.when(act.isin("alternative", "reject"), added(known, candidate)).otherwise(known))
    alternatives = F.when((act == "reject") | ((act == "replace") & (value != candidate)), added(F.col("_kept"), value)).otherwise(F.col("_kept"))
    settled = df.select(
        *[c for c in df.columns if c not in ("value", "confidence", "status", "alternatives", "method", "_rule", "_kept")],
        F.when(act == "replace", candidate).when(act.isin("reject", "incomplete"), None).otherwise(value).alias("value"),
        F.when(act == "replace", conf).otherwise(F.col("confidence")).alias("confidence"),
        F.when(act == "replace", F.when(numeric, WARNING).otherwise(OK)).when(act.isin("reject", "incomplete"), ERROR).otherwise(F.col("status")).alias("status"),
        alternatives.alias("alternatives"), F.when(act == "replace", "date_cells").otherwise(F.col("method")).alias("method"))
    if component != "day":
        return settled
    # One digit without a known position may be half of a two-digit day.
    lone = F.coalesce(F.col("value").rlike("^[0-9]$"), F.lit(False)) & ~F.coalesce(F.col("method"), F.lit("")).isin("ranuras", "date_cells")
    return (settled.withColumn("_lone", lone).withColumn("alternatives", F.when(F.col("_lone"), added(F.col("alternatives"), F.col("value"))).otherwise(F.col("alternatives")))
            .withColumn("status", F.when(F.col("_lone"), ERROR).otherwise(F.col("status"))).withColumn("value", F.when(~F.col("_lone"), F.col("value"))).drop("_lone"))


def apply_review_verdicts(readings: DataFrame, verdicts: DataFrame, required: Column) -> DataFrame:
    """Readings after an external second reader's answers (``verdict``: signature true/false; ``text``: normalised
    value with ``note``); keys are (file_seq, page_number, field_id)."""
    key = ["file_seq", "page_number", "field_id"]
    answers = verdicts.select(*key, "verdict", F.col("text").alias("_text"), F.coalesce("note", F.lit("")).alias("_note"))
    joined = readings.join(answers, key, "left")
    signed, texted = F.col("verdict").isNotNull(), F.coalesce(F.col("_text"), F.lit("")) != ""
    soft = F.col("_note").isin("", "registration: digits inferred from scattered OCR (low confidence)",
                               "registration: handwritten characters read as digits", "flight number matched against the logbook vocabulary")
    return joined.select(
        *[c for c in readings.columns if c not in ("value", "confidence", "status", "source", "inference_method", "comment")],
        F.when(signed, F.col("verdict").cast("string")).when(texted, F.col("_text")).otherwise(F.col("value")).alias("value"),
        F.when(signed, 0.90).when(texted, F.greatest(F.col("confidence"), F.lit(0.80))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(signed, F.when(F.col("verdict"), OK).when(required, ERROR).otherwise(WARNING)).when(texted, F.when(soft, OK).otherwise(ERROR))
        .otherwise(F.col("status")).alias("status"),
        F.when(signed | texted, "vlm").otherwise(F.col("source")).alias("source"),
        F.when(signed, "vlm_signature_review").when(texted, "vlm_text_review").otherwise(F.col("inference_method")).alias("inference_method"),
        F.when(signed, F.when(F.col("verdict"), "Firma verificada por VLM (PRESENTE)").otherwise("Firma verificada por VLM (AUSENTE)"))
        .when(texted, F.when(F.col("_note") == "", "Verificado por VLM").otherwise(F.col("_note"))).otherwise(F.col("comment")).alias("comment"))


def follow_up_review(pages: DataFrame, verdicts: DataFrame, fields: dict[str, str], template: DataFrame) -> DataFrame:
    """Pages after a second reader's answers: only those that were asked about are rewritten, their fields checked by the template's
    rules and their status found anew; where a text answers for a part of the date, the date is combined again.

    ``verdicts`` as for ``apply_review_verdicts``. Pages without an answer pass as they are.
    """
    part = F.col("field_id").isin(*DATE_FIELDS) & (F.coalesce(F.col("text"), F.lit("")) != "")
    asked = verdicts.groupBy(*PAGE_ID).agg(F.max(part).alias("_dated"))
    columns = [*PAGE_COLUMNS, "status", *fields]
    readings = to_readings(pages.join(asked.select(*PAGE_ID), PAGE_ID, "left_semi"), list(fields))
    required = readings.join(F.broadcast(template.select("field_id", "required")), "field_id", "left")
    answered = to_pages(apply_review_verdicts(required, verdicts, F.coalesce("required", F.lit(False))), list(fields))
    dated = answered.join(asked, PAGE_ID).withColumn("date", F.when(F.col("_dated"), page_date()).otherwise(F.col("date")))
    checked = validate_pages(dated.drop("_dated"), fields, template).select(*columns)
    return pages.select(*columns).join(asked.select(*PAGE_ID), PAGE_ID, "left_anti").select(*columns).unionByName(checked)
