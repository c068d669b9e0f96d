"""Field rules, page status, output gates, signature rules and review lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.constants import (ABSENT_CONFIDENCE, ERROR, LOW_CONFIDENCE, MANUAL_FIELDS, MAX_EMPTY_PEAK, MAX_INK_RATIO, MIN_INK_PEAK,
                               MIN_INK_SPAN, OK, PRESENT_CONFIDENCE, REGISTRATION_RE, WARNING)
from foliant.functions.fields import (MEMBERS, add_comment, canonical_registration, log_number, log_order, page_status, update)
from foliant.functions.text import normalise
from foliant.operators.books import PAGE_ID

PAGE_COLUMNS = ["file_seq", "file", "page_number", "blank", "alignment", "date"]


def to_readings(pages: DataFrame, fields, members=None) -> DataFrame:
    """Long form: one row per (page, field) in template order, with the whole reading or only these ``members`` of it."""
    def reading(f: str) -> Column:
        return F.col(f) if members is None else F.struct(*[F.col(f)[m].alias(m) for m in members])

    cells = F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field_id"), F.lit(i).alias("field_pos"), reading(f).alias("reading")))
                      for i, f in enumerate(fields)])
    return (pages.select(*PAGE_COLUMNS, F.explode(F.array_compact(cells)).alias("c"))
            .select(*PAGE_COLUMNS, "c.field_id", "c.field_pos", "c.reading.*"))


def to_pages(readings: DataFrame, fields) -> DataFrame:
    """Wide form: one struct column per field."""
    reading = F.struct(*MEMBERS)
    return readings.groupBy(*PAGE_COLUMNS).agg(*[F.any_value(F.when(F.col("field_id") == f, reading), True).alias(f) for f in fields])


RULE = ("required", "regex", "min_length", "max_length")


def _ruled(reading: Callable[[str], Column], rule: Callable[[str], Column], known: Column) -> tuple[Column, Column]:
    """Status and comment of a reading under its field's rule; the first failure decides."""
    value, length, status, comment = reading("value"), F.length(reading("value")), reading("status"), reading("comment")
    empty = F.trim(F.coalesce(value, F.lit(""))) == ""
    mismatch = rule("regex").isNotNull() & ~F.regexp(value, F.concat(F.lit("^(?:"), rule("regex"), F.lit(")\\z")))
    low = (reading("field_type") != "signature") & (reading("confidence") < LOW_CONFIDENCE)
    cases = [(~known, F.lit(WARNING), F.lit("Campo no definido en la plantilla")),
             (empty & rule("required"), F.lit(ERROR), F.lit("Required field empty")),
             (empty, F.lit(WARNING), F.lit("Optional field empty")),
             (mismatch, F.lit(ERROR), F.concat(F.lit("Does not match pattern "), rule("regex"))),
             (length < rule("min_length"), F.lit(ERROR), F.format_string("Length %d < minimum %d", length, rule("min_length"))),
             (length > rule("max_length"), F.lit(ERROR), F.format_string("Length %d > maximum %d", length, rule("max_length"))),
             (low, F.when(status == OK, WARNING).otherwise(status),
              add_comment(comment, F.concat(F.lit("Low confidence ("), F.format_number(reading("confidence"), 2), F.lit(")"))))]
    fallback = F.when((status == OK) & (F.coalesce(comment, F.lit("")) == ""), "OK").otherwise(comment)
    return (reduce(lambda acc, c: acc.when(c[0], c[1]), cases[1:], F.when(cases[0][0], cases[0][1])).otherwise(status),
            reduce(lambda acc, c: acc.when(c[0], c[2]), cases[1:], F.when(cases[0][0], cases[0][2])).otherwise(fallback))


def apply_field_rules(readings: DataFrame, template: DataFrame) -> DataFrame:
    """Required, pattern, length and confidence rules; the first failure decides.

    ``template`` (field_id, required, regex, min_length, max_length) is a configuration table
    with one row per field of the form. Fields the template does not know become WARNING.
    """
    joined = readings.join(F.broadcast(template.select(
        "field_id", "required", "regex", "min_length", "max_length", F.lit(True).alias("_known"))), "field_id", "left")
    status, comment = _ruled(F.col, F.col, F.col("_known").isNotNull())
    return (joined.withColumn("_status", status).withColumn("_comment", comment)
            .withColumn("status", F.col("_status")).withColumn("comment", F.col("_comment"))
            .drop("required", "regex", "min_length", "max_length", "_known", "_status", "_comment"))


def validate_pages(pages: DataFrame, fields: dict[str, str], template: DataFrame) -> DataFrame:
    """Field rules on every field, then the page status. A page's readings are ruled where they are, so nothing but the
    template, as one row, is moved."""
    rules = template.agg(*[F.any_value(F.when(F.col("field_id") == f, F.struct(*RULE)), True).alias(f) for f in fields]).select(F.struct(*fields).alias("_rules"))
    cells = F.array(*[F.struct(F.col(f).alias("reading"), F.col("_rules")[f].alias("rule")) for f in fields])

    def checked_cell(cell: Column) -> Column:
        status, comment = _ruled(lambda m: cell["reading"][m], lambda m: cell["rule"][m], cell["rule"].isNotNull())
        changed = {"status": status, "comment": comment}
        return F.when(cell["reading"].isNotNull(), F.struct(*[changed.get(m, cell["reading"][m]).alias(m) for m in MEMBERS]))

    done = pages.crossJoin(F.broadcast(rules)).select(*PAGE_COLUMNS, F.transform(cells, checked_cell).alias("_done"))
    checked = done.select(*PAGE_COLUMNS, *[F.col("_done")[i].alias(f) for i, f in enumerate(fields)])
    return checked.withColumn("status", F.lit(OK)).withColumn("status", page_status(fields))


def normalise_readings(readings: DataFrame, template: DataFrame) -> DataFrame:
    """Apply each field's named rule to its raw text (``rule_value``, ``rule_note``).

    The rules are column expressions, so they run where the reading is: a distinct-and-join
    would shuffle the readings twice to save work that costs less than the shuffle.
    """
    ruled = readings.join(F.broadcast(template.select("field_id", "postprocess")), "field_id", "left")
    raw = F.coalesce(F.col("raw_value"), F.lit(""))
    result = F.when(F.col("postprocess").isNotNull(), normalise(F.col("postprocess"), raw))
    return (ruled.withColumn("_r", result)
            .select("*", F.coalesce(F.col("_r")["value"], raw).alias("rule_value"), F.coalesce(F.col("_r")["note"], F.lit("")).alias("rule_note"))
            .drop("_r"))


def accept_primary_reading(normalised: DataFrame, template: DataFrame, soft_notes: tuple[str, ...]) -> DataFrame:
    """``accepted``: the cheap reading gives a value, without a hard note, that fits the pattern."""
    joined = normalised.join(F.broadcast(template.select("field_id", "regex")), "field_id", "left")
    note, value = F.col("rule_note"), F.col("rule_value")
    soft = reduce(lambda a, b: a | b, [note.contains(s) for s in soft_notes], note == "")
    fits = F.col("regex").isNull() | F.regexp(value, F.concat(F.lit("^(?:"), F.col("regex"), F.lit(")\\z")))
    filled = F.trim(F.coalesce(F.col("raw_value"), F.lit(""))) != ""
    return joined.withColumn("accepted", filled & (value != "") & soft & fits).drop("regex")


def choose_slot_candidate(rule: Column, text: Column, confidence: Column, slot: Column, slot_confidence: Column) -> Column:
    """Whether a position-by-position reading replaces the whole-field reading."""
    differs = (text != "") & (slot != text)
    minimum = F.when(differs, 0.35).otherwise(0.25)
    wins = (text == "") | (slot == text) | rule.isin("day", "month", "year") | (slot_confidence >= confidence)
    return (slot != "") & (slot_confidence >= minimum) & wins


# Formats a value must have to be written.
DAY_RE, MONTH_RE = r"^\d{1,2}$", r"^(?:\d{1,2}|ENE|JAN|FEB|MAR|ABR|APR|MAY|JUN|JUL|AGO|AUG|SEP|OCT|NOV|DIC|DEC)$"


def gated_value(field: str, value: Column) -> Column:
    """The value if it has the field's canonical form, otherwise an empty cell."""
    stem, _, tail = field.partition("_")
    rule = None
    if field == "matricula":
        rule = value.rlike(REGISTRATION_RE)
    elif field == "day":
        rule = value.rlike(DAY_RE)
    elif field == "month":
        rule = value.rlike(MONTH_RE)
    elif field == "year":
        rule = value.rlike(r"^\d{2}$") | (value.rlike(r"^\d{4}$") & value.between("2000", "2100"))
    elif stem in ("day", "year") and tail.isdigit():
        rule = value.rlike(r"^\d$")
    elif stem == "month" and tail.isdigit():
        rule = value.rlike(r"^\p{L}$")
    text = F.coalesce(value, F.lit(""))
    return text if rule is None else F.when(rule, text).otherwise("")


def unresolved_index_pages(pages: DataFrame) -> DataFrame:
    """Pages whose index fields are empty or in ERROR, with those fields."""
    pending = F.array_compact(F.array(*[F.when(
        F.col(f).isNotNull() & ((F.coalesce(F.col(f)["value"], F.lit("")) == "") | (F.col(f)["status"] == ERROR)), F.lit(f)) for f in MANUAL_FIELDS]))
    return (pages.where(~F.col("blank")).withColumn("pending", pending).where(F.size("pending") > 0)
            .select("file_seq", "file", "page_number", "pending"))


def review_pages(pages: DataFrame) -> DataFrame:
    """Pages without a confirmed registration, with their sort position."""
    return (pages.where(~F.col("blank") & canonical_registration().isNull())
            .select("file_seq", "file", "page_number", log_order(log_number(pages.columns)).alias("log_ord")))


# Signature discrepancies. Per kind of entry: field, whether it must be present, and the texts
# for a confirmed and for an uncertain finding (fixed values).
MAINTENANCE_RULES = (
    ("pilot_signature", True, "Falta firma de piloto (entrada de mantenimiento)",
     "Firma de piloto incierta (entrada de mantenimiento); revisar"),
    ("technician_signature", True, "Falta firma de técnico (entrada de mantenimiento)",
     "Firma de técnico incierta (entrada de mantenimiento); revisar"),
    ("captain_signature", False, "Firma de capitán presente en entrada de mantenimiento",
     "No se pudo confirmar que la firma de capitán esté vacía (entrada de mantenimiento); revisar"),
    ("captain_license", False, "Licencia de capitán presente en entrada de mantenimiento",
     "No se pudo confirmar que la licencia de capitán esté vacía (entrada de mantenimiento); revisar"))
FLIGHT_RULES = (
    ("pilot_signature", True, "Falta firma de piloto", "Firma de piloto incierta; revisar"),
    ("captain_signature", True, "Falta firma de capitán", "Firma de capitán incierta; revisar"),
    ("captain_license", True, "Falta licencia del capitán", "Firma de licencia del capitán incierta; revisar"))
UNCERTAIN_RULES = (
    ("pilot_signature", True, "Falta firma de piloto (tipo de página incierto)",
     "Firma de piloto incierta (tipo de página incierto); revisar"),)
UNREADABLE_LICENSE = "Licencia de técnico ilegible; no se pudo determinar si la entrada es de mantenimiento"


def presence(field: str, limits: dict[str, tuple[float, float]]) -> Column:
    """true / false when the detector is sure by the field's limits, null when it is not."""
    present, absent = limits.get(field, (PRESENT_CONFIDENCE, ABSENT_CONFIDENCE))
    col = F.col(field)
    return (F.when((col["value"] == "true") & (col["confidence"] >= present), True)
            .when((col["value"] == "false") & (col["confidence"] >= absent), False))


def _finding(field: str, category: str, reason: str) -> Column:
    return F.struct(F.lit(field).alias("field_id"), F.lit(category).alias("category"), F.lit(reason).alias("reason"))


ALL_SIGNATURES = {f: (PRESENT_CONFIDENCE, ABSENT_CONFIDENCE) for f in (
    "pilot_signature", "captain_signature", "captain_license", "technician_license", "technician_signature")}


def with_findings(pages: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add the kind of entry and its signature findings in rule order (none on blank pages).

    ``limits`` maps the signature fields of the template to (present, absent) confidences.
    """
    limits = ALL_SIGNATURES if limits is None else limits
    licensed = presence("technician_license", limits) if "technician_license" in limits else F.lit(False)

    def findings(rules, first: Column | None = None) -> Column:
        found = [] if first is None else [first]
        for field, required, missing, uncertain in rules:
            if field in limits:
                seen = presence(field, limits)
                broken = ~seen if required else seen
                found.append(F.when(seen.isNull(), _finding(field, "uncertain", uncertain)).when(broken, _finding(field, "missing", missing)))
        return F.array_compact(F.array(*found))

    unreadable = _finding("technician_license", "uncertain", UNREADABLE_LICENSE)
    known = pages.withColumn("_license", licensed)
    state = F.col("_license")
    return known.select(
        "*", F.when(state, "mantenimiento").when(~state, "vuelo").otherwise("incierto").alias("kind"),
        F.when(F.col("blank"), F.array_compact(F.array(F.when(F.lit(False), unreadable))))
        .when(state, findings(MAINTENANCE_RULES)).when(~state, findings(FLIGHT_RULES))
        .otherwise(findings(UNCERTAIN_RULES, unreadable)).alias("findings")).drop("_license")


def classify_discrepancies(pages: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Pages breaking the signature rules of their kind, with the affected fields."""
    confirmed = F.exists("findings", lambda f: f["category"] == "missing")
    return with_findings(pages, limits).where(F.size("findings") > 0).select(
        "file_seq", "file", "page_number", canonical_registration().alias("registration"), log_number(pages.columns).alias("log_no"),
        "kind", F.when(confirmed, "missing").otherwise("uncertain").alias("category"), "findings")


def sort_discrepancies(found: DataFrame) -> DataFrame:
    return found.orderBy(log_order(F.col("log_no")), "file", "page_number")


def discrepancy_flags(pages: DataFrame) -> DataFrame:
    """Pages with ``discrepancy`` set: those with findings, whose texts are not made here. The rules look at one page, so nothing is shuffled."""
    def kept(rules) -> Column:
        return reduce(lambda a, b: a & b, [F.coalesce(presence(f, ALL_SIGNATURES) == required, F.lit(False)) for f, required, *_ in rules])

    licensed = presence("technician_license", ALL_SIGNATURES)
    # A page of an uncertain kind always has a finding.
    fine = F.when(licensed, kept(MAINTENANCE_RULES)).when(~licensed, kept(FLIGHT_RULES)).otherwise(False)
    return pages.withColumn("discrepancy", ~(F.coalesce("blank", F.lit(False)) | fine))


def signature_verdict(limits: tuple[float, float, float, float] = (MIN_INK_PEAK, MAX_EMPTY_PEAK, MIN_INK_SPAN, MAX_INK_RATIO)) -> Column:
    """struct(value, confidence, reason) from the ink measurements of a signature box."""
    peak_min, empty_max, span_min, ratio_max = limits
    peak, span = F.col("peak"), F.col("span")
    dense = peak >= peak_min
    spread = (peak >= empty_max) & (span >= span_min)
    empty = (peak < empty_max) & (F.col("coverage") < 0.03) & (F.col("weak_peak") < 0.08)

    def verdict(value: str, confidence: Column, reason: str) -> Column:
        return F.struct(F.lit(value).alias("value"), F.bround(F.round(confidence, 9), 3).alias("confidence"), F.lit(reason).alias("reason"))

    present = 0.55 + 0.45 * F.least(F.lit(1.0), peak / (3.0 * peak_min))
    absent = 0.60 + 0.35 * (1.0 - F.least(F.lit(1.0), peak / max(empty_max, 1e-6)))
    doubt = F.least(F.lit(0.5), 0.2 + 0.3 * peak / max(peak_min, 1e-6))
    return F.when(peak.isNotNull(), F.when(F.col("dark_ratio") > ratio_max, verdict("unclear", F.lit(0.15), "dark"))
                  .when(dense, verdict("true", present, "dense")).when(spread, verdict("true", present, "spread"))
                  .when(empty, verdict("false", absent, "empty")).otherwise(verdict("unclear", doubt, "shapeless")))


def verdict_status(value: Column, required: Column) -> Column:
    return F.when(value == "true", OK).when(value == "unclear", WARNING).when(required, ERROR).otherwise(WARNING)


def signature_verdicts(features: DataFrame, required: Column | None = None, **kwargs) -> DataFrame:
    judged = features.withColumn("_v", signature_verdict(**kwargs)).select("*", "_v.*").drop("_v")
    return judged.withColumn("status", verdict_status(F.col("value"), F.lit(False) if required is None else required))


def checkbox_verdicts(df: DataFrame, low: float = 0.02, high: float = 0.9, required: bool = False) -> DataFrame:
    ratio = F.col("ink_ratio")
    marked = ratio.between(low, high)
    confidence = F.bround(F.round(F.least(F.lit(1.0), F.abs(ratio - low) / 0.1 + 0.5), 9), 3)
    return df.select("*", F.when(marked, "marked").otherwise("empty").alias("value"), confidence.alias("confidence"),
                     F.when(marked, OK).otherwise(ERROR if required else WARNING).alias("status"))


def blank_pages(df: DataFrame, limit: float = 15.0) -> DataFrame:
    """Pages whose grey variance is below the scanner's noise."""
    blank = F.col("variance") < limit
    return df.withColumn("blank", blank).withColumn("status", F.when(blank, WARNING).otherwise(F.col("status")))


def mark_low_alignment(pages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Signatures on badly aligned pages are doubtful, and so is the page."""
    low = F.col("alignment") != "ok"
    note = F.lit("Alineación no confiable; firma requiere revisión")
    for field, kind in fields.items():
        if kind == "signature":
            col = F.col(field)
            pages = pages.withColumn(field, update(
                field, low & col.isNotNull(), status=F.lit(WARNING), confidence=F.least(col["confidence"], F.lit(0.40)),
                inference_method=F.lit("alignment_low"), comment=F.concat(F.coalesce(col["comment"], F.lit("")), F.lit(" | "), note)))
    return pages.withColumn("status", F.when(low & (F.col("status") == OK), WARNING).otherwise(F.col("status")))


def choose_transform(candidates: DataFrame) -> DataFrame:
    """Per page the reliable candidate with most inliers and score, or the best of any."""
    rank = F.struct(F.col("reliable").cast("int"), "inliers", "score")
    names = [c for c in candidates.columns if c not in PAGE_ID]
    return candidates.groupBy(*PAGE_ID).agg(F.max_by(F.struct(*names), rank).alias("t")).select(*PAGE_ID, "t.*")
