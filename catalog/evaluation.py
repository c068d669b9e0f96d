"""Signature rules, scoring against labels, tuning, and the fusion of date cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.pages import FIELDS, status_sql, template_table
from catalog.registry import register
from catalog.tables import PAGES
from foliant.constants import SIGNATURE_FIELDS
from foliant.operators import evaluate as E
from foliant.operators import fusion as U
from foliant.operators import quality as Q
from foliant.plans import derived as D

SIGNATURES = ("pilot_signature", "captain_signature", "captain_license", "technician_license", "technician_signature")


def features(spark, folder):
    """One row of ink measurements per order, from its lines (in hundredths, so sums stay exact)."""
    lines = D.table(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        (F.round(F.min("l_discount") * 100) * 2 / 100.0).alias("peak"), (F.round(F.min("l_tax") * 100) * 2 / 100.0).alias("weak_peak"), (F.round(F.min("l_discount") * 100) / 400.0).alias("coverage"),
        (F.min("l_quantity") / 50.0).alias("span"), ((F.min("l_linenumber") % 8) / 10.0).alias("dark_ratio"))


def labels(spark, folder):
    label = F.when(F.col("quality") == 1, "firma").when(F.col("toxic") == 1, "dudosa").otherwise("ausente")
    return D.table(spark, folder, "labels").select(F.col("doc_id").alias("sample_id"), label.alias("label"))


def samples(spark, folder):
    """Labelled samples with their field, order and (where measured) features."""
    field = F.element_at(F.array(*[F.lit(f) for f in SIGNATURES]), (F.col("sample_id") % 3 + 1).cast("int"))
    named = labels(spark, folder).select("*", field.alias("field_id"), F.col("sample_id").alias("sample_seq"), (F.col("sample_id") % 4).alias("book"))
    return named.join(features(spark, folder), "sample_id", "left")


FEATURES = """
features AS (SELECT l_orderkey AS sample_id, round(min(l_discount) * 100) * 2 / 100.0 AS peak, round(min(l_tax) * 100) * 2 / 100.0 AS weak_peak, round(min(l_discount) * 100) / 400.0 AS coverage,
  min(l_quantity) / 50.0 AS span, (min(l_linenumber) % 8) / 10.0 AS dark_ratio FROM lineitem GROUP BY l_orderkey),
labelled AS (SELECT doc_id AS sample_id, CASE WHEN quality = 1 THEN 'firma' WHEN toxic = 1 THEN 'dudosa' ELSE 'ausente' END AS label,
  ['pilot_signature', 'captain_signature', 'captain_license'][doc_id % 3 + 1] AS field_id, doc_id % 4 AS book FROM labels),
samples AS (SELECT l.*, peak, weak_peak, coverage, span, dark_ratio FROM labelled l LEFT JOIN features USING (sample_id)),
"""
VERDICT = ("CASE WHEN peak IS NULL THEN NULL WHEN dark_ratio > 0.6 THEN 'unclear' WHEN peak >= 0.12 OR (peak >= 0.05 AND span >= 0.3) THEN 'true' "
           "WHEN peak < 0.05 AND coverage < 0.03 AND weak_peak < 0.08 THEN 'false' ELSE 'unclear' END")
JUDGED = FEATURES + f"judged AS (SELECT *, {VERDICT} AS verdict FROM samples),\n"


@register("signature_verdicts", "long sample_id, string value, double confidence, string reason, string status", f"""
SELECT sample_id, verdict AS value, round_even(round(CASE reason WHEN 'dark' THEN 0.15 WHEN 'empty' THEN 0.6 + 0.35 * (1 - least(1.0, peak / 0.05)) WHEN 'shapeless' THEN least(0.5, 0.2 + 0.3 * peak / 0.12)
  ELSE 0.55 + 0.45 * least(1.0, peak / (3 * 0.12)) END, 9), 3) AS confidence, reason, CASE verdict WHEN 'true' THEN 'OK' ELSE 'WARNING' END AS status FROM (SELECT *, {VERDICT} AS verdict,
  CASE WHEN dark_ratio > 0.6 THEN 'dark' WHEN peak >= 0.12 THEN 'dense' WHEN peak >= 0.05 AND span >= 0.3 THEN 'spread' WHEN peak < 0.05 AND coverage < 0.03 AND weak_peak < 0.08 THEN 'empty' ELSE 'shapeless' END AS reason FROM features)""", FEATURES)
def signature_verdicts(spark, folder):
    return Q.signature_verdicts(features(spark, folder))


@register("labelled_samples", "long sample_id, string label", "SELECT sample_id, label FROM labelled JOIN features USING (sample_id) WHERE label <> 'dudosa'", FEATURES)
def labelled_samples(spark, folder):
    return E.labelled_samples(features(spark, folder).select("sample_id"), labels(spark, folder))


@register("missing_features", "long sample_id", "SELECT sample_id FROM labelled WHERE sample_id NOT IN (SELECT sample_id FROM features WHERE sample_id % 5 <> 0)", FEATURES)
def missing_features(spark, folder):
    cached = features(spark, folder).where("sample_id % 5 <> 0").select("sample_id", F.lit("px0.00_py0.10_d80").alias("setting"))
    return E.missing_features(labels(spark, folder).select("sample_id"), cached, "px0.00_py0.10_d80")


SCORE = """count(*) FILTER (known) AS total, count(*) FILTER (known AND ((label = 'firma' AND verdict = 'true') OR (label = 'ausente' AND verdict = 'false'))) AS correct,
  count(*) FILTER (label = 'ausente' AND verdict = 'true') AS false_present, count(*) FILTER (label = 'firma' AND verdict = 'false') AS false_absent,
  count(*) FILTER (label = 'firma' AND verdict = 'unclear') AS unclear_present, count(*) FILTER (label = 'ausente' AND verdict = 'unclear') AS unclear_absent"""
SCORE_COLUMNS = "long total, long correct, long false_present, long false_absent, long unclear_present, long unclear_absent, double cost"
COST = "round((false_present * 6 + false_absent * 4 + unclear_present + unclear_absent) / total, 9) AS cost"


@register("score_verdicts", "string field_id, " + SCORE_COLUMNS, f"""
SELECT *, {COST} FROM (SELECT field_id, {SCORE} FROM (SELECT *, label <> 'dudosa' AND verdict IS NOT NULL AS known FROM judged) GROUP BY field_id)""", JUDGED)
def score_verdicts(spark, folder):
    return E.score_verdicts(E.classify_features(samples(spark, folder)), ("field_id",)).withColumn("cost", F.round("cost", 9))


@register("confusion", "string label, string verdict, long samples", "SELECT label, coalesce(verdict, 'None') AS verdict, count(*) AS samples FROM judged GROUP BY ALL", JUDGED)
def confusion(spark, folder):
    return E.confusion(E.classify_features(samples(spark, folder)))


GRID = """
grid AS (SELECT round(0.03 + 0.01 * p, 3) AS ph, round(0.01 + 0.01 * e, 3) AS pl, s AS sp, row_number() OVER (ORDER BY p, e, s) AS ord FROM range(28) a(p), range(15) b(e),
  (SELECT unnest([0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.60, 0.70, 1.0]) AS s) WHERE round(0.01 + 0.01 * e, 3) <= round(0.03 + 0.01 * p, 3)),
"""


def tuned_sql(source: str, keys: str) -> str:
    """Every grid point scored against every sample; the first cheapest that resolves enough."""
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""SELECT {lead}ph AS min_ink_peak, pl AS max_empty_peak, sp AS min_ink_span, total, correct, false_present, false_absent, unclear_present, unclear_absent, round(points / total, 9) AS cost, any_ok AS resolved FROM (
  SELECT *, bool_or(ok) OVER ({part}) AS any_ok, row_number() OVER ({part}ORDER BY ok DESC, points, ord) AS r FROM (
  SELECT *, false_present * 6 + false_absent * 4 + unclear_present + unclear_absent AS points, (total - unclear_present - unclear_absent) / total >= 0.8 AS ok FROM (
  SELECT {lead}ph, pl, sp, ord, count(*) AS total, count(*) FILTER ((label = 'firma' AND yes) OR (label = 'ausente' AND no)) AS correct, count(*) FILTER (label = 'ausente' AND yes) AS false_present,
   count(*) FILTER (label = 'firma' AND no) AS false_absent, count(*) FILTER (label = 'firma' AND NOT yes AND NOT no) AS unclear_present, count(*) FILTER (label = 'ausente' AND NOT yes AND NOT no) AS unclear_absent FROM (
   SELECT *, use AND hit AS yes, use AND NOT hit AND low AS no FROM (SELECT {lead}label, ph, pl, sp, ord, peak IS NOT NULL AND dark_ratio <= 0.6 AS use, coalesce(peak >= ph OR (peak >= pl AND span >= sp), false) AS hit,
     coalesce(peak < pl AND coverage < 0.03 AND weak_peak < 0.08, false) AS low FROM {source}, grid WHERE label <> 'dudosa')) GROUP BY ALL))) WHERE r = 1"""


TUNED = "double min_ink_peak, double max_empty_peak, double min_ink_span, long total, long correct, long false_present, long false_absent, long unclear_present, long unclear_absent, double cost, boolean resolved"


@register("tune_thresholds", TUNED, tuned_sql("samples", ""), FEATURES + GRID)
def tune_thresholds(spark, folder):
    return E.tune_thresholds(samples(spark, folder)).withColumn("cost", F.round("cost", 9))


@register("tune_fields", "string field_id, " + TUNED, tuned_sql("enough", "field_id"), FEATURES + GRID + "enough AS (SELECT * FROM samples WHERE field_id IN (SELECT field_id FROM samples WHERE label <> 'dudosa' GROUP BY field_id HAVING count(*) >= 40)),\n")
def tune_fields(spark, folder):
    return E.tune_fields(samples(spark, folder)).withColumn("cost", F.round("cost", 9))


# Three crop settings: other margins read less ink, another delta reads more.
SETTINGS = FEATURES + GRID + """
settings AS (SELECT label, 0.0 AS pad_x, 0.1 AS pad_y, 80.0 AS delta, peak, weak_peak, coverage, span, dark_ratio FROM samples UNION ALL SELECT label, 0.0, 0.1, 60.0, peak * 2, weak_peak, coverage, span, dark_ratio FROM samples
  UNION ALL SELECT label, 0.05, 0.1, 80.0, peak / 2, weak_peak, coverage, span, dark_ratio FROM samples),
"""
TUNE_SETTINGS = tuned_sql("settings", "pad_x, pad_y, delta")


@register("tune_over_settings", "string choice, double pad_x, double pad_y, double delta, " + TUNED, f"""
SELECT * FROM (SELECT 'best' AS choice, * FROM ({TUNE_SETTINGS}) ORDER BY cost, (pad_x <> 0.0 OR pad_y <> 0.1), abs(delta - 80) LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'applicable' AS choice, * FROM ({TUNE_SETTINGS}) WHERE pad_x = 0.0 AND pad_y = 0.1 ORDER BY cost, abs(delta - 80) LIMIT 1)""", SETTINGS)
def tune_over_settings(spark, folder):
    base = samples(spark, folder)
    names = ["label", "pad_x", "pad_y", "delta", *E.FEATURES]

    def setting(x, y, d, scale):
        return base.select("label", F.lit(x).alias("pad_x"), F.lit(y).alias("pad_y"), F.lit(d).alias("delta"), (F.col("peak") * scale).alias("peak"), "weak_peak", "coverage", "span", "dark_ratio").select(*names)

    every = setting(0.0, 0.1, 80.0, 1.0).unionByName(setting(0.0, 0.1, 60.0, 2.0)).unionByName(setting(0.05, 0.1, 80.0, 0.5))
    return E.tune_over_settings(every, (0.0, 0.1, 80.0)).withColumn("cost", F.round("cost", 9))


FOLDS = FEATURES + GRID + """
folded AS (SELECT *, (row_number() OVER (PARTITION BY field_id, label ORDER BY sample_id) - 1) % 4 AS fold FROM samples WHERE label <> 'dudosa'),
training AS (SELECT t.f AS test_fold, s.* FROM folded s, range(4) t(f) WHERE s.fold <> t.f),
chosen AS (""" + tuned_sql("training", "test_fold") + """),
tested AS (SELECT c.test_fold, min_ink_peak, max_empty_peak, min_ink_span, label, CASE WHEN peak IS NULL OR dark_ratio > 0.6 THEN 'unclear' WHEN peak >= min_ink_peak OR (peak >= max_empty_peak AND span >= min_ink_span) THEN 'true'
  WHEN peak < max_empty_peak AND coverage < 0.03 AND weak_peak < 0.08 THEN 'false' ELSE 'unclear' END AS verdict, TRUE AS known FROM folded s JOIN chosen c ON c.test_fold = s.fold),
"""


@register("cross_validate", "long test_fold, double min_ink_peak, double max_empty_peak, double min_ink_span, " + SCORE_COLUMNS, f"""
SELECT *, {COST} FROM (SELECT test_fold, min_ink_peak, max_empty_peak, min_ink_span, {SCORE} FROM tested GROUP BY ALL)""", FOLDS)
def cross_validate(spark, folder):
    measured = samples(spark, folder).where("label <> 'dudosa'")
    return E.cross_validate(measured, 4).withColumn("cost", F.round("cost", 9))


@register("serious_errors", "long sample_id, string kind", """
SELECT sample_id, kind FROM (SELECT *, CASE WHEN label = 'firma' AND verdict = 'false' THEN 'false_absent' WHEN label = 'ausente' AND verdict = 'true' THEN 'false_present' END AS kind FROM judged)
WHERE kind IS NOT NULL ORDER BY sample_id LIMIT 20""", JUDGED)
def serious_errors(spark, folder):
    return E.serious_errors(E.classify_features(samples(spark, folder)), 20)


# Ink over the book's background for every signature box: empty boxes read low, signed ones high, some in between.
BOXES = PAGES + """
boxes AS (SELECT page_number, blank, alignment, CASE WHEN log_no IS NULL THEN 'unknown' ELSE book END AS book, f.field_id, f.value, f.confidence,
  CASE f.value WHEN 'true' THEN 20 + (k * 7 + f.no) % 60 WHEN 'false' THEN (k * 11 + f.no) % 19 + CASE WHEN k % 37 = 0 THEN 9 ELSE 0 END ELSE (k * 13 + f.no) % 70 END / 100.0 AS peak FROM pages,
  LATERAL (VALUES """ + ", ".join(f"('{f}', {f}, {f}_conf, {i})" for i, f in enumerate(SIGNATURE_FIELDS, 1)) + """) f(field_id, value, confidence, no)),
ranked AS (SELECT book, field_id, value, peak, row_number() OVER (PARTITION BY book, field_id, value ORDER BY CASE value WHEN 'true' THEN peak ELSE -peak END) AS r, count(*) OVER (PARTITION BY book, field_id, value) AS n FROM boxes WHERE value <> 'unclear'),
tried AS (SELECT s.book, s.field_id, e.peak AS ceiling, s.peak AS floor, (s.r - 1) + (e.r - 1) AS dropped, s.r - 1 AS from_signed FROM ranked s JOIN ranked e ON e.book = s.book AND e.field_id = s.field_id
  WHERE s.value = 'true' AND e.value = 'false' AND s.r <= 3 AND e.r <= 3 AND s.n - s.r + 1 >= 3 AND e.n - e.r + 1 >= 3 AND s.peak > e.peak),
bands AS (SELECT book, field_id, ceiling, floor FROM tried QUALIFY row_number() OVER (PARTITION BY book, field_id ORDER BY floor - ceiling < 0.03,
  CASE WHEN floor - ceiling >= 0.03 THEN 0 ELSE ceiling - floor END, dropped, from_signed) = 1),
"""


def boxes(spark, folder):
    from foliant.operators.books import with_books
    k = F.col("page_number") - 1
    pages = with_books(D.pages(spark, folder))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_id"), F.col(f)["value"].alias("value"), F.col(f)["confidence"].alias("confidence"), F.lit(i).alias("no"))
                                for i, f in enumerate(SIGNATURE_FIELDS, 1)]))
    rows = pages.select("page_number", "blank", "alignment", "book", cells.alias("c")).select("page_number", "blank", "alignment", "book", "c.*")
    ink = (F.when(F.col("value") == "true", 20 + (k * 7 + F.col("no")) % 60)
           .when(F.col("value") == "false", (k * 11 + F.col("no")) % 19 + F.when(k % 37 == 0, 9).otherwise(0)).otherwise((k * 13 + F.col("no")) % 70))
    return rows.withColumn("peak", ink / 100.0).withColumn("verdict", F.col("value")).drop("no")


@register("uncertain_band", "string book, string field_id, double ceiling, double floor", "SELECT * FROM bands", BOXES)
def uncertain_band(spark, folder):
    return E.uncertain_band(boxes(spark, folder))


REVIEWED = BOXES + """
sizes AS (SELECT book, count(*) FILTER (NOT blank AND alignment = 'ok') AS usable FROM pages GROUP BY book),
reviewed AS (SELECT b.*, CASE WHEN value = 'unclear' AND alignment = 'ok' AND usable >= 8 THEN CASE WHEN peak >= floor THEN 'true' WHEN peak <= ceiling THEN 'false' END END AS opinion, ceiling, floor
  FROM boxes b LEFT JOIN bands USING (book, field_id) LEFT JOIN sizes USING (book)),
"""


@register("signature_review_with_band", "long page_number, string field_id, string reviewed, double reviewed_confidence, string reviewed_status", """
SELECT page_number, field_id, coalesce(opinion, value) AS reviewed, CASE opinion WHEN 'true' THEN round_even(round(least(0.9, 0.72 + 0.18 * least(1.0, (peak - floor) / greatest(floor, 1e-6))), 9), 3)
  WHEN 'false' THEN round_even(round(least(0.9, 0.72 + 0.18 * least(1.0, (ceiling - peak) / greatest(ceiling, 1e-6))), 9), 3) ELSE confidence END AS reviewed_confidence,
  CASE opinion WHEN 'true' THEN 'OK' WHEN 'false' THEN 'WARNING' END AS reviewed_status FROM reviewed""", REVIEWED)
def signature_review_with_band(spark, folder):
    rows = boxes(spark, folder)
    return E.signature_review(rows, E.uncertain_band(rows))


@register("tally_before_after", "string book, long level, long verdict_correct, long verdict_unclear, long verdict_serious, long reviewed_correct, long reviewed_unclear, long reviewed_serious", """
SELECT book, grouping(book) AS level, count(*) FILTER (value = want) AS verdict_correct, count(*) FILTER (value <> want AND value = 'unclear') AS verdict_unclear, count(*) FILTER (value <> want AND value <> 'unclear') AS verdict_serious,
  count(*) FILTER (rev = want) AS reviewed_correct, count(*) FILTER (rev <> want AND rev = 'unclear') AS reviewed_unclear, count(*) FILTER (rev <> want AND rev <> 'unclear') AS reviewed_serious
FROM (SELECT *, coalesce(opinion, value) AS rev, CASE WHEN page_number % 3 = 0 THEN 'true' ELSE 'false' END AS want FROM reviewed WHERE page_number % 7 <> 0) GROUP BY ROLLUP (book)""", REVIEWED)
def tally_before_after(spark, folder):
    rows = boxes(spark, folder)
    label = F.when(F.col("page_number") % 7 == 0, "dudosa").when(F.col("page_number") % 3 == 0, "firma").otherwise("ausente")
    return E.tally_before_after(E.signature_review(rows, E.uncertain_band(rows)).withColumn("label", label))


@register("date_accuracy", "long total, long date_exact, long date_detected, long year_exact, long month_exact, long day_exact", """
SELECT count(*) AS total, count(*) FILTER (got = want) AS date_exact, count(got) AS date_detected, count(*) FILTER (got[1:4] = want[1:4]) AS year_exact, count(*) FILTER (got[6:7] = want[6:7]) AS month_exact,
  count(*) FILTER (got[9:10] = want[9:10]) AS day_exact FROM (SELECT strftime(DATE '2024-01-01' + CAST(b % 600 + s // 3 AS INTEGER), '%Y/%m/%d') AS want,
  CASE WHEN day_n <= day(last_day(make_date(2000 + year_n, month_n, 1))) THEN '20' || year || '/' || lpad(CAST(month_n AS VARCHAR), 2, '0') || '/' || day END AS got FROM pages)""", PAGES)
def date_accuracy(spark, folder):
    from foliant.functions.dates import page_date
    k = F.col("page_number") - 1
    start = F.date_add(F.to_date(F.lit("2024-01-01")), (F.floor(k / 40) % 600 + F.floor((k % 40) / 3)).cast("int"))
    pages = D.pages(spark, folder).select(F.col("page_number").cast("string").alias("file"), F.date_format(start, "yyyy/MM/dd").alias("truth"), page_date().alias("date"))
    return E.date_accuracy(pages.select("file", F.col("truth").alias("date")), pages.select("file", "date"))


# Date cells made from the page number: one character and a confidence per slot.
def pick(text: str, by):
    return F.substring(F.lit(text), (by % len(text) + 1).cast("int"), F.lit(1))


NUMERIC = "O0QI1LZ2S5G6C8B79x "


def cells(spark, folder):
    k = F.col("page_number") - 1
    return D.pages(spark, folder).select("page_number", pick(NUMERIC, k).alias("c1"), pick(NUMERIC, F.floor(k / 19)).alias("c2"),
                                         ((k * 7) % 100 / 100.0).alias("conf1"), ((k * 13) % 100 / 100.0).alias("conf2"))


WEIGHTS = """
weights AS (SELECT * FROM (VALUES ('O','0',0.90),('Q','0',0.80),('I','1',0.85),('L','1',0.70),('Z','2',0.90),('S','5',0.85),('G','6',0.85),('C','6',0.72),('C','0',0.40),('B','8',0.82),('B','6',0.68)) t(ch, digit, w)
  UNION ALL SELECT CAST(d AS VARCHAR), CAST(d AS VARCHAR), 1.0 FROM range(10) t(d)),
"""
CELLS = PAGES + WEIGHTS + f"""
cells AS (SELECT page_number, trim('{NUMERIC}'[k % {len(NUMERIC)} + 1]) AS c1, trim('{NUMERIC}'[(k // 19) % {len(NUMERIC)} + 1]) AS c2, (k * 7) % 100 / 100.0 AS conf1, (k * 13) % 100 / 100.0 AS conf2 FROM pages),
"""


def fused_sql(second: str, where: str) -> str:
    # Scores in whole units of 1e-9, rounded half to even to thousandths.
    nano = "CAST(round((greatest(0.05, conf1) * a.w + greatest(0.05, conf2) * b.w) / 2 * 1e9) AS BIGINT)"
    return f"""SELECT page_number, string_agg(value || ':' || printf('%.3f', score / 1000.0), ' ' ORDER BY score DESC, value DESC) AS ranked FROM (SELECT page_number, value,
  v // 1000000 + CASE WHEN v % 1000000 > 500000 OR (v % 1000000 = 500000 AND v // 1000000 % 2 = 1) THEN 1 ELSE 0 END AS score FROM (SELECT page_number, a.digit || b.digit AS value, {nano} AS v
  FROM cells JOIN weights a ON a.ch = upper(c1) JOIN (SELECT * FROM weights UNION ALL SELECT {second}) b ON b.ch = upper(c2))) {where} GROUP BY page_number"""


def ranked_text(df):
    return df.select("page_number", F.array_join(F.transform("ranked", lambda r: F.concat(r["value"], F.lit(":"), F.format_number(r["score"], 3))), " ").alias("ranked")).where("ranked <> ''")


@register("fuse_numeric_cells_day", "long page_number, string ranked", fused_sql("'7', '9', 0.35", "WHERE CAST(value AS INT) BETWEEN 1 AND 31"), CELLS)
def fuse_numeric_cells_day(spark, folder):
    return ranked_text(U.fuse_numeric_cells(cells(spark, folder), "day"))


@register("fuse_numeric_cells_year", "long page_number, string ranked", fused_sql("'4', '0', 0.35", ""), CELLS)
def fuse_numeric_cells_year(spark, folder):
    return ranked_text(U.fuse_numeric_cells(cells(spark, folder), "year"))


LETTERS = "J3I/AU0VEL1IC2NRO"


def slots(spark, folder):
    k = F.col("page_number") - 1
    month = F.coalesce(F.col("month")["value"], F.lit("..."))
    letter = [F.when((k + i) % 4 == 0, pick(LETTERS, F.floor(k / 4) + i)).when((k + i) % 9 == 1, "").otherwise(F.substring(month, i + 1, 1)) for i in range(3)]
    return D.pages(spark, folder).select("page_number", *[c.alias(f"c{i + 1}") for i, c in enumerate(letter)], *[((k * (7 + 2 * i)) % 100 / 100.0).alias(f"conf{i + 1}") for i in range(3)],
                                         F.col("month")["value"].alias("raw"), F.col("month")["confidence"].alias("conf"))


_SLOT = ", ".join(f"CASE WHEN (k + {i}) % 4 = 0 THEN '{LETTERS}'[(k // 4 + {i}) % {len(LETTERS)} + 1] WHEN (k + {i}) % 9 = 1 THEN '' ELSE coalesce(month, '...')[{i + 1}] END AS c{i + 1}, (k * {7 + 2 * i}) % 100 / 100.0 AS conf{i + 1}" for i in range(3))
SLOTS = PAGES + f"slots AS (SELECT page_number, {_SLOT}, coalesce(month, '') AS raw, c3 AS conf FROM pages),\n".replace("c3 AS conf", "pages.c3 AS conf")


def letter_sql(value: str, i: int) -> str:
    table = (("3I/", "JJJ"), ("0V", "UU"), ("1IC2", "LLLL"))[i]
    mapped = f"translate(upper({value}), '{table[0]}', '{table[1]}')"
    return f"CASE WHEN length({value}) = 1 AND regexp_full_match({mapped}, '[A-Z]') THEN {mapped} ELSE '' END"


_OWN = ", ".join(f"{letter_sql(f's.c{i + 1}', i)} AS own{i + 1}, CASE WHEN length(raw) = 3 THEN {letter_sql(f'raw[{i + 1}]', i)} ELSE '' END AS oth{i + 1}" for i in range(3))
_FUSED = ", ".join(f"CASE WHEN own{i} <> '' THEN own{i} ELSE oth{i} END AS letter{i}, greatest(CASE WHEN own{i} <> '' THEN conf{i} ELSE 0 END, CASE WHEN oth{i} = CASE WHEN own{i} <> '' THEN own{i} ELSE oth{i} END THEN conf ELSE 0 END) AS score{i}" for i in (1, 2, 3))


@register("fuse_month_cells", "long page_number, string letter1, string letter2, string letter3, double score1, double score2, double score3", f"""
SELECT page_number, {_FUSED} FROM (SELECT *, {_OWN} FROM slots s)""", SLOTS)
def fuse_month_cells(spark, folder):
    return U.fuse_month_cells(slots(spark, folder))


_CH = ", ".join(f"CASE WHEN regexp_full_match(s.c{i}, '[A-Za-z0-9]') THEN upper(s.c{i}) ELSE '' END AS h{i}" for i in (1, 2, 3))
_LIKE = "CASE {e} WHEN 'J' THEN {h} IN ('J','3') WHEN 'U' THEN {h} IN ('U','V','0') WHEN 'L' THEN {h} IN ('L','I','1','C') WHEN 'O' THEN {h} IN ('O','0') ELSE {h} = {e} END"
_M = ", ".join(f"{_LIKE.format(e=f'word[{i}]', h=f'h{i}')} AS m{i}" for i in (1, 2, 3))
_F = " * ".join(f"CASE WHEN m{i} THEN CASE WHEN conf{i} = 0 THEN 0.05 ELSE conf{i} END WHEN h{i} = '' THEN 0.05 ELSE 0.03 END" for i in (1, 2, 3))


@register("decode_month_slots", "long page_number, string month_word, double month_conf", f"""
SELECT page_number, CASE WHEN win THEN word ELSE '' END AS month_word, CASE WHEN win THEN round_even(round(mean * hits / 3.0, 9), 3) ELSE 0 END AS month_conf FROM (
 SELECT *, seen >= 2 AND hits >= 2 AND mean IS NOT NULL AND (runner <= 0 OR score >= runner * 1.5) AS win FROM (
 SELECT *, row_number() OVER w AS r, lead(score) OVER w AS runner FROM (
 SELECT page_number, word, CAST(m1 AS INT) + CAST(m2 AS INT) + CAST(m3 AS INT) AS hits, {_F} AS score, CAST(h1 <> '' AS INT) + CAST(h2 <> '' AS INT) + CAST(h3 <> '' AS INT) AS seen,
  round_even(round((conf1 + conf2 + conf3) / nullif(CAST(conf1 > 0 AS INT) + CAST(conf2 > 0 AS INT) + CAST(conf3 > 0 AS INT), 0), 9), 3) AS mean FROM (
  SELECT *, {_M} FROM (SELECT s.*, {_CH} FROM slots s), (SELECT unnest(['ENE','JAN','FEB','MAR','ABR','APR','MAY','JUN','JUL','AGO','AUG','SEP','OCT','NOV','DIC','DEC']) AS word)))
 WINDOW w AS (PARTITION BY page_number ORDER BY score DESC, hits DESC, word DESC)) WHERE r = 1)""", SLOTS)
def decode_month_slots(spark, folder):
    return U.decode_month_slots(slots(spark, folder))


ARBITRATION = "long page_number, string action, string value, double confidence, string status, string alternatives, string method"


@register("arbitrate_cells_vs_field", ARBITRATION, """
SELECT page_number, action, CASE action WHEN 'replace' THEN cell WHEN 'reject' THEN NULL WHEN 'incomplete' THEN NULL ELSE day END AS value, CASE WHEN action = 'replace' THEN conf ELSE c2 END AS confidence,
  CASE action WHEN 'replace' THEN 'OK' WHEN 'reject' THEN 'ERROR' WHEN 'incomplete' THEN 'ERROR' ELSE day_status END AS status,
  CASE action WHEN 'alternative' THEN concat_ws(',', day_alt, CASE WHEN cell IS DISTINCT FROM day_alt THEN cell END) WHEN 'reject' THEN concat_ws(',', day_alt, CASE WHEN cell IS DISTINCT FROM day_alt THEN cell END, day)
   WHEN 'replace' THEN concat_ws(',', day_alt, CASE WHEN day <> cell THEN day END) ELSE coalesce(day_alt, '') END AS alternatives, CASE WHEN action = 'replace' THEN 'date_cells' ELSE 'ocr' END AS method FROM (
 SELECT *, CASE WHEN cell = '' THEN CASE WHEN day IS NULL THEN 'incomplete' ELSE 'keep' END WHEN conf < 0.35 OR (day = cell AND day_status = 'OK') THEN 'keep'
  WHEN day IS NOT NULL AND day <> cell AND conf < 0.65 THEN CASE WHEN c2 < 0.5 THEN 'reject' ELSE 'alternative' END ELSE 'replace' END AS action FROM (
 SELECT *, CASE k % 4 WHEN 0 THEN true_day WHEN 1 THEN other_day WHEN 2 THEN '15' ELSE '' END AS cell, (k * 29) % 100 / 100.0 AS conf FROM pages JOIN (SELECT k, true_day, other_day FROM p1) USING (k)))""", PAGES)
def arbitrate_cells_vs_field(spark, folder):
    k = F.col("page_number") - 1
    start = F.date_add(F.to_date(F.lit("2024-01-01")), (F.floor(k / 40) % 600 + F.floor((k % 40) / 3)).cast("int"))
    true, other = F.lpad(F.day(start).cast("string"), 2, "0"), F.lpad((F.day(start) % 28 + 1).cast("string"), 2, "0")
    cell = F.when(k % 4 == 0, true).when(k % 4 == 1, other).when(k % 4 == 2, "15").otherwise("")
    day = F.col("day")
    rows = D.pages(spark, folder).select("page_number", cell.alias("cell_raw"), ((k * 29) % 100 / 100.0).alias("cell_conf"), F.lit(True).alias("cells_seen"), day["value"].alias("value"),
                                         day["confidence"].alias("confidence"), day["status"].alias("status"), day["alternatives"].alias("alternatives"), F.lit("ocr").alias("method"))
    return U.arbitrate(rows, "day").withColumn("alternatives", F.array_join("alternatives", ","))


@register("apply_review_verdicts", "long page_number, string field_id, string value, double confidence, string status, string source", """
SELECT page_number, f.field_id, CASE WHEN f.asked THEN f.answer ELSE f.value END AS value, CASE WHEN NOT f.asked THEN f.conf WHEN f.field_id = 'day' THEN greatest(f.conf, 0.8) ELSE 0.9 END AS confidence,
  CASE WHEN NOT f.asked THEN f.status WHEN f.answer = 'false' THEN 'ERROR' WHEN f.field_id = 'day' AND k % 5 = 0 THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN f.asked THEN 'vlm' WHEN f.field_id = 'day' THEN 'ocr' ELSE 'vision' END AS source FROM pages,
  LATERAL (VALUES ('pilot_signature', pilot_signature, pilot_signature_conf, 'OK', pilot_signature = 'unclear', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END), ('day', day, c2, day_status, day IS NULL, '17')) f(field_id, value, conf, status, asked, answer)""", PAGES)
def apply_review_verdicts(spark, folder):
    readings = Q.to_readings(D.pages(spark, folder), ["pilot_signature", "day"])
    return U.apply_review_verdicts(readings, answers(readings), F.lit(True))


def answers(readings):
    """A second reader's answers for unclear pilot signatures and unread days."""
    k = F.col("page_number") - 1
    signed = readings.where("field_id = 'pilot_signature' and value = 'unclear'").select("file_seq", "page_number", "field_id", (k % 2 == 0).alias("verdict"), F.lit(None).cast("string").alias("text"), F.lit("").alias("note"))
    texts = readings.where("field_id = 'day' and value is null").select("file_seq", "page_number", "field_id", F.lit(None).cast("boolean").alias("verdict"), F.lit("17").alias("text"), F.when(k % 5 == 0, "hard note").otherwise("").alias("note"))
    return signed.unionByName(texts)


# Signatures that the second reader misses become errors but do not decide the status.
REVIEW = PAGES + """
answered AS (SELECT * REPLACE (coalesce(day, '17') AS day, CASE WHEN day IS NOT NULL THEN day_status WHEN k % 5 = 0 THEN 'ERROR' ELSE 'OK' END AS day_status), day IS NULL AS dated, day IS NULL OR pilot_signature = 'unclear' AS asked,
  CASE WHEN pilot_signature <> 'unclear' THEN 'OK' WHEN k % 2 = 0 THEN 'OK' ELSE 'ERROR' END AS pilot_status FROM pages),
follow AS (SELECT page_number, file, blank, day, pilot_status, CASE WHEN dated AND day_status <> 'ERROR' AND month_status <> 'ERROR' AND year_status <> 'ERROR' AND 17 <= day(last_day(make_date(2000 + year_n, month_n, 1)))
  THEN printf('%04d/%02d/17', 2000 + year_n, month_n) END AS date, CASE WHEN asked THEN """ + status_sql("matricula", "matricula_status") + """ ELSE 'OK' END AS status FROM answered),
"""


def followed(spark, folder):
    pages = D.pages(spark, folder)
    return U.follow_up_review(pages, answers(Q.to_readings(pages, ["pilot_signature", "day"])), FIELDS, template_table(spark))


@register("follow_up_review", "long page_number, string day, string pilot_status, string date, string status", "SELECT page_number, day, pilot_status, date, status FROM follow", REVIEW)
def follow_up_review(spark, folder):
    return followed(spark, folder).select("page_number", F.col("day.value").alias("day"), F.col("pilot_signature.status").alias("pilot_status"), "date", "status")


@register("review_file_summary", "string file, long total_pages, long errors", """
SELECT file, count(*) AS total_pages, count(*) FILTER (NOT blank AND status = 'ERROR') AS errors FROM follow GROUP BY file""", REVIEW)
def review_file_summary(spark, folder):
    return followed(spark, folder).groupBy("file").agg(F.count("*").alias("total_pages"), F.count_if(~F.col("blank") & (F.col("status") == "ERROR")).alias("errors"))
