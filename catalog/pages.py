"""Books, duplicates, the registration vote, field rules and page status."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import register
from catalog.tables import FLEET, PAGES
from foliant.constants import SIGNATURE_FIELDS
from foliant.functions import fields as X
from foliant.functions.dates import month_key
from foliant.operators import books as B
from foliant.operators import fleet as V
from foliant.operators import quality as Q
from foliant.operators import summaries as S
from foliant.plans import derived as D

FIELDS = D.PAGE_FIELDS


@register("group_books", "string book, long pages, long first_log, long last_log", """
SELECT book, count(*) AS pages, min(log_no) AS first_log, max(log_no) AS last_log FROM pages GROUP BY book""", PAGES)
def group_books(spark, folder):
    return B.group_books(D.pages(spark, folder))


@register("mark_duplicates", "long page_number, long log_no, boolean dup", """
SELECT page_number, log_no, log_no IS NOT NULL AND row_number() OVER (PARTITION BY log_no ORDER BY file_seq, page_number) > 1 AS dup FROM pages""", PAGES)
def mark_duplicates(spark, folder):
    return B.mark_duplicates(D.pages(spark, folder))


@register("duplicate_groups", "long log_no, long times, string file, long page_number", """
SELECT log_no, times, file, page_number FROM (SELECT *, count(*) OVER (PARTITION BY log_no) AS times FROM pages WHERE log_no IS NOT NULL) WHERE times > 1""", PAGES)
def duplicate_groups(spark, folder):
    return B.duplicate_groups(D.pages(spark, folder))


# The vote: weights in 1/10000 (confidence in hundredths x quality in hundredths).
VOTE = PAGES + """
evidence AS (SELECT *, CAST(round(c1 * 100) AS BIGINT) * CASE
    WHEN k % 10 = 9 THEN 25 WHEN k % 10 = 8 AND length(n) - length(replace(n, '1', '')) IN (1, 2) THEN 80 ELSE 100 END AS w,
  matricula[4:7] AS number, matricula[8:10] AS suffix FROM pages WHERE matricula IS NOT NULL),
single AS (SELECT * FROM evidence QUALIFY row_number() OVER (
  PARTITION BY book, CASE WHEN log_no IS NULL THEN -k - 1 ELSE log_no END ORDER BY w DESC, page_number, file_seq) = 1),
digits AS (SELECT book, pos, number[pos] AS digit, sum(w) AS w FROM single, (SELECT unnest([1, 2, 3, 4]) AS pos) GROUP BY ALL),
mixed AS (SELECT book, string_agg(digit, '' ORDER BY pos) AS number FROM (
  SELECT * FROM digits QUALIFY row_number() OVER (PARTITION BY book, pos ORDER BY w DESC, digit) = 1) GROUP BY book),
whole AS (SELECT book, number, sum(w) AS w FROM single GROUP BY ALL),
suffixes AS (SELECT book, suffix FROM (SELECT book, suffix, sum(w) AS w FROM single GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY book ORDER BY w DESC, suffix) = 1),
chosen AS (SELECT m.book, coalesce(o.number, h.number) AS number, coalesce(o.w, h.w) AS w FROM mixed m
  LEFT JOIN whole o ON o.book = m.book AND o.number = m.number
  JOIN (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY book ORDER BY w DESC, number) = 1) h ON h.book = m.book),
winners AS (SELECT c.book, 'HP-' || c.number || s.suffix AS winner, c.w FROM chosen c JOIN suffixes s ON s.book = c.book),
readers AS (SELECT w.book, w.winner, count(p.k) AS votes,
  CASE WHEN count(p.k) > 0 THEN round_even(sum(CAST(round(p.c1 * 100) AS BIGINT)) / (count(p.k) * 100.0), 3)
       ELSE round_even(least(any_value(w.w) / 10000.0, 1.0), 3) END AS conf
  FROM winners w LEFT JOIN pages p ON p.book = w.book AND p.matricula = w.winner GROUP BY w.book, w.winner),
voted AS (SELECT p.*, r.winner, r.votes, r.conf, CASE WHEN r.winner IS NULL OR p.matricula = r.winner THEN NULL
   WHEN p.matricula IS NULL THEN 'filled' ELSE 'overwritten' END AS vote_change FROM pages p LEFT JOIN readers r ON r.book = p.book),
"""
DECISIVE_WORST = "greatest({}) > 0"


def _rank(column: str) -> str:
    return f"CASE {column} WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END"


def status_sql(registration: str, registration_status: str) -> str:
    """Page status over the derived readings, with the given registration columns."""
    log, reg, date = "log IS NOT NULL", f"{registration} IS NOT NULL", "day IS NOT NULL AND month IS NOT NULL AND year IS NOT NULL"
    worst = ", ".join(_rank(c) for c in ("log_status", registration_status, "day_status", "month_status", "year_status"))
    return (f"CASE WHEN blank THEN 'ERROR' WHEN NOT ({log} OR {reg} OR ({date})) THEN 'ERROR' "
            f"WHEN NOT ({log} AND {reg} AND ({date})) OR greatest({worst}) > 0 THEN 'WARNING' ELSE 'OK' END")


@register("book_vote", "long page_number, string matricula, double confidence, string vote_change, string comment, string status", f"""
SELECT page_number, CASE WHEN vote_change IS NULL THEN matricula ELSE winner END AS matricula, CASE WHEN vote_change IS NULL THEN c1 ELSE conf END AS confidence,
  vote_change, CASE vote_change WHEN 'overwritten' THEN 'Corrected from ''' || matricula || ''' by book consensus (' || greatest(votes, 1) || ' vote(s))'
    WHEN 'filled' THEN 'Inferred from book readings: ' || winner || ' (' || greatest(votes, 1) || ' vote(s))'
    ELSE CASE matricula_status WHEN 'ERROR' THEN 'Required field empty' WHEN 'WARNING' THEN 'Low confidence (' || printf('%.2f', c1) || ')' ELSE 'OK' END END AS comment,
  CASE WHEN blank OR vote_change IS NULL THEN 'OK' ELSE {status_sql("winner", "'OK'")} END AS status FROM voted""", VOTE)
def book_vote(spark, folder):
    voted = B.book_vote(D.pages(spark, folder), FIELDS)
    return voted.select("page_number", "matricula.value", "matricula.confidence", "vote_change", "matricula.comment", "status").toDF(
        "page_number", "matricula", "confidence", "vote_change", "comment", "status")


@register("book_vote_isolated", "long page_number, string matricula, string vote_change", """
SELECT page_number, CASE WHEN log IS NULL OR vote_change IS NULL THEN matricula ELSE winner END AS matricula,
  CASE WHEN log IS NOT NULL THEN vote_change END AS vote_change FROM voted""", VOTE)
def book_vote_isolated(spark, folder):
    voted = B.book_vote(D.pages(spark, folder), FIELDS, unknown="isolate")
    return voted.select("page_number", F.col("matricula.value").alias("matricula"), "vote_change")


MONTH_KEY = "CASE WHEN month IS NOT NULL AND year IS NOT NULL THEN '20' || year || '-' || lpad(CAST(month_n AS VARCHAR), 2, '0') ELSE 'sf' END"
COUNT_COLUMNS = "string registration, string month, long pages, long level, long no_registration, long no_month"


def counts_sql(source: str, registration: str) -> str:
    return f"""SELECT registration, month, count(*) AS pages, grouping(registration, month) AS level,
  count(*) FILTER (registration_key = 'sin_matricula') AS no_registration, count(*) FILTER (month_key = 'sf') AS no_month FROM (
  SELECT *, registration AS registration_key, month AS month_key FROM (
  SELECT coalesce({registration}, 'sin_matricula') AS registration, {MONTH_KEY} AS month FROM {source} WHERE NOT blank))
GROUP BY GROUPING SETS ((registration, month), (registration), (month), ())"""


@register("counts_by_registration_and_month", COUNT_COLUMNS, counts_sql("pages", "matricula"), PAGES)
def counts_by_registration_and_month(spark, folder):
    return S.counts_by_registration_and_month(D.pages(spark, folder))


@register("counts_after_vote", COUNT_COLUMNS, counts_sql("voted", "coalesce(winner, matricula)"), VOTE)
def counts_after_vote(spark, folder):
    return S.counts_by_registration_and_month(B.book_vote(D.pages(spark, folder), FIELDS))


@register("file_majority", "long page_number, string majority, boolean discrepancy, string matricula, string comment", """
SELECT page_number, majority, majority IS NULL OR matricula IS DISTINCT FROM majority AS discrepancy, coalesce(majority, matricula) AS matricula,
  CASE WHEN matricula IS DISTINCT FROM majority THEN 'corrected from ' || coalesce('''' || matricula || '''', 'None') || ' by majority vote'
    WHEN c1 < 0.5 THEN 'Low confidence (' || printf('%.2f', c1) || ')' ELSE 'OK' END AS comment
FROM pages LEFT JOIN (SELECT file_seq, matricula AS majority FROM (SELECT file_seq, matricula, count(*) AS n FROM pages WHERE matricula IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY file_seq ORDER BY n DESC, matricula) = 1) USING (file_seq)""", PAGES)
def file_majority(spark, folder):
    df = B.file_majority(D.pages(spark, folder))
    return df.select("page_number", "majority", "discrepancy", F.col("matricula.value").alias("matricula"), F.col("matricula.comment").alias("comment"))


@register("page_status", "long page_number, string status", f"SELECT page_number, {status_sql('matricula', 'matricula_status')} AS status FROM pages", PAGES)
def page_status(spark, folder):
    return D.pages(spark, folder).select("page_number", X.page_status(FIELDS).alias("status"))


SUMMARY = "string file, long total_pages, long ok_pages, long warning_pages, long error_pages, long blank_pages"


def summary_sql(counted: str) -> str:
    return f"""SELECT file, count(*) AS total_pages, count(*) FILTER ({counted} AND st = 'OK') AS ok_pages, count(*) FILTER ({counted} AND st = 'WARNING') AS warning_pages,
  count(*) FILTER ({counted} AND st = 'ERROR') AS error_pages, count(*) FILTER (blank) AS blank_pages
FROM (SELECT *, {status_sql('matricula', 'matricula_status')} AS st FROM pages) GROUP BY file"""


@register("file_summary", SUMMARY, summary_sql("NOT blank"), PAGES)
def file_summary(spark, folder):
    return S.file_summary(D.pages(spark, folder).withColumn("status", X.page_status(FIELDS)))


@register("file_summary_first_pass", SUMMARY, summary_sql("TRUE"), PAGES)
def file_summary_first_pass(spark, folder):
    return S.file_summary(D.pages(spark, folder).withColumn("status", X.page_status(FIELDS)), blanks_have_status=True)


@register("index_evidence", "long page_number, boolean has_log, boolean has_registration, boolean has_date", """
SELECT page_number, log IS NOT NULL AS has_log, matricula IS NOT NULL AS has_registration, day IS NOT NULL AND month IS NOT NULL AND year IS NOT NULL AS has_date FROM pages""", PAGES)
def index_evidence(spark, folder):
    evidence = X.index_evidence(list(FIELDS))
    return D.pages(spark, folder).select("page_number", *[c.alias(n) for n, c in evidence.items()])


# Damaged day, month and year texts made from the page number, to exercise the format rules.
DAMAGED = PAGES + """
damaged AS (SELECT page_number, CASE k % 6 WHEN 0 THEN day WHEN 1 THEN '0' WHEN 2 THEN '32' WHEN 3 THEN ' 7 ' WHEN 4 THEN 'x' END AS day,
  CASE k % 5 WHEN 0 THEN month WHEN 1 THEN '13' WHEN 2 THEN 'ABCD' WHEN 3 THEN 'jul' END AS month,
  CASE k % 5 WHEN 0 THEN year WHEN 1 THEN '2026' WHEN 2 THEN '216' WHEN 3 THEN '1999' END AS year, k % 7 AS turn FROM pages),
"""


def damaged_pages(spark, folder):
    k = F.col("page_number") - 1
    def text(field, mod, cases):
        value = F.when(k % mod == 0, F.col(field)["value"])
        for i, t in cases:
            value = value.when(k % mod == i, t)
        return F.col(field).withField("value", value).alias(field)
    return D.pages(spark, folder).select("page_number", text("day", 6, ((1, "0"), (2, "32"), (3, " 7 "), (4, "x"))),
                                         text("month", 5, ((1, "13"), (2, "ABCD"), (3, "jul"))), text("year", 5, ((1, "2026"), (2, "216"), (3, "1999"))))


@register("usable_components", "long page_number, boolean day, boolean month, boolean year", """
SELECT page_number, coalesce(CASE WHEN trim(day) = '' THEN false ELSE regexp_full_match(trim(day), '0?[1-9]|[12][0-9]|3[01]') END, false) AS day,
  coalesce(regexp_full_match(upper(trim(month)), '[A-Z]{3}|[0-9]{1,2}'), false) AS month, coalesce(regexp_full_match(trim(year), '[0-9]{2}([0-9]{2})?'), false) AS year FROM damaged""", DAMAGED)
def usable_components(spark, folder):
    return damaged_pages(spark, folder).select("page_number", *[X.usable_part(f).alias(f) for f in ("day", "month", "year")])


@register("gate_values", "long page_number, string day, string month, string year", """
SELECT page_number, CASE WHEN regexp_full_match(day, '[0-9]{1,2}') THEN day ELSE '' END AS day,
  CASE WHEN regexp_full_match(month, '[0-9]{1,2}') OR month IN ('ENE','JAN','FEB','MAR','ABR','APR','MAY','JUN','JUL','AGO','AUG','SEP','OCT','NOV','DIC','DEC') THEN month ELSE '' END AS month,
  CASE WHEN regexp_full_match(year, '[0-9]{2}') OR (regexp_full_match(year, '[0-9]{4}') AND year BETWEEN '2000' AND '2100') THEN year ELSE '' END AS year FROM damaged""", DAMAGED)
def gate_values(spark, folder):
    return damaged_pages(spark, folder).select("page_number", *[Q.gated_value(f, F.col(f)["value"]).alias(f) for f in ("day", "month", "year")])


def template_table(spark):
    """Rules of the form's fields (configuration)."""
    text = {"log_number": r"^\d{7}$", "matricula": r"^HP-\d{4}(CMP|WWP)$", "day": None, "month": "[A-Z]{3}", "year": r"\d{2}"}
    rules = {"log_number": "digits", "matricula": "matricula", "day": "day", "month": "month", "year": "year"}
    rows = [(f, kind, f not in ("captain_license", "technician_license"), text.get(f), 2 if f == "day" else None, 2 if f == "day" else None, rules.get(f))
            for f, kind in FIELDS.items()]
    return spark.createDataFrame(rows, "field_id string, field_type string, required boolean, regex string, min_length int, max_length int, postprocess string")


RULE_CTES = DAMAGED + """
checked AS (SELECT p.page_number, p.k, f.field_id, f.value, f.conf, f.status FROM pages p JOIN damaged d USING (page_number), LATERAL (VALUES
  ('log_number', p.log, p.c0, p.log_status), ('day', d.day, p.c2, p.day_status), ('month', d.month, p.c3, p.month_status), ('year', d.year, p.c4, p.year_status), ('matricula', p.matricula, p.c1, p.matricula_status),
  """ + ", ".join(f"('{f}', p.{f}, NULL, 'OK')" for f in SIGNATURE_FIELDS) + """) f(field_id, value, conf, status)),
ruled AS (SELECT *, CASE WHEN trim(coalesce(value, '')) = '' THEN 'empty' WHEN field_id = 'log_number' AND NOT regexp_full_match(value, '[0-9]{7}') THEN 'pattern'
   WHEN field_id = 'month' AND NOT regexp_full_match(value, '[A-Z]{3}') THEN 'pattern' WHEN field_id = 'year' AND NOT regexp_full_match(value, '[0-9]{2}') THEN 'pattern'
   WHEN field_id = 'day' AND length(value) < 2 THEN 'short' WHEN field_id = 'day' AND length(value) > 2 THEN 'long' WHEN conf < 0.5 THEN 'low' ELSE 'fine' END AS verdict,
   CASE status WHEN 'ERROR' THEN 'Required field empty' WHEN 'WARNING' THEN 'Low confidence (' || printf('%.2f', conf) || ')' ELSE 'OK' END AS old_comment FROM checked),
"""


@register("apply_field_rules", "long page_number, string field_id, string status, string comment", """
SELECT page_number, field_id, CASE WHEN verdict IN ('empty', 'pattern', 'short', 'long') THEN 'ERROR' WHEN verdict = 'low' AND status = 'OK' THEN 'WARNING' ELSE status END AS status,
  CASE verdict WHEN 'empty' THEN 'Required field empty' WHEN 'pattern' THEN 'Does not match pattern ' || CASE field_id WHEN 'log_number' THEN '^\\d{7}$' WHEN 'month' THEN '[A-Z]{3}' ELSE '\\d{2}' END
   WHEN 'short' THEN 'Length ' || length(value) || ' < minimum 2' WHEN 'long' THEN 'Length ' || length(value) || ' > maximum 2'
   WHEN 'low' THEN old_comment || ' | Low confidence (' || printf('%.2f', conf) || ')' ELSE old_comment END AS comment FROM ruled""", RULE_CTES)
def apply_field_rules(spark, folder):
    damaged = damaged_pages(spark, folder)
    pages = D.pages(spark, folder).drop("day", "month", "year").join(damaged, "page_number")
    readings = Q.to_readings(pages, list(FIELDS))
    return Q.apply_field_rules(readings, template_table(spark))


@register("validate_pages", "long page_number, string log_status, string month_status, string status", f"""
SELECT page_number, log_status, month_status, {status_sql('matricula', 'matricula_status')} AS status FROM pages""", PAGES)
def validate_pages(spark, folder):
    done = Q.validate_pages(D.pages(spark, folder), FIELDS, template_table(spark))
    return done.select("page_number", F.col("log_number.status").alias("log_status"), F.col("month.status").alias("month_status"), "status")


@register("unresolved_index_pages", "long page_number, string pending", """
SELECT page_number, concat_ws(',', CASE WHEN matricula IS NULL THEN 'matricula' END, CASE WHEN day IS NULL THEN 'day' END, CASE WHEN month IS NULL THEN 'month' END,
  CASE WHEN year IS NULL THEN 'year' END, CASE WHEN log IS NULL THEN 'log_number' END) AS pending FROM pages
WHERE NOT blank AND (matricula IS NULL OR day IS NULL OR month IS NULL OR year IS NULL OR log IS NULL)""", PAGES)
def unresolved_index_pages(spark, folder):
    return Q.unresolved_index_pages(D.pages(spark, folder)).withColumn("pending", F.array_join("pending", ","))


@register("review_pages", "long page_number, string file, long log_ord", "SELECT page_number, file, log_ord FROM pages WHERE NOT blank AND matricula IS NULL", PAGES)
def review_pages(spark, folder):
    return Q.review_pages(D.pages(spark, folder))


DISCREPANCIES = PAGES + "presence AS (SELECT *, " + ", ".join(
    f"CASE WHEN {f} = 'true' AND {f}_conf >= 0.45 THEN 1 WHEN {f} = 'false' AND {f}_conf >= 0.55 THEN 0 END AS {a}" for f, a in (
        ("pilot_signature", "pilot"), ("captain_signature", "cap"), ("captain_license", "lic"), ("technician_license", "tl"), ("technician_signature", "tech"))) + """ FROM pages WHERE NOT blank),
judged AS (SELECT *, CASE tl WHEN 1 THEN 'mantenimiento' WHEN 0 THEN 'vuelo' ELSE 'incierto' END AS kind, CASE WHEN tl = 1 THEN concat_ws(',',
    CASE WHEN pilot IS NULL THEN 'pilot_signature:u' WHEN pilot = 0 THEN 'pilot_signature:m' END, CASE WHEN tech IS NULL THEN 'technician_signature:u' WHEN tech = 0 THEN 'technician_signature:m' END,
    CASE WHEN cap IS NULL THEN 'captain_signature:u' WHEN cap = 1 THEN 'captain_signature:m' END, CASE WHEN lic IS NULL THEN 'captain_license:u' WHEN lic = 1 THEN 'captain_license:m' END)
  WHEN tl = 0 THEN concat_ws(',', CASE WHEN pilot IS NULL THEN 'pilot_signature:u' WHEN pilot = 0 THEN 'pilot_signature:m' END,
    CASE WHEN cap IS NULL THEN 'captain_signature:u' WHEN cap = 0 THEN 'captain_signature:m' END, CASE WHEN lic IS NULL THEN 'captain_license:u' WHEN lic = 0 THEN 'captain_license:m' END)
  ELSE concat_ws(',', 'technician_license:u', CASE WHEN pilot IS NULL THEN 'pilot_signature:u' WHEN pilot = 0 THEN 'pilot_signature:m' END) END AS findings FROM presence),
found AS (SELECT *, CASE WHEN contains(findings, ':m') THEN 'missing' ELSE 'uncertain' END AS category FROM judged WHERE findings <> ''),
"""


@register("classify_discrepancies", "long page_number, string registration, long log_no, string kind, string category, string findings",
          "SELECT page_number, matricula AS registration, log_no, kind, category, findings FROM found", DISCREPANCIES)
def classify_discrepancies(spark, folder):
    found = Q.classify_discrepancies(D.pages(spark, folder))
    short = F.transform("findings", lambda f: F.concat(f["field_id"], F.lit(":"), F.substring(f["category"], 1, 1)))
    return found.withColumn("findings", F.array_join(short, ","))


@register("sort_discrepancies", "long rank, long page_number", """
SELECT row_number() OVER (ORDER BY coalesce(log_no, 1073741824), file, page_number) AS rank, page_number FROM found""", DISCREPANCIES)
def sort_discrepancies(spark, folder):
    from foliant.operators.skew import positions
    found = Q.classify_discrepancies(D.pages(spark, folder))
    return positions(found.withColumn("_o", X.log_order(F.col("log_no"))), ["_o", "file", "page_number"], "rank")


@register("discrepancy_flags", "long page_number, boolean discrepancy",
          "SELECT page_number, k IN (SELECT k FROM found) AS discrepancy FROM pages", DISCREPANCIES)
def discrepancy_flags(spark, folder):
    return Q.discrepancy_flags(D.pages(spark, folder))


PAIRS = "('17','27','12','14','47','49','07','38','35','58','56','68','08','06','09')"
_DIGIT = " + ".join(
    f"CASE WHEN r[{i}] = c[{i}] THEN 0 WHEN least(r[{i}], c[{i}]) || greatest(r[{i}], c[{i}]) IN {PAIRS} THEN 6 ELSE 10 END" for i in (4, 5, 6, 7))
NEAREST = PAGES + FLEET + f"""
outside AS (SELECT DISTINCT matricula AS r FROM pages WHERE matricula IS NOT NULL AND matricula NOT IN (SELECT registration FROM fleet)),
priced AS (SELECT r, c, {_DIGIT} + CASE WHEN r[8:10] = c[8:10] THEN 0 ELSE 5 END AS cost FROM outside, (SELECT registration AS c FROM fleet)),
nearest AS (SELECT r, min(cost) AS cost, string_agg(c, ', ' ORDER BY c) AS tied, count(*) AS ties FROM (SELECT * FROM priced QUALIFY cost = min(cost) OVER (PARTITION BY r)) GROUP BY r),
"""


@register("nearest_fleet_match", "long page_number, string matricula, string method, string comment", """
SELECT page_number, CASE WHEN r IS NULL THEN matricula WHEN ties = 1 THEN tied END AS matricula,
  CASE WHEN r IS NOT NULL THEN CASE WHEN ties = 1 THEN 'fleet_nearest_match' ELSE 'fleet_unconfirmed' END END AS method,
  CASE matricula_status WHEN 'ERROR' THEN 'Required field empty' WHEN 'WARNING' THEN 'Low confidence (' || printf('%.2f', c1) || ')' ELSE 'OK' END ||
  CASE WHEN r IS NULL THEN '' WHEN ties = 1 THEN ' | Matrícula reclasificada de ' || r || ' a ' || tied || ': es la más parecida de la lista de flota'
    ELSE ' | Matrícula sin confirmar: ' || r || ' queda a la misma distancia de ' || tied END AS comment FROM pages LEFT JOIN nearest ON r = matricula""", NEAREST)
def nearest_fleet_match(spark, folder):
    matched = V.nearest_fleet_match(D.pages(spark, folder), D.fleet(spark, folder), FIELDS)
    return matched.select("page_number", F.col("matricula.value").alias("matricula"), F.col("matricula.inference_method").alias("method"), F.col("matricula.comment").alias("comment"))


@register("in_fleet", "long page_number, string registration", "SELECT page_number, matricula AS registration FROM pages WHERE matricula IN (SELECT registration FROM fleet)", PAGES + FLEET)
def in_fleet(spark, folder):
    pages = D.pages(spark, folder).select("page_number", F.col("matricula.value").alias("registration"))
    return V.membership(pages, D.fleet(spark, folder), inside=True)


@register("out_of_fleet", "long page_number, string registration", """
SELECT page_number, matricula AS registration FROM pages WHERE matricula IS NOT NULL AND matricula NOT IN (SELECT registration FROM fleet)""", PAGES + FLEET)
def out_of_fleet(spark, folder):
    pages = D.pages(spark, folder).select("page_number", F.col("matricula.value").alias("registration")).where("registration is not null")
    return V.membership(pages, D.fleet(spark, folder), inside=False)


@register("month_key", "long page_number, string month", f"SELECT page_number, replace({MONTH_KEY}, 'sf', 'sin_fecha') AS month FROM pages", PAGES)
def page_month_key(spark, folder):
    return D.pages(spark, folder).select("page_number", month_key().alias("month"))


@register("low_alignment", "long page_number, double pilot_conf, string pilot_status, string status", """
SELECT page_number, CASE WHEN alignment = 'low' THEN least(pilot_signature_conf, 0.4) ELSE pilot_signature_conf END AS pilot_conf,
  CASE WHEN alignment = 'low' THEN 'WARNING' ELSE 'OK' END AS pilot_status, CASE WHEN alignment = 'low' THEN 'WARNING' ELSE 'OK' END AS status FROM pages""", PAGES)
def low_alignment(spark, folder):
    marked = Q.mark_low_alignment(D.pages(spark, folder), FIELDS)
    return marked.select("page_number", F.col("pilot_signature.confidence").alias("pilot_conf"), F.col("pilot_signature.status").alias("pilot_status"), "status")
