"""Named text rules over readings made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.pages import FIELDS, template_table
from catalog.registry import register
from catalog.tables import FIELD_ROWS, FLEET, PAGES
from foliant.functions import dates as T
from foliant.functions import registrations as R
from foliant.functions import text as X
from foliant.operators import quality as Q
from foliant.plans import derived as D


def rule_rows(spark, folder, rule, cases):
    """One reading per page, its text chosen by the page number."""
    pages = D.pages(spark, folder)
    k = F.col("page_number") - 1
    chosen = F.element_at(F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cases]), (k % len(cases) + 1).cast("int"))
    return pages.select("page_number", chosen.alias("raw")).where("raw is not null").withColumn("r", X.RULES[rule](F.col("raw"))).select("page_number", "r.value", "r.note")


def number():
    return F.col("matricula")["value"].substr(4, 4)


COLUMNS = "long page_number, string value, string note"
N = "matricula[4:7]"


def sql_rows(cases: list[tuple[str, str, str]]) -> str:
    """(raw, value, note) expressions chosen by k modulo their number."""
    arms = " UNION ALL ".join(f"SELECT page_number, {v} AS value, {n} AS note FROM pages WHERE k % {len(cases)} = {i} AND ({r}) IS NOT NULL" for i, (r, v, n) in enumerate(cases))
    return arms


AMBIGUOUS = "'registration: handwritten characters read as digits'"
WEAK = "'registration: digits inferred from scattered OCR (low confidence)'"
WWP = f"CASE WHEN {N} IN ('1522', '1990') THEN 'WWP' ELSE 'CMP' END"
REG = f"'HP-' || {N} || {WWP}"
SWAPPED = f"translate({N}, '0156', 'OISG')"
REAL = f"length(regexp_replace({N}, '[0156]', '', 'g'))"
REGISTRATION_SQL = [
    (N, REG, "''"), (N, REG, "''"), (N, REG, "''"), (N, REG, "''"), (N, f"'HP-' || {N} || 'WWP'", "''"),
    (N, f"CASE WHEN {REAL} = 0 OR {REAL} = 1 THEN '' ELSE {REG} END", f"CASE {REAL} WHEN 4 THEN '' WHEN 0 THEN 'registration without 4-digit number' WHEN 1 THEN 'registration without 4-digit number' ELSE {AMBIGUOUS} END"),
    (N, REG, WEAK), (N, f"'HP-' || {N}[2:4] || '9CMP'", "''")]


@register("normalise_registration", COLUMNS, sql_rows(REGISTRATION_SQL), PAGES)
def normalise_registration(spark, folder):
    n = number()
    swapped = F.concat(F.lit("HP-"), F.translate(n, "0156", "OISG"), F.lit("CMP"))
    split = F.concat(F.lit("x"), n.substr(1, 1), F.lit("x"), n.substr(2, 1), F.lit("x"), n.substr(3, 2))
    return rule_rows(spark, folder, "matricula", [
        F.concat(F.lit("HP-"), n, F.lit("CMP")), n, F.concat(F.lit("hp"), n), F.concat(n, F.lit(" cmp")), F.concat(F.lit("hp-"), n, F.lit("-wwp")),
        swapped, split, F.concat(F.lit("HP"), n, F.lit("9CMP"))])


DAY = "CAST(day_n AS VARCHAR)"
DAY_SQL = [
    ("day", "day", "''"), ("day", "day", "''"), ("day", "'2' || day[2]", "''"), ("day", "''", "'invalid day: 9' || day || '7'"), ("day", "''", "'invalid day: DATE'"),
    ("day", "day", "''")]


@register("normalise_day", COLUMNS, sql_rows(DAY_SQL), PAGES)
def normalise_day(spark, folder):
    d = F.col("day")["value"]
    return rule_rows(spark, folder, "day", [d, F.concat(d.substr(1, 1), F.lit(" "), d.substr(2, 1)), F.concat(F.lit("Z"), d.substr(2, 1)),
                                            F.concat(F.lit("9"), d, F.lit("7")), F.when(d.isNotNull(), F.lit("DATE")), F.concat(F.lit("DAY "), d, F.lit(" 0"))])


MONTH_SQL = [
    ("month", "month", "''"), ("month", "CASE WHEN month = 'DIC' THEN '' ELSE month END", "CASE WHEN month = 'DIC' THEN 'invalid month: dic month' ELSE '' END"), ("month", "CAST(month_n AS VARCHAR)", "'numeric handwritten month: ' || CAST(month_n AS VARCHAR)"),
    ("month", "month", "''"), ("month", "''", "'invalid month: 13'"), ("month", "''", "'invalid month: 50c'"), ("month", "month", "''")]


@register("normalise_month", COLUMNS, sql_rows(MONTH_SQL), PAGES)
def normalise_month(spark, folder):
    m = F.col("month")["value"]
    known = m.isNotNull()
    return rule_rows(spark, folder, "month", [m, F.concat(F.lower(m), F.lit(" month")), T.month_number(m).cast("string"), F.translate(m, "LOSB", "1058"),
                                              F.when(known, F.lit("13")), F.when(known, F.lit("50c")), F.concat(m.substr(1, 2), F.lit("-"), m.substr(3, 1))])


LETTERS = "['A','B','C','D','E','F','G','H','I','J','K','L','M','N','O','P','Q','R','S','T','U','V','W','X','Y','Z']"
WORDS = "[('ENE',1),('JAN',1),('FEB',2),('MAR',3),('ABR',4),('APR',4),('MAY',5),('JUN',6),('JUL',7),('AGO',8),('AUG',8),('SEP',9),('OCT',10),('NOV',11),('DIC',12),('DEC',12)]"
# Every third letter of the alphabet typed into one position of a month: the closest word decides.
FUZZY = PAGES + f"""
typed AS (SELECT page_number, CASE k % 3 WHEN 0 THEN l || month[2:3] WHEN 1 THEN month[1] || l || month[3] ELSE month || l END AS raw
  FROM (SELECT *, {LETTERS}[k % 26 + 1] AS l FROM pages WHERE month IS NOT NULL)),
letters AS (SELECT *, replace(raw, 'I', 'L') AS t FROM typed),
scored AS (SELECT raw, t, w[1] AS word, w[2] AS num, levenshtein(t, w[1]) AS d, CAST(t[1] = w[1][1] AS INT) + CAST(t[2] = w[1][2] AS INT) + CAST(t[3] = w[1][3] AS INT) AS same,
   regexp_matches(t, w[1][1] || '.*' || w[1][2] || '|' || w[1][1] || '.*' || w[1][3] || '|' || w[1][2] || '.*' || w[1][3]) AS pair, contains(t, w[1]) AS inside
   FROM (SELECT DISTINCT raw, t FROM letters), (SELECT unnest(list_transform({WORDS}, lambda x: [x[1], CAST(x[2] AS VARCHAR)])) AS w0), LATERAL (SELECT [w0[1], w0[2]] AS w)),
decided AS (SELECT raw, any_value(t) AS t, coalesce(min(CAST(num AS INT)) FILTER (inside), CASE WHEN count(*) FILTER (d < 2 AND same >= 2) > 0
    THEN -(min((d, -CAST(num AS INT))) FILTER (d < 2 AND same >= 2))[2] ELSE -(min((d, -CAST(num AS INT))) FILTER (d < 3 AND pair))[2] END) AS m FROM scored GROUP BY raw),
"""


@register("normalise_month_fuzzy", COLUMNS, """
SELECT page_number, coalesce(['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEP','OCT','NOV','DIC'][m], '') AS value, CASE WHEN m IS NULL THEN 'invalid month: ' || raw
  WHEN length(raw) = 3 OR regexp_matches(raw, 'ENE|JAN|FEB|MAR|ABR|APR|MAY|JUN|JUL|AGO|AUG|SEP|OCT|NOV|DIC|DEC') THEN '' ELSE 'month fuzzy: ' || raw END AS note FROM typed JOIN decided USING (raw)""", FUZZY)
def normalise_month_fuzzy(spark, folder):
    k, m = F.col("page_number") - 1, F.col("month")["value"]
    letter = F.char(F.lit(65) + k % 26)
    typed = F.when(k % 3 == 0, F.concat(letter, m.substr(2, 2))).when(k % 3 == 1, F.concat(m.substr(1, 1), letter, m.substr(3, 1))).otherwise(F.concat(m, letter))
    return (D.pages(spark, folder).select("page_number", typed.alias("raw")).where("raw is not null")
            .withColumn("r", X.month(F.col("raw"))).select("page_number", "r.value", "r.note"))


YEAR_SQL = [("year", "year", "''"), ("year", "year", "''"), ("year", "year", "''"), ("year", "'20' || year", "''"), ("year", "'9' || year", "'invalid year: 9' || year"),
            ("year", "''", "'invalid year: 83' || year"), ("year", "''", "'invalid year: year'")]


@register("normalise_year", COLUMNS, sql_rows(YEAR_SQL), PAGES)
def normalise_year(spark, folder):
    y = F.col("year")["value"]
    return rule_rows(spark, folder, "year", [F.concat(F.lit("Year YR "), y), F.concat(F.lit("Z"), y.substr(2, 1)), F.concat(y.substr(1, 1), F.lit(" "), y.substr(2, 1)),
                                             F.concat(F.lit("2 0 "), y.substr(1, 1), F.lit(" "), y.substr(2, 1)), F.concat(F.lit("9"), y), F.concat(F.lit("83"), y),
                                             F.when(y.isNotNull(), F.lit("year"))])


DATE = "'20' || year || '/' || lpad(CAST(month_n AS VARCHAR), 2, '0') || '/' || day"
OK_DAY = "day_n <= day(last_day(make_date(2000 + year_n, month_n, 1)))"
WHOLE = "day || month || year"
DATE_SQL = [(WHOLE, f"CASE WHEN {OK_DAY} THEN {DATE} ELSE day || ' ' || month || ' ' || year END", f"CASE WHEN {OK_DAY} THEN '' ELSE 'invalid date: ' || day || ' ' || month || ' ' || year END"),
            (WHOLE, f"CASE WHEN {OK_DAY} THEN {DATE} ELSE day || month || year END", f"CASE WHEN {OK_DAY} THEN '' ELSE 'invalid date: ' || day || month || year END"),
            (WHOLE, f"CASE WHEN {OK_DAY} THEN {DATE} ELSE '' END", f"CASE WHEN {OK_DAY} THEN '' ELSE 'invalid date: ' || day || '/' || month_n::VARCHAR || '/' || year END"),
            (WHOLE, "''", "'unrecognized date: ' || month")]


@register("normalise_date", COLUMNS, sql_rows(DATE_SQL), PAGES)
def normalise_date(spark, folder):
    d, m, y = (F.col(f)["value"] for f in ("day", "month", "year"))
    whole = F.concat(d, m, y)
    return rule_rows(spark, folder, "date", [F.concat(d, F.lit(" "), m, F.lit(" "), y), whole,
                                             F.concat(d, F.lit("/"), T.month_number(m).cast("string"), F.lit("/"), y), F.when(whole.isNotNull(), m)])


@register("normalise_digits", COLUMNS, """
SELECT doc_id AS page_number, CASE WHEN regexp_replace(text, '[^0-9]', '', 'g') <> '' THEN regexp_replace(text, '[^0-9]', '', 'g') ELSE text END AS value,
  CASE WHEN regexp_matches(text, '[0-9]') THEN '' ELSE 'no digits' END AS note FROM documents""")
def normalise_digits(spark, folder):
    docs = D.table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("page_number"), X.digits(F.col("text")).alias("r")).select("page_number", "r.value", "r.note")


@register("normalise_char", COLUMNS, r"""
SELECT doc_id AS page_number, CASE WHEN t = '' THEN '' WHEN regexp_full_match(upper(t[1]), '[A-Z0-9]') THEN upper(t[1]) ELSE '' END AS value,
  CASE WHEN t = '' THEN 'empty char cell' WHEN regexp_full_match(upper(t[1]), '[A-Z0-9]') THEN '' ELSE 'invalid char: ' || text END AS note FROM (SELECT *, trim(text) AS t FROM documents)""")
def normalise_char(spark, folder):
    docs = D.table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("page_number"), X.char(F.col("text")).alias("r")).select("page_number", "r.value", "r.note")


NOTE = "'flight number matched against the logbook vocabulary'"
CODES = "['TCK','CCK','SPV','SVC','SUP','MTC','SV']"
CODE = f"{CODES}[(k // 11) % 7 + 1]"
FLIGHT = "CAST(100 + (k * 7) % 900 AS VARCHAR)"
# Numbers with a real digit left after the letters are typed for 1, 0 and 5.
TYPED = f"translate({FLIGHT}, '105', 'LOS')"
FLIGHT_SQL = [
    (CODE, CODE, "''"), (CODE, f"{CODE} || '3'", "''"), (CODE, CODE, NOTE), (CODE, FLIGHT, "''"), (CODE, f"'CM' || {FLIGHT}", "''"), (CODE, f"'A' || {FLIGHT}", "''"),
    (CODE, f"'CM' || {FLIGHT}", f"CASE WHEN {TYPED} = {FLIGHT} THEN '' ELSE {NOTE} END"), (CODE, "''", "'invalid flight number: 000'"), (CODE, "''", "'empty flight number'"), (CODE, "''", f"'invalid flight number: 9' || {FLIGHT} || '7'"),
    (CODE, f"CASE WHEN {CODE} = 'TCK' THEN 'TCK' ELSE {CODE} END", NOTE)]


@register("normalise_flight_number", COLUMNS, sql_rows(FLIGHT_SQL), PAGES)
def normalise_flight_number(spark, folder):
    k = F.col("page_number") - 1
    code = F.element_at(F.array(*[F.lit(c) for c in ("TCK", "CCK", "SPV", "SVC", "SUP", "MTC", "SV")]), (F.floor(k / 11) % 7 + 1).cast("int"))
    flight = (100 + (k * 7) % 900).cast("string")
    return rule_rows(spark, folder, "flight_number", [
        code, F.concat(code, F.lit("3")), F.concat(code, F.lit(" visit")), F.concat(F.lit("FLT NO "), flight), F.concat(F.lit("cm"), flight), F.concat(F.lit("A"), flight),
        F.concat(F.lit("CM"), F.translate(flight, "105", "LOS")), "000", " - ", F.concat(F.lit("9"), flight, F.lit("7")), F.concat(F.lit("x"), code)])


@register("normalise_readings", "long page_number, string field_id, string rule_value, string rule_note", f"""
SELECT page_number, 'log_number' AS field_id, log AS rule_value, '' AS rule_note FROM pages WHERE log IS NOT NULL
UNION ALL SELECT page_number, 'matricula', CASE WHEN k % 10 = 8 AND length(n) - length(replace(n, '1', '')) >= 3 THEN '' ELSE matricula END,
  CASE WHEN k % 10 = 9 THEN {WEAK} WHEN k % 10 = 8 THEN CASE length(n) - length(replace(n, '1', '')) WHEN 0 THEN '' WHEN 1 THEN {AMBIGUOUS} WHEN 2 THEN {AMBIGUOUS}
   ELSE 'registration without 4-digit number' END ELSE '' END FROM pages WHERE matricula IS NOT NULL
UNION ALL SELECT page_number, 'day', day, '' FROM pages WHERE day IS NOT NULL UNION ALL SELECT page_number, 'month', month, '' FROM pages WHERE month IS NOT NULL
UNION ALL SELECT page_number, 'year', year, '' FROM pages WHERE year IS NOT NULL""", PAGES)
def normalise_readings(spark, folder):
    readings = Q.to_readings(D.pages(spark, folder), ["log_number", "matricula", "day", "month", "year"]).where("raw_value is not null")
    return Q.normalise_readings(readings, template_table(spark))


SOFT = ("registration: digits inferred from scattered OCR (low confidence)", "registration: handwritten characters read as digits",
        "flight number matched against the logbook vocabulary")


@register("accept_primary_reading", "long page_number, string field_id, boolean accepted", """
SELECT page_number, 'matricula' AS field_id, matricula IS NOT NULL AND NOT (k % 10 = 8 AND length(n) - length(replace(n, '1', '')) >= 3) AS accepted FROM pages
UNION ALL SELECT page_number, field_id, value IS NOT NULL FROM pages, """ + FIELD_ROWS + " WHERE field_id <> 'matricula'", PAGES)
def accept_primary_reading(spark, folder):
    readings = Q.to_readings(D.pages(spark, folder), list(FIELDS), ["raw_value"])
    template = template_table(spark)
    return Q.accept_primary_reading(Q.normalise_readings(readings, template), template, SOFT)


@register("choose_slot_candidate", "long page_number, boolean accepted", """
SELECT page_number, CASE WHEN day_alt IS NOT NULL THEN c3 >= 0.35 ELSE k % 4 = 1 AND c3 >= 0.25 END AS accepted FROM (SELECT * FROM pages WHERE day IS NOT NULL)""", PAGES)
def choose_slot_candidate(spark, folder):
    k, day = F.col("page_number") - 1, F.col("day")
    slot = F.coalesce(F.get(day["alternatives"], F.lit(0)), F.when(k % 4 == 1, day["value"]), F.lit(""))
    chosen = Q.choose_slot_candidate(F.lit("day"), day["value"], day["confidence"], slot, F.col("month")["confidence"])
    return D.pages(spark, folder).where("day.value is not null").select("page_number", chosen.alias("accepted"))


@register("date_parts", "long page_number, long day, long month, long year", """
SELECT page_number, day_n AS day, month_n AS month, year_n AS year FROM pages""", PAGES)
def date_parts(spark, folder):
    return D.pages(spark, folder).select("page_number", T.day_number(F.col("day")["value"]).alias("day"), T.month_number(F.col("month")["value"]).alias("month"),
                                         T.year_number(F.col("year")["value"]).alias("year"))


@register("combine_date", "long page_number, string date", f"SELECT page_number, CASE WHEN {OK_DAY} THEN {DATE} END AS date FROM pages", PAGES)
def combine_date(spark, folder):
    return D.pages(spark, folder).select("page_number", T.page_date().alias("date"))


@register("fleet_list", "string registration", "SELECT DISTINCT registration FROM fleet", PAGES + FLEET)
def fleet_list(spark, folder):
    from foliant.operators.fleet import fleet_list as listed
    number = F.substring("registration", 4, 4)
    k = F.col("number").cast("int") % 5
    typed = (F.when(k == 0, F.col("number")).when(k == 1, F.concat(F.lit("hp"), "number", F.lit("cmp"))).when(k == 2, F.concat(F.lit(" HP-"), "number", F.lit(" CMP ")))
             .when(k == 3, F.concat(F.lit("HP-"), "number", F.lit("CMP"))).otherwise(F.concat(F.lit("hp-"), "number", F.lit("cmp"))))
    raw = D.fleet(spark, folder).select(number.alias("number")).select(typed.alias("value"))
    return listed(raw.unionByName(raw.select(F.concat(F.lit("x"), "value").alias("value"))))


@register("index_normalise", "long page_number, string registration, string log_number, string date", """
SELECT page_number, coalesce(matricula, '') AS registration, coalesce(log, '') AS log_number,
  CASE WHEN month IS NULL OR year IS NULL OR day IS NULL THEN '' ELSE lpad(CAST(month_n AS VARCHAR), 2, '0') || '/' || day || '/20' || year END AS date FROM pages""", PAGES)
def index_normalise(spark, folder):
    date = T.date_text(T.year_number(F.col("year")["value"]) + 2000, T.month_number(F.col("month")["value"]), T.day_number(F.col("day")["value"]))
    spaced = F.concat(F.lit(" "), F.lower(F.col("matricula")["value"]), F.lit(" "))
    return D.pages(spark, folder).select("page_number", R.index_registration(spaced).alias("registration"),
                                         R.index_log_number(F.concat(F.lit("No. "), F.col("log_number")["value"])).alias("log_number"), T.remote_date(date).alias("date"))


@register("comparable_names", "string name, string comparable, string base", r"""
SELECT c_name || ' | Bit&#225;coras &amp; - ana@x' AS name, trim(regexp_replace(lower(c_name || ' | Bit' || chr(225) || 'coras & - ana@x'), '[\s_|\-]+', ' ', 'g')) AS comparable,
  c_name || ' | Bit&#225;coras &amp;' AS base FROM customer""")
def comparable_names(spark, folder):
    name = F.concat("c_name", F.lit(" | Bit&#225;coras &amp; - ana@x"))
    return D.table(spark, folder, "customer").select(name.alias("name"), X.comparable_name(name).alias("comparable"), X.base_name(name).alias("base"))
