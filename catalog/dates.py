"""Date inference, step by step, over the derived books."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.pages import FIELDS, status_sql
from catalog.registry import register
from catalog.tables import MONTHS, PAGES
from foliant.functions import dates as T
from foliant.operators import dates as S
from foliant.operators.books import with_books
from foliant.plans import correction as C
from foliant.plans import derived as D


def books(spark, folder):
    return with_books(D.pages(spark, folder))


def reading(field):
    col = F.col(field)
    return [col["value"].alias("value"), col["status"].alias("status"), col["confidence"].alias("confidence"),
            F.coalesce(col["inference_method"], F.lit("")).alias("method"), F.coalesce(col["comment"], F.lit("")).alias("comment")]


COLUMNS = "long page_number, string value, string status, double confidence, string method, string comment"
OLD = "CASE {s} WHEN 'ERROR' THEN 'Required field empty' WHEN 'WARNING' THEN 'Low confidence (' || printf('%.2f', {c}) || ')' ELSE 'OK' END"
CONF = "round_even(round(least(0.9, greatest(0.6, 0.64 + least({n}, 5) * 0.05 - CASE WHEN {span} > 0 THEN least(0.1, {span} * 0.005) ELSE 0 END)), 9), 3)"


def component(field: str) -> dict[str, str]:
    """Names of a component's SQL columns."""
    conf = {"month": "c3", "year": "c4"}[field]
    text = f"{MONTHS}[{{v}}]" if field == "month" else "lpad(CAST({v} AS VARCHAR), 2, '0')"
    return {"f": field, "n": f"{field}_n", "c": conf, "s": f"{field}_status", "text": text, "old": OLD.format(s=f"{field}_status", c=conf)}


def anchor_sql(field: str) -> str:
    """Direct readings that may be propagated; the derived readings carry no alternatives or notes on these parts."""
    x = component(field)
    return (f"anchors AS (SELECT k, book, log_no, page_number, file_seq, {x['n']} AS v FROM pages WHERE log_no IS NOT NULL AND alignment = 'ok' "
            f"AND {x['n']} IS NOT NULL AND {x['c']} >= 0.5),\n")


@register("date_anchors", "long page_number, boolean day, boolean month, boolean year", """
SELECT page_number, coalesce(log_no IS NOT NULL AND alignment = 'ok' AND day IS NOT NULL AND day_alt IS NULL AND c2 >= 0.5, false) AS day,
  coalesce(log_no IS NOT NULL AND alignment = 'ok' AND month IS NOT NULL AND c3 >= 0.5, false) AS month,
  coalesce(log_no IS NOT NULL AND alignment = 'ok' AND year IS NOT NULL AND c4 >= 0.5, false) AS year FROM pages""", PAGES)
def date_anchors(spark, folder):
    parts = S.with_parts(with_books(D.pages(spark, folder)))
    return parts.select("page_number", *[S.is_anchor(f).alias(f) for f in ("day", "month", "year")])


YEARS = PAGES + """
observed AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY log_no, page_number, file_seq) AS pos FROM pages WHERE log_no IS NOT NULL AND NOT blank AND year_n IS NOT NULL),
per_year AS (SELECT book, year_n, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM observed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, year_n) AS r, lead(n, 1, 0) OVER (PARTITION BY book ORDER BY n DESC, year_n) AS runner, sum(n) OVER (PARTITION BY book) AS total FROM per_year),
majority AS (SELECT * FROM ranked WHERE r = 1 AND total >= 3 AND n >= 2 AND n > runner AND n / total >= 0.6),
fixes AS (SELECT o.k, m.year_n AS maj, m.n, m.total FROM observed o JOIN majority m ON m.book = o.book
  WHERE o.year_n <> m.year_n AND NOT (o.year_n - m.year_n = -1 AND o.pos < m.first_pos) AND NOT (o.year_n - m.year_n = 1 AND o.pos > m.last_pos)),
"""


@register("year_consensus", COLUMNS, f"""
SELECT page_number, CASE WHEN maj IS NULL THEN year ELSE lpad(CAST(maj AS VARCHAR), 2, '0') END AS value, CASE WHEN maj IS NULL THEN year_status ELSE 'WARNING' END AS status,
  CASE WHEN maj IS NULL THEN c4 ELSE round_even(round(least(0.95, 0.55 + x.n / total * 0.4), 9), 3) END AS confidence,
  CASE WHEN maj IS NULL THEN '' ELSE 'log_number_year_consensus' END AS method,
  CASE WHEN maj IS NULL THEN {OLD.format(s='year_status', c='c4')} ELSE 'Year corrected by book majority (' || CAST(x.n AS VARCHAR) || '/' || CAST(total AS VARCHAR) || '): ''' || year || ''' -> ''' || lpad(CAST(maj AS VARCHAR), 2, '0') || '''' END AS comment
FROM pages LEFT JOIN fixes x USING (k)""", YEARS)
def year_consensus(spark, folder):
    return S.year_consensus(books(spark, folder)).select("page_number", *reading("year"))


def between_sql(field: str) -> tuple[str, str]:
    x = component(field)
    ctes = PAGES + anchor_sql(field) + """
levels AS (SELECT DISTINCT book, log_no FROM pages WHERE log_no IS NOT NULL),
lefts AS (SELECT l.book, l.log_no, max((a.log_no, a.page_number, a.file_seq, a.v)) AS a FROM levels l JOIN anchors a ON a.book = l.book AND a.log_no < l.log_no GROUP BY ALL),
rights AS (SELECT l.book, l.log_no, min((a.log_no, a.page_number, a.file_seq, a.v)) AS a FROM levels l JOIN anchors a ON a.book = l.book AND a.log_no > l.log_no GROUP BY ALL),
same AS (SELECT book, log_no, v, count(*) AS n FROM anchors GROUP BY ALL),
""" + f"""
spans AS (SELECT p.k, l.a[4] AS v, l.a[1] AS l_no, r.a[1] AS r_no, (SELECT coalesce(sum(n), 0) FROM same s WHERE s.book = p.book AND s.log_no = p.log_no) - CAST(a.k IS NOT NULL AS INT) AS others,
   (SELECT coalesce(sum(n), 0) FROM same s WHERE s.book = p.book AND s.log_no = p.log_no AND s.v <> l.a[4]) - CAST(a.k IS NOT NULL AND a.v <> l.a[4] AS INT) AS contrary
   FROM pages p JOIN lefts l ON l.book = p.book AND l.log_no = p.log_no JOIN rights r ON r.book = p.book AND r.log_no = p.log_no LEFT JOIN anchors a ON a.k = p.k
   WHERE p.alignment = 'ok' AND l.a[4] = r.a[4]),
acts AS (SELECT p.*, v, l_no, r_no, others, CAST(l_no AS VARCHAR) || ', ' || CASE WHEN others > 0 THEN CAST(p.log_no AS VARCHAR) || ', ' ELSE '' END || CAST(r_no AS VARCHAR) AS numbers,
   CASE WHEN v IS NULL OR contrary > 0 THEN '' WHEN {x['n']} IS NULL THEN 'fill' WHEN {x['n']} <> v THEN 'flag' ELSE '' END AS act FROM pages p LEFT JOIN spans s USING (k)),
"""
    text = x["text"].format(v="v")
    sql = f"""SELECT page_number, CASE WHEN act = 'fill' THEN {text} ELSE {field} END AS value, CASE WHEN act <> '' THEN 'WARNING' ELSE {x['s']} END AS status,
  CASE WHEN act = 'fill' THEN {CONF.format(n='(others + 2)', span='(r_no - l_no)')} ELSE {x['c']} END AS confidence,
  CASE act WHEN 'fill' THEN 'log_number_interval' WHEN 'flag' THEN 'log_number_interval_conflict' ELSE '' END AS method,
  CASE act WHEN 'fill' THEN 'Inferred {field} from log_number anchors ' || numbers || ': ' || {text}
   WHEN 'flag' THEN {x['old']} || ' | Conflicts with {field} interval ' || {text} || ' (log_number anchors ' || numbers || ')' ELSE {x['old']} END AS comment FROM acts"""
    return ctes, sql


def edges_sql(field: str) -> tuple[str, str]:
    x = component(field)
    ctes = PAGES + anchor_sql(field) + """
ends AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY log_no, page_number, file_seq) AS a, row_number() OVER (PARTITION BY book ORDER BY log_no DESC, page_number DESC, file_seq DESC) AS z FROM anchors),
edges AS (SELECT book, max(v) FILTER (a = 1) AS v1, max(v) FILTER (a = 2) AS v2, max(log_no) FILTER (a = 1) AS n1, max(log_no) FILTER (a = 2) AS n2,
  max(v) FILTER (z = 1) AS w1, max(v) FILTER (z = 2) AS w2, max(log_no) FILTER (z = 1) AS m1, max(log_no) FILTER (z = 2) AS m2 FROM ends GROUP BY book),
""" + f"""
acts AS (SELECT p.*, CASE WHEN {x['n']} IS NULL AND alignment = 'ok' THEN CASE WHEN v1 = v2 AND log_no < n1 AND n1 - log_no <= 10 THEN 'first' WHEN w1 = w2 AND log_no > m1 AND log_no - m1 <= 10 THEN 'last' END END AS act,
   v1, w1, n1, n2, m1, m2 FROM pages p LEFT JOIN edges USING (book)),
filled AS (SELECT *, CASE act WHEN 'first' THEN v1 ELSE w1 END AS v, CASE act WHEN 'first' THEN n1 ELSE m2 END AS lo, CASE act WHEN 'first' THEN n2 ELSE m1 END AS hi FROM acts),
"""
    text = x["text"].format(v="v")
    sql = f"""SELECT page_number, CASE WHEN act IS NULL THEN {field} ELSE {text} END AS value, CASE WHEN act IS NULL THEN {x['s']} ELSE 'WARNING' END AS status,
  CASE WHEN act IS NULL THEN {x['c']} ELSE {CONF.format(n='2', span='(hi - lo)')} END AS confidence, CASE WHEN act IS NULL THEN '' ELSE 'log_number_local_consensus' END AS method,
  CASE WHEN act IS NULL THEN {x['old']} ELSE 'Inferred {field} from log_number anchors ' || CAST(lo AS VARCHAR) || ', ' || CAST(hi AS VARCHAR) || ': ' || {text} END AS comment FROM filled"""
    return ctes, sql


def consensus_sql(field: str) -> tuple[str, str]:
    x = component(field)
    ctes = PAGES + anchor_sql(field) + f"""
agreed AS (SELECT book, min(v) AS v, count(*) AS anchors_n, min(log_no) AS lo, max(log_no) AS hi, string_agg(DISTINCT CAST(log_no AS VARCHAR), ', ' ORDER BY CAST(log_no AS VARCHAR)) AS numbers
  FROM anchors GROUP BY book HAVING count(*) >= 2 AND min(v) = max(v)),
acts AS (SELECT p.*, a.v, anchors_n, lo, hi, numbers, a.v IS NOT NULL AND NOT blank AND {x['n']} IS NULL AS act FROM pages p LEFT JOIN agreed a USING (book)),
"""
    text = x["text"].format(v="v")
    sql = f"""SELECT page_number, CASE WHEN act THEN {text} ELSE {field} END AS value, CASE WHEN act THEN 'WARNING' ELSE {x['s']} END AS status,
  CASE WHEN act THEN {CONF.format(n='anchors_n', span='(hi - lo)')} ELSE {x['c']} END AS confidence, CASE WHEN act THEN 'book_consensus' ELSE '' END AS method,
  CASE WHEN act THEN 'Inferred {field} from log_number anchors ' || numbers || ': ' || {text} ELSE {x['old']} END AS comment FROM acts"""
    return ctes, sql


def _register_components():
    for field in ("year", "month"):
        ctes, sql = between_sql(field)

        @register(f"infer_between_anchors_{field}", COLUMNS, sql, ctes)
        def between(spark, folder, field=field):
            return S.infer_between_anchors(books(spark, folder), field).select("page_number", *reading(field))

        ctes, sql = edges_sql(field)

        @register(f"infer_edges_{field}", COLUMNS, sql, ctes)
        def edges(spark, folder, field=field):
            return S.infer_edges(books(spark, folder), field).select("page_number", *reading(field))

        ctes, sql = consensus_sql(field)

        @register(f"fill_book_consensus_{field}", COLUMNS, sql, ctes)
        def consensus(spark, folder, field=field):
            return S.fill_book_consensus(books(spark, folder), field).select("page_number", *reading(field))


_register_components()


@register("inferred_confidence", "long book_pages, string book, double confidence", f"""
SELECT book, count(*) AS book_pages, {CONF.format(n='count(*)', span='coalesce(max(log_no) - min(log_no), 0)')} AS confidence FROM pages GROUP BY book""", PAGES)
def inferred_confidence(spark, folder):
    books = with_books(D.pages(spark, folder)).groupBy("book").agg(F.count("*").alias("book_pages"), F.coalesce(F.max("log_no") - F.min("log_no"), F.lit(0)).alias("span"))
    return books.withColumn("confidence", S.inferred_confidence(F.col("book_pages"), F.col("span")))


# The missing day, page by page in order: the sequential rule as a recursive query.
DAYS = PAGES + """
takes AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY log_ord, page_number, file_seq) AS pos, year_n * 12 + month_n AS ym,
  day(last_day(make_date(2000 + year_n, month_n, 1))) AS month_end FROM pages WHERE NOT blank AND month_n IS NOT NULL AND year_n IS NOT NULL),
ahead AS (SELECT *, first_value(CASE WHEN day_n IS NOT NULL THEN (ym, day_n) END IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM takes),
walk AS (SELECT book, pos, k, ym, CASE WHEN day_n IS NOT NULL THEN day_n ELSE least(month_end, CASE WHEN nxt[1] = ym THEN nxt[2] ELSE month_end END) END AS day FROM ahead WHERE pos = 1
  UNION ALL SELECT a.book, a.pos, a.k, a.ym, CASE WHEN a.day_n IS NOT NULL THEN a.day_n
    ELSE greatest(least(a.month_end, CASE WHEN a.nxt[1] = a.ym THEN a.nxt[2] ELSE a.month_end END), CASE WHEN w.ym = a.ym THEN w.day ELSE 1 END) END FROM walk w JOIN ahead a ON a.book = w.book AND a.pos = w.pos + 1),
"""


@register("fill_missing_day", "long page_number, string day, string method", """
SELECT page_number, CASE WHEN p.day IS NULL AND w.day IS NOT NULL THEN lpad(CAST(w.day AS VARCHAR), 2, '0') ELSE p.day END AS day,
  CASE WHEN p.day IS NULL AND w.day IS NOT NULL THEN 'month_end_fallback' ELSE '' END AS method FROM pages p LEFT JOIN walk w USING (k)""", DAYS, recursive=True)
def fill_missing_day(spark, folder):
    return S.fill_missing_day(books(spark, folder)).select("page_number", F.col("day.value").alias("day"), F.coalesce(F.col("day.inference_method"), F.lit("")).alias("method"))


DATED = PAGES + """
dated AS (SELECT *, CASE WHEN day_n <= day(last_day(make_date(2000 + year_n, month_n, 1))) THEN make_date(2000 + year_n, month_n, day_n) END AS date FROM pages),
"""


@register("check_regressions", "long page_number, boolean regression", """
SELECT page_number, coalesce(date < lag(date) OVER (PARTITION BY book ORDER BY log_no, page_number, file_seq), false) AS regression FROM dated WHERE log_no IS NOT NULL AND date IS NOT NULL
UNION ALL SELECT page_number, false FROM dated WHERE log_no IS NULL OR date IS NULL""", DATED)
def check_regressions(spark, folder):
    return S.check_regressions(books(spark, folder)).select("page_number", (F.col("regressions") == 1).alias("regression"))


@register("flag_unresolved", "long page_number, boolean unresolved, string day_comment, string month_comment, string year_comment", f"""
SELECT page_number, NOT blank AND date IS NULL AS unresolved, CASE WHEN NOT blank AND date IS NULL AND day IS NULL THEN 'Day unresolved; date left incomplete' ELSE {OLD.format(s='day_status', c='c2')} END AS day_comment,
  CASE WHEN NOT blank AND date IS NULL AND month IS NULL THEN 'Month unresolved after log_number inference' ELSE {OLD.format(s='month_status', c='c3')} END AS month_comment,
  CASE WHEN blank OR date IS NOT NULL THEN {OLD.format(s='year_status', c='c4')} WHEN year IS NULL THEN 'Year unresolved after log_number inference'
   WHEN day IS NOT NULL AND month IS NOT NULL THEN 'Date is not a valid calendar date' ELSE {OLD.format(s='year_status', c='c4')} END AS year_comment FROM dated""", DATED)
def flag_unresolved(spark, folder):
    flagged = S.flag_unresolved(S.recombine(S.with_parts(books(spark, folder))))
    return flagged.select("page_number", (F.col("unresolved") == 1).alias("unresolved"), *[F.col(f)["comment"].alias(f + "_comment") for f in ("day", "month", "year")])


def valid(day: str, month: str, year: str) -> str:
    return f"CASE WHEN {day} <= day(last_day(make_date(2000 + {year}, {month}, 1))) THEN make_date(2000 + {year}, {month}, {day}) END"


def sequence_sql(corrected_years: bool) -> str:
    """The choice of readings as a shortest path over (book, place, option): costs compared in order, ties to the earlier option.

    Leaves ``s1``: pages with the chosen day and year; months have one reading, years a second one where the majority moved them."""
    start = ("s0 AS (SELECT p.*, coalesce(f.maj, year_n) AS y1, f.maj IS NOT NULL AS yfix FROM pages p LEFT JOIN fixes f USING (k)),"
             if corrected_years else "s0 AS (SELECT *, year_n AS y1, false AS yfix FROM pages),")
    return (YEARS if corrected_years else PAGES) + start + f"""
options AS (SELECT k, book, log_no, page_number, file_seq, d.i * 2 + y.i AS i, dd, yy, CAST(dd <> day_n AS INT) + CAST(yy <> y1 AS INT) AS changes, {valid('dd', 'month_n', 'yy')} AS date
  FROM s0, LATERAL (VALUES (0, day_n), (1, CAST(day_alt AS BIGINT))) d(i, dd), LATERAL (VALUES (0, y1), (1, CASE WHEN yfix THEN year_n END)) y(i, yy)
  WHERE log_no IS NOT NULL AND dd IS NOT NULL AND month_n IS NOT NULL AND yy IS NOT NULL),
line AS (SELECT * REPLACE (date - DATE '1970-01-01' AS date), dense_rank() OVER (PARTITION BY book ORDER BY log_no, page_number, file_seq) AS pos FROM options WHERE date IS NOT NULL),
read_first AS (SELECT book, pos, arg_min(date, i) AS date FROM line GROUP BY ALL),
turns AS (SELECT book, count(*) FILTER (date < before) AS backward FROM (SELECT book, date, lag(date) OVER (PARTITION BY book ORDER BY pos) AS before FROM read_first) GROUP BY book),
route AS (SELECT book, pos, i, date, 0 AS back, changes, CAST(0 AS BIGINT) AS jumps, CAST(-1 AS INT) AS came FROM line WHERE pos = 1
  UNION ALL SELECT book, pos, i, date, b[1], b[2], b[3], b[4] FROM (
    SELECT c.book, c.pos, c.i, c.date, min((r.back + CAST(c.date < r.date AS INT), r.changes + c.changes, r.jumps + abs(c.date - r.date), r.i)) AS b
    FROM route r JOIN line c ON c.book = r.book AND c.pos = r.pos + 1 GROUP BY c.book, c.pos, c.i, c.date)),
last_place AS (SELECT book, max(pos) AS pos FROM line GROUP BY book),
goal AS (SELECT r.book, r.pos, min((back, changes, jumps, i)) AS b FROM route r JOIN last_place USING (book, pos) GROUP BY ALL),
trace AS (SELECT g.book, g.pos, b[4] AS i FROM goal g JOIN turns USING (book) WHERE b[1] < backward
  UNION ALL SELECT t.book, t.pos - 1, r.came FROM trace t JOIN route r USING (book, pos, i) WHERE t.pos > 1),
moves AS (SELECT k, dd, yy FROM trace JOIN line USING (book, pos, i) WHERE changes > 0),
s1 AS (SELECT s.*, coalesce(m.dd, day_n) AS d2, coalesce(m.yy, y1) AS y2, coalesce(m.dd <> day_n, false) AS dmove, coalesce(m.yy <> y1, false) AS ymove FROM s0 s LEFT JOIN moves m USING (k)),
"""


@register("sequence_candidates", "long page_number, string day, string month, string year, long changed", """
SELECT page_number, CASE WHEN dmove THEN CAST(d2 AS VARCHAR) ELSE day END AS day, month, CASE WHEN ymove THEN lpad(CAST(y2 AS VARCHAR), 2, '0') ELSE year END AS year,
  CAST(dmove AS INT) + CAST(ymove AS INT) AS changed FROM s1""", sequence_sql(False), recursive=True)
def sequence_candidates(spark, folder):
    chosen = S.sequence_candidates(books(spark, folder))
    return chosen.select("page_number", *[F.col(f)["value"].alias(f) for f in ("day", "month", "year")], F.col("sequence_candidates").alias("changed"))


def component_steps(name: str, source: str, n: str, anchor: str) -> str:
    """Between anchors, edges and consensus of one part, one after the other; leaves ``{name}3`` with the value ``{name}v`` and what was done."""
    x = name
    return f"""
{x}a AS (SELECT k, book, log_no, page_number, file_seq, {n} AS v FROM {source} WHERE log_no IS NOT NULL AND alignment = 'ok' AND {n} IS NOT NULL AND {anchor}),
{x}levels AS (SELECT DISTINCT book, log_no FROM {source} WHERE log_no IS NOT NULL),
{x}lefts AS (SELECT l.book, l.log_no, max((a.log_no, a.page_number, a.file_seq, a.v)) AS a FROM {x}levels l JOIN {x}a a ON a.book = l.book AND a.log_no < l.log_no GROUP BY ALL),
{x}rights AS (SELECT l.book, l.log_no, min((a.log_no, a.page_number, a.file_seq, a.v)) AS a FROM {x}levels l JOIN {x}a a ON a.book = l.book AND a.log_no > l.log_no GROUP BY ALL),
{x}spans AS (SELECT l.book, l.log_no, l.a[4] AS v FROM {x}lefts l JOIN {x}rights r USING (book, log_no) WHERE l.a[4] = r.a[4]),
{x}contrary AS (SELECT s.book, s.log_no, count(*) AS n FROM {x}spans s JOIN {x}a a ON a.book = s.book AND a.log_no = s.log_no AND a.v <> s.v GROUP BY ALL),
{x}1 AS (SELECT p.*, s.v AS {x}s, CASE WHEN s.v IS NULL OR coalesce(c.n, 0) - CAST(coalesce(a.v <> s.v, false) AS INT) > 0 THEN '' WHEN {n} IS NULL THEN 'fill' WHEN {n} <> s.v THEN 'flag' ELSE '' END AS {x}act
  FROM {source} p LEFT JOIN {x}spans s ON s.book = p.book AND s.log_no = p.log_no AND p.alignment = 'ok' LEFT JOIN {x}contrary c ON c.book = p.book AND c.log_no = p.log_no LEFT JOIN {x}a a ON a.k = p.k),
{x}left_over AS (SELECT a.* FROM {x}a a JOIN {x}1 p USING (k) WHERE p.{x}act <> 'flag'),
{x}ends AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY log_no, page_number, file_seq) AS a, row_number() OVER (PARTITION BY book ORDER BY log_no DESC, page_number DESC, file_seq DESC) AS z FROM {x}left_over),
{x}edges AS (SELECT book, max(v) FILTER (a = 1) AS v1, max(v) FILTER (a = 2) AS v2, max(log_no) FILTER (a = 1) AS n1, max(v) FILTER (z = 1) AS w1, max(v) FILTER (z = 2) AS w2, max(log_no) FILTER (z = 1) AS m1 FROM {x}ends GROUP BY book),
{x}2 AS (SELECT p.*, CASE WHEN {n} IS NULL AND {x}act <> 'fill' AND alignment = 'ok' THEN CASE WHEN v1 = v2 AND log_no < n1 AND n1 - log_no <= 10 THEN v1 WHEN w1 = w2 AND log_no > m1 AND log_no - m1 <= 10 THEN w1 END END AS {x}edge
  FROM {x}1 p LEFT JOIN {x}edges USING (book)),
{x}agreed AS (SELECT book, min(v) AS v FROM {x}a GROUP BY book HAVING count(*) >= 2 AND min(v) = max(v)),
{x}filled AS (SELECT p.*, CASE WHEN {n} IS NULL AND {x}act <> 'fill' AND {x}edge IS NULL AND NOT blank THEN g.v END AS {x}sole FROM {x}2 p LEFT JOIN {x}agreed g USING (book)),
{x}3 AS (SELECT *, coalesce({n}, CASE WHEN {x}act = 'fill' THEN {x}s END, {x}edge, {x}sole) AS {x}v FROM {x}filled),
"""


CORRECTED = (sequence_sql(True) + component_steps("yy", "s1", "y2", "c4 >= 0.5 AND NOT yfix AND NOT ymove") + component_steps("mm", "yy3", "month_n", "c3 >= 0.5") + f"""
takes AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY log_ord, page_number, file_seq) AS place, yyv * 12 + mmv AS ym, day(last_day(make_date(2000 + yyv, mmv, 1))) AS month_end
  FROM mm3 WHERE NOT blank AND mmv IS NOT NULL AND yyv IS NOT NULL),
ahead AS (SELECT *, first_value(CASE WHEN d2 IS NOT NULL THEN (ym, d2) END IGNORE NULLS) OVER (PARTITION BY book ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM takes),
day_walk AS (SELECT book, place, k, ym, CASE WHEN d2 IS NOT NULL THEN d2 ELSE least(month_end, CASE WHEN nxt[1] = ym THEN nxt[2] ELSE month_end END) END AS day FROM ahead WHERE place = 1
  UNION ALL SELECT a.book, a.place, a.k, a.ym, CASE WHEN a.d2 IS NOT NULL THEN a.d2
    ELSE greatest(least(a.month_end, CASE WHEN a.nxt[1] = a.ym THEN a.nxt[2] ELSE a.month_end END), CASE WHEN w.ym = a.ym THEN w.day ELSE 1 END) END FROM day_walk w JOIN ahead a ON a.book = w.book AND a.place = w.place + 1),
d3 AS (SELECT p.*, CASE WHEN p.d2 IS NULL THEN w.day END AS dfill, coalesce(p.d2, w.day) AS dv FROM mm3 p LEFT JOIN day_walk w USING (k)),
d4 AS (SELECT *, {valid('dv', 'mmv', 'yyv')} AS real_date FROM d3),
backs AS (SELECT k FROM (SELECT k, real_date, lag(real_date) OVER (PARTITION BY book ORDER BY log_no, page_number, file_seq) AS before FROM d4 WHERE log_no IS NOT NULL AND real_date IS NOT NULL) WHERE real_date < before),
d5 AS (SELECT d.*, b.k IS NOT NULL AS back, NOT blank AND real_date IS NULL AS unresolved, yyact = 'fill' OR yyedge IS NOT NULL OR yysole IS NOT NULL AS yput, mmact = 'fill' OR mmedge IS NOT NULL OR mmsole IS NOT NULL AS mput FROM d4 d LEFT JOIN backs b USING (k)),
corrected AS (SELECT k, page_number, book, blank, log, matricula, log_status, matricula_status, yfix, dmove, ymove, yput, mput, dfill, yyact, mmact, back, unresolved, strftime(real_date, '%Y/%m/%d') AS date,
  CASE WHEN dfill IS NOT NULL THEN lpad(CAST(dfill AS VARCHAR), 2, '0') WHEN dmove THEN CAST(d2 AS VARCHAR) ELSE day END AS day,
  CASE WHEN mput THEN {MONTHS}[mmv] ELSE month END AS month, CASE WHEN yput OR yfix OR ymove THEN lpad(CAST(yyv AS VARCHAR), 2, '0') ELSE year END AS year,
  CASE WHEN dmove OR dfill IS NOT NULL OR unresolved AND dv IS NULL THEN 'WARNING' ELSE day_status END AS day_status,
  CASE WHEN mput OR mmact = 'flag' OR unresolved AND mmv IS NULL THEN 'WARNING' ELSE month_status END AS month_status,
  CASE WHEN yput OR yfix OR ymove OR yyact = 'flag' OR back OR unresolved AND (yyv IS NULL OR dv IS NOT NULL AND mmv IS NOT NULL) THEN 'WARNING' ELSE year_status END AS year_status,
  CASE WHEN unresolved AND yyv IS NULL THEN 'date_unresolved' WHEN unresolved AND dv IS NOT NULL AND mmv IS NOT NULL THEN 'invalid_calendar_date' WHEN back THEN 'log_number_regression' WHEN yysole IS NOT NULL THEN 'book_consensus'
    WHEN yyedge IS NOT NULL THEN 'log_number_local_consensus' WHEN yyact = 'fill' THEN 'log_number_interval' WHEN yyact = 'flag' THEN 'log_number_interval_conflict' WHEN ymove THEN 'log_number_sequence_candidate'
    WHEN yfix THEN 'log_number_year_consensus' END AS year_method FROM d5),
""")


@register("correct_dates", "long page_number, string date, string day, string month, string year, string year_method, string status", f"""
SELECT page_number, date, day, month, year, year_method, CASE WHEN blank THEN 'OK' ELSE {status_sql('matricula', 'matricula_status')} END AS status FROM corrected""", CORRECTED, recursive=True)
def correct_dates(spark, folder):
    done = C.correct_dates(D.pages(spark, folder), FIELDS)
    return done.select("page_number", "date", *[F.col(f)["value"].alias(f) for f in ("day", "month", "year")], F.col("year.inference_method").alias("year_method"), "status")


@register("correct_dates_cut", "long page_number, string date, string year_method, string status", f"""
SELECT page_number, date, year_method, CASE WHEN blank THEN 'OK' ELSE {status_sql('matricula', 'matricula_status')} END AS status FROM corrected""", CORRECTED, recursive=True)
def correct_dates_cut(spark, folder):
    """The same with books of more than 30 pages cut into segments."""
    before = spark.conf.get("foliant.hotRows", None)
    spark.conf.set("foliant.hotRows", "30")
    try:
        # Segments are cut while the plan is built.
        return C.correct_dates(D.pages(spark, folder), FIELDS).select("page_number", "date", F.col("year.inference_method").alias("year_method"), "status")
    finally:
        spark.conf.unset("foliant.hotRows") if before is None else spark.conf.set("foliant.hotRows", before)


@register("correction_stats", "long books, long years_consensus, long sequence_candidates, long years_filled, long months_filled, long days_filled, long flagged, long regressions, long unresolved, long corrected", """
SELECT *, years_consensus + sequence_candidates + years_filled + months_filled + days_filled AS corrected FROM (
  SELECT count(DISTINCT book) AS books, count(*) FILTER (yfix) AS years_consensus, count(*) FILTER (dmove) + count(*) FILTER (ymove) AS sequence_candidates, count(*) FILTER (yput) AS years_filled,
    count(*) FILTER (mput) AS months_filled, count(dfill) AS days_filled, count(*) FILTER (yyact = 'flag') + count(*) FILTER (mmact = 'flag') AS flagged, count(*) FILTER (back) AS regressions, count(*) FILTER (unresolved) AS unresolved FROM corrected)""",
          CORRECTED, recursive=True)
def correction_stats(spark, folder):
    return C.correction_stats(C.correct_dates(D.pages(spark, folder), FIELDS))


POLICY = PAGES + """
policy AS (SELECT page_number, month_n IS NOT NULL AND year_n IS NOT NULL AS ok, day(last_day(make_date(2000 + year_n, month_n, 1))) AS last, day, CASE WHEN day_n <= day(last_day(make_date(2000 + year_n, month_n, 1))) THEN day_n END AS read,
  '20' || year || '/' || lpad(CAST(month_n AS VARCHAR), 2, '0') || '/' AS stem FROM pages),
"""
POLICY_COLUMNS = "long page_number, string day, string date, boolean changed, string reason"


@register("csv_date_specific_day", POLICY_COLUMNS, """
SELECT page_number, CAST(coalesce(read, last) AS VARCHAR) AS day, stem || lpad(CAST(coalesce(read, last) AS VARCHAR), 2, '0') AS date, read IS NULL AS changed,
  CASE WHEN read IS NULL THEN 'Día OCR sin resolver; se usó el último día calendario del mes en el CSV' ELSE '' END AS reason FROM policy WHERE ok""", POLICY)
def csv_date_specific_day(spark, folder):
    return D.pages(spark, folder).select("page_number", T.output_date(False).alias("p")).where("p is not null").select("page_number", "p.*")


@register("csv_date_month_end", POLICY_COLUMNS, """
SELECT page_number, CAST(last AS VARCHAR) AS day, stem || lpad(CAST(last AS VARCHAR), 2, '0') AS date, read IS DISTINCT FROM last AS changed,
  'CSV configurado para usar el último día del mes; día OCR: ' || coalesce(day, 'vacío') AS reason FROM policy WHERE ok""", POLICY)
def csv_date_month_end(spark, folder):
    return D.pages(spark, folder).select("page_number", T.output_date(True).alias("p")).where("p is not null").select("page_number", "p.*")
