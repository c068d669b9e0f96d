"""The derived logbook tables as SQL (FIXTURES.md), shared by the query texts."""

MONTHS = "['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEP','OCT','NOV','DIC']"

_CONF = ", ".join(f"(25 + (k*7 + {13 * i}) % 76) / 100.0 AS c{i}" for i in range(5))
_SIGNATURES = ("pilot_signature", "captain_signature", "captain_license", "technician_license", "technician_signature")
_SIG = ", ".join(
    f"CASE (k // {2 * i} + {i}) % 10 WHEN 0 THEN 'unclear' WHEN 1 THEN 'false' WHEN 2 THEN 'false' ELSE 'true' END AS {f}, "
    f"(20 + (k*3 + {5 * i}) % 80) / 100.0 AS {f}_conf" for i, f in enumerate(_SIGNATURES, 1))
_STATUS = ", ".join(
    f"CASE WHEN {f} IS NULL THEN 'ERROR' WHEN c{i} < 0.5 THEN 'WARNING' ELSE 'OK' END AS {f}_status"
    for i, f in enumerate(("log", "matricula", "day", "month", "year")))

PAGES = f"""
base AS (SELECT o_orderkey AS k, o_custkey % 20 AS file_seq, o_orderkey // 40 AS b, o_orderkey % 40 AS s FROM orders),
p0 AS (SELECT *, 1000 + (b*37) % 9000 AS tn, DATE '2024-01-01' + CAST(b % 600 + s // 3 AS INTEGER) AS d,
  (20000 + b // 2) * 100 + (b % 2) * 50 + CASE WHEN k % 97 = 5 AND s > 0 THEN s - 1 ELSE s END AS lg FROM base),
p1 AS (SELECT *, CAST(CASE WHEN k % 11 = 3 THEN tn - tn % 10 + (tn % 10 + 1) % 10 ELSE tn END AS VARCHAR) AS n,
  lpad(CAST(day(d) AS VARCHAR), 2, '0') AS true_day, lpad(CAST(day(d) % 28 + 1 AS VARCHAR), 2, '0') AS other_day FROM p0),
p2 AS (SELECT k, b, s, n, file_seq, 'scan_' || lpad(CAST(file_seq AS VARCHAR), 2, '0') || '.pdf' AS file, k + 1 AS page_number,
  k % 101 = 0 AS blank, CASE WHEN k % 43 = 6 THEN 'low' ELSE 'ok' END AS alignment, CAST(100 + k % 900 AS DOUBLE) AS processing_ms,
  CASE WHEN k % 13 <> 0 THEN lpad(CAST(lg AS VARCHAR), 7, '0') END AS log, CASE WHEN k % 13 <> 0 THEN lg END AS log_no,
  CASE WHEN k % 17 <> 4 THEN 'HP-' || n || CASE WHEN n IN ('1522', '1990') THEN 'WWP' ELSE 'CMP' END END AS matricula,
  CASE WHEN k % 17 <> 4 THEN CASE k % 10 WHEN 7 THEN 'hp ' || n || ' cmp' WHEN 8 THEN 'HP-' || replace(n, '1', 'I') || 'CMP'
    WHEN 9 THEN 'HP ' || n[1] || 'X' || n[2:3] || 'Y' || n[4] ELSE 'HP-' || n || 'CMP' END END AS matricula_raw,
  CASE WHEN k % 19 <> 2 THEN CASE WHEN k % 31 = 9 THEN other_day ELSE true_day END END AS day,
  CASE WHEN k % 19 <> 2 AND k % 31 = 9 THEN true_day END AS day_alt,
  CASE WHEN k % 23 <> 7 THEN {MONTHS}[month(d)] END AS month, CASE WHEN k % 23 <> 7 THEN month(d) END AS month_n,
  CASE WHEN k % 37 <> 5 THEN lpad(CAST((year(d) + CASE WHEN k % 29 = 11 THEN 3 ELSE 0 END) % 100 AS VARCHAR), 2, '0') END AS year,
  CASE WHEN k % 37 <> 5 THEN (year(d) + CASE WHEN k % 29 = 11 THEN 3 ELSE 0 END) % 100 END AS year_n,
  {_CONF}, {_SIG} FROM p1),
pages AS (SELECT *, CAST(day AS BIGINT) AS day_n, coalesce(log_no, 1073741824) AS log_ord,
  CASE WHEN log IS NULL THEN 'unknown' ELSE log[1:5] || CASE WHEN CAST(log[6:7] AS INT) < 50 THEN 'A' ELSE 'B' END END AS book, {_STATUS} FROM p2),
"""

# All ten fields of a page in template order: (field_id, value, confidence, status, alternatives).
FIELD_ROWS = ("LATERAL (VALUES ('log_number', log, c0, log_status, 0), ('matricula', matricula, c1, matricula_status, 0), "
              "('day', day, c2, day_status, CASE WHEN day_alt IS NULL THEN 0 ELSE 1 END), ('month', month, c3, month_status, 0), ('year', year, c4, year_status, 0), "
              + ", ".join(f"('{f}', {f}, {f}_conf, 'OK', 0)" for f in _SIGNATURES) + ") f(field_id, value, confidence, status, alternatives)")

FLEET = """
fleet AS (SELECT DISTINCT 'HP-' || CAST(1000 + ((o_orderkey // 40) * 37) % 9000 AS VARCHAR) || 'CMP' AS registration
  FROM orders WHERE (o_orderkey // 40) % 3 <> 0),
"""
