"""Index records, remote batches and write plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import register
from catalog.tables import PAGES
from foliant.functions import dates as T
from foliant.operators import reconcile as R
from foliant.operators.books import mark_duplicates
from foliant.operators.quality import discrepancy_flags
from foliant.operators.skew import positions
from foliant.plans import derived as D
from foliant.session import save_rows
from foliant.sources import readers


def report_rows(spark, folder):
    """Run report columns, all texts, with their row number (the page number)."""
    date = T.date_text(T.year_number(F.col("year")["value"]) + 2000, T.month_number(F.col("month")["value"]), T.day_number(F.col("day")["value"]))
    # Only texts go through the join of the duplicates. Saved, they are derived once, in a stage whose code stays small enough to be compiled.
    narrow = discrepancy_flags(D.pages(spark, folder)).select("file_seq", "file", "page_number", "printed_number", F.struct(F.col("log_number")["value"].alias("value")).alias("log_number"),
                                                              F.coalesce(F.col("matricula")["value"], F.lit("")).alias("matricula"), F.coalesce(date, F.lit("")).alias("date"), "discrepancy")
    pages = mark_duplicates(save_rows(narrow))
    return pages.select(F.col("page_number").alias("row"), "file", F.col("page_number").cast("string").alias("page"), "matricula",
                        F.coalesce(F.col("log_number")["value"], F.lit("")).alias("log_number"), "date",
                        F.col("dup").cast("string").alias("dup"), F.col("discrepancy").cast("string").alias("disc"))


def delivery(spark, folder):
    """Delivery entries in page order: a separator before every fortieth page, and one page in 211 that the report lacks."""
    k = F.col("page_number") - 1
    pages = D.pages(spark, folder).select(F.col("page_number").alias("o"), F.lit(1).alias("b"), F.lit("").alias("separator"), F.when(k % 211 == 7, "gone.pdf").otherwise(F.col("file")).alias("file"),
                                          F.col("page_number").cast("string").alias("page"))
    heads = D.pages(spark, folder).where(k % 40 == 0).select(F.col("page_number").alias("o"), F.lit(0).alias("b"), F.concat(F.lit("SECCION "), F.floor(k / 40).cast("string")).alias("separator"),
                                                            F.lit("").alias("file"), F.lit("").alias("page"))
    return positions(pages.unionByName(heads), ["o", "b"], "seq")


def cache(spark, folder):
    """Known fleets: every fourth fleet registration."""
    number = F.substring("registration", 4, 4).cast("long")
    return D.fleet(spark, folder).where(number % 4 == 0).select("registration", F.when(number % 8 == 0, "NGX").otherwise("MAX8").alias("fleet"), F.when(number % 3 == 0, "ACME").otherwise("").alias("lessor"))


# The records; ``seq`` counts separators and pages.
RECORDS = PAGES + """
cache AS (SELECT DISTINCT 'HP-' || CAST(tn AS VARCHAR) || 'CMP' AS reg, CASE WHEN tn % 8 = 0 THEN 'NGX' ELSE 'MAX8' END AS c_fleet, CASE WHEN tn % 3 = 0 THEN 'ACME' ELSE '' END AS c_lessor
  FROM (SELECT 1000 + ((o_orderkey // 40) * 37) % 9000 AS tn FROM orders WHERE (o_orderkey // 40) % 3 <> 0) WHERE tn % 4 = 0),
report AS (SELECT *, log_no IS NOT NULL AND row_number() OVER (PARTITION BY log_no ORDER BY file_seq, page_number) > 1 AS dup,
  CASE WHEN day IS NULL OR month IS NULL OR year IS NULL THEN '' ELSE '20' || year || '/' || lpad(CAST(month_n AS VARCHAR), 2, '0') || '/' || day END AS date FROM pages),
entries AS (SELECT page_number AS o, 1 AS h, '' AS separator, k FROM pages UNION ALL SELECT page_number, 0, 'SECCION ' || CAST(k // 40 AS VARCHAR), k FROM pages WHERE k % 40 = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY o, h) AS seq FROM entries),
drawn AS (SELECT n.seq, n.separator, n.k, CASE WHEN n.h = 0 THEN '' WHEN n.k % 211 = 7 THEN 'gone.pdf' ELSE r.file END AS file, CASE WHEN n.h = 0 THEN 0 ELSE n.o END AS page, n.h = 1 AND n.k % 211 = 7 AS missing_row,
  CASE WHEN n.h = 1 AND n.k % 211 <> 7 THEN coalesce(r.matricula, '') ELSE '' END AS registration, CASE WHEN n.h = 1 AND n.k % 211 <> 7 THEN coalesce(r.log, '') ELSE '' END AS log_number,
  CASE WHEN n.h = 1 AND n.k % 211 <> 7 THEN r.date ELSE '' END AS date, n.h = 1 AND n.k % 211 <> 7 AND r.dup AS dup FROM numbered n JOIN report r USING (k)),
records AS (SELECT d.*, CASE WHEN registration = '' THEN '' WHEN c_fleet IS NOT NULL THEN c_fleet WHEN registration LIKE 'HP-98%' OR registration LIKE 'HP-99%' THEN 'MAX' ELSE 'NG' END AS fleet,
  CASE WHEN registration <> '' THEN coalesce(c_lessor, '') ELSE '' END AS lessor, registration <> '' AND c_fleet IS NULL AS fleet_inferred FROM drawn d LEFT JOIN cache ON reg = registration),
"""
RECORD_COLUMNS = "long seq, string separator, string file, long page, string registration, string log_number, string date, string fleet, string lessor, boolean fleet_inferred, boolean dup, boolean missing_row"


def records(spark, folder):
    return R.records_from_delivery(report_rows(spark, folder), delivery(spark, folder), cache(spark, folder))


def saved_records(spark, folder):
    """For queries that use the records more than once."""
    return save_rows(records(spark, folder))


@register("records_from_delivery", RECORD_COLUMNS, "SELECT * FROM records", RECORDS)
def records_from_delivery(spark, folder):
    return records(spark, folder)


CSV_RECORD = "long seq, string file, long page, string registration, string log_number, string date, string fleet, boolean fleet_inferred, boolean dup"
FLEET_OF = "CASE WHEN matricula IS NULL THEN '' WHEN c_fleet IS NOT NULL THEN c_fleet WHEN matricula LIKE 'HP-98%' OR matricula LIKE 'HP-99%' THEN 'MAX' ELSE 'NG' END"


@register("records_from_csv", CSV_RECORD, f"""
SELECT row_number() OVER (ORDER BY page_number) AS seq, file, page_number AS page, coalesce(matricula, '') AS registration, coalesce(log, '') AS log_number, date, {FLEET_OF} AS fleet, matricula IS NOT NULL AND c_fleet IS NULL AS fleet_inferred, dup
FROM report LEFT JOIN cache ON reg = matricula WHERE NOT (matricula IS NULL AND log IS NULL AND date = '')""", RECORDS)
def records_from_csv(spark, folder):
    return R.records_from_csv(report_rows(spark, folder), cache(spark, folder))


@register("records_from_csv_ordered", CSV_RECORD, f"""
SELECT row_number() OVER (ORDER BY page_number DESC) AS seq, file, page_number AS page, coalesce(matricula, '') AS registration, coalesce(log, '') AS log_number, date, {FLEET_OF} AS fleet, matricula IS NOT NULL AND c_fleet IS NULL AS fleet_inferred, dup
FROM report LEFT JOIN cache ON reg = matricula WHERE NOT (matricula IS NULL AND log IS NULL AND date = '')""", RECORDS)
def records_from_csv_ordered(spark, folder):
    order = D.pages(spark, folder).select((-F.col("page_number")).alias("pos"), "file", F.col("page_number").alias("page"))
    return R.records_from_csv(report_rows(spark, folder), cache(spark, folder), order)


@register("blank_index_rows", "long page", "SELECT page_number AS page FROM report WHERE matricula IS NULL AND log IS NULL AND date = ''", RECORDS)
def blank_index_rows(spark, folder):
    from foliant.functions.registrations import index_log_number, index_registration
    rows = report_rows(spark, folder).select("page", index_registration(F.col("matricula")).alias("registration"), index_log_number(F.col("log_number")).alias("log_number"), "date")
    return rows.where(R.is_blank_row())


@register("resolve_fleet", "long seq, string registration, string fleet, string lessor, boolean fleet_inferred", "SELECT seq, registration, fleet, lessor, fleet_inferred FROM records WHERE separator = ''", RECORDS)
def resolve_fleet(spark, folder):
    return R.resolve_fleet(records(spark, folder).where("separator = ''").select("seq", "registration"), cache(spark, folder))


# What the remote index already holds: some pages missing, some in another state, some with another number or fleet.
REMOTE = RECORDS + """
remote AS (SELECT seq AS page, CASE WHEN seq % 7 = 0 THEN 0 ELSE 1 END AS state, CASE WHEN seq % 41 = 0 THEN '1234567' WHEN seq % 3 = 0 THEN log_number ELSE '' END AS r_log,
  CASE WHEN seq % 13 = 0 THEN 'HP-1111CMP' WHEN seq % 5 = 0 THEN registration ELSE '' END AS r_reg, CASE WHEN seq % 5 = 0 THEN 'F' || CAST(seq % 4 AS VARCHAR) ELSE '' END AS r_fleet,
  CASE WHEN seq % 10 = 0 THEN 'L' || CAST(seq % 3 AS VARCHAR) ELSE '' END AS r_lessor FROM records WHERE seq % 9 <> 0),
learnt AS (SELECT r_reg AS reg, max_by(r_fleet, page) AS fleet, max_by(r_lessor, page) FILTER (r_lessor <> '') AS lessor FROM remote WHERE r_reg <> '' AND r_fleet <> '' GROUP BY r_reg),
learnt_pages AS (SELECT r_reg AS reg, max_by(r_fleet, seq) AS fleet, max_by(r_lessor, seq) FILTER (r_lessor <> '') AS lessor FROM remote m JOIN records ON seq = m.page WHERE separator = '' AND r_reg <> '' AND r_fleet <> '' GROUP BY r_reg),
fixed AS (SELECT r.* EXCLUDE (fleet, lessor, fleet_inferred), CASE WHEN fleet_inferred AND l.fleet IS NOT NULL THEN l.fleet ELSE r.fleet END AS fleet,
  CASE WHEN fleet_inferred AND l.fleet IS NOT NULL AND r.lessor = '' THEN coalesce(l.lessor, '') ELSE r.lessor END AS lessor, fleet_inferred AND l.fleet IS NULL AS fleet_inferred FROM records r LEFT JOIN learnt_pages l ON l.reg = r.registration),
picklist AS (SELECT DISTINCT matricula AS value FROM pages WHERE matricula IS NOT NULL AND CAST(matricula[4:7] AS INT) % 5 <> 0),
"""


def remote(spark, folder, recs=None):
    recs = records(spark, folder) if recs is None else recs
    seq = F.col("seq")
    log = F.when(seq % 41 == 0, "1234567").when(seq % 3 == 0, F.col("log_number")).otherwise("")
    reg = F.when(seq % 13 == 0, "HP-1111CMP").when(seq % 5 == 0, F.col("registration")).otherwise("")
    fleet = F.when(seq % 5 == 0, F.concat(F.lit("F"), (seq % 4).cast("string"))).otherwise("")
    lessor = F.when(seq % 10 == 0, F.concat(F.lit("L"), (seq % 3).cast("string"))).otherwise("")
    values = F.create_map(F.lit(9675), log, F.lit(9633), reg, F.lit(9699), fleet, F.lit(9783), lessor)
    return recs.where(seq % 9 != 0).select(seq.alias("page"), F.when(seq % 7 == 0, 0).otherwise(1).alias("state"), values.alias("values"))


def picklist(spark, folder):
    value = F.col("matricula")["value"]
    return D.pages(spark, folder).select(value.alias("value")).where(F.substring("value", 4, 4).cast("int") % 5 != 0).distinct()


@register("learn_fleet", "string registration, string fleet, string lessor", """
SELECT coalesce(c.reg, l.reg) AS registration, coalesce(l.fleet, c_fleet) AS fleet, coalesce(l.lessor, c_lessor, '') AS lessor FROM cache c FULL JOIN learnt l ON l.reg = c.reg""", REMOTE)
def learn_fleet(spark, folder):
    seen = remote(spark, folder).select(F.col("page").alias("seq"), *[F.try_element_at("values", F.lit(k)).alias(n) for k, n in ((9633, "registration"), (9699, "fleet"), (9783, "lessor"))])
    return R.learn_fleet(cache(spark, folder), seen)


@register("correct_inferred_fleet", "long seq, string fleet, string lessor, boolean fleet_inferred", "SELECT seq, fleet, lessor, fleet_inferred FROM fixed", REMOTE)
def correct_inferred_fleet(spark, folder):
    recs = saved_records(spark, folder)
    seen = remote(spark, folder, recs).join(recs.where("separator = ''").select(F.col("seq").alias("page")), "page", "left_semi")
    pairs = seen.select(F.col("page").alias("seq"), *[F.try_element_at("values", F.lit(k)).alias(n) for k, n in ((9633, "registration"), (9699, "fleet"), (9783, "lessor"))])
    return R.correct_inferred_fleet(recs, R.learn_fleet(cache(spark, folder).where(F.lit(False)), pairs))


@register("check_picklist", "long seq, string code, string detail", """
SELECT seq, CASE WHEN registration = '' THEN 'matricula_vacia' ELSE 'matricula_desconocida' END AS code, CASE WHEN registration = '' THEN 'no se pudo leer la matricula' ELSE registration || ' no esta en el picklist del indice remoto' END AS detail
FROM records WHERE separator = '' AND registration NOT IN (SELECT value FROM picklist)""", REMOTE)
def check_picklist(spark, folder):
    return R.check_picklist(records(spark, folder), picklist(spark, folder))


@register("check_record_duplicates", "long seq, string code, string detail", """
SELECT seq, 'log_duplicado' AS code, 'el log ' || log_number || ' ya salio en la pagina ' || CAST(first AS VARCHAR) AS detail FROM (SELECT *, min(seq) OVER (PARTITION BY log_number) AS first FROM records WHERE separator = '' AND log_number <> '') WHERE seq > first""", REMOTE)
def check_record_duplicates(spark, folder):
    return R.check_record_duplicates(saved_records(spark, folder))


_NOTICES = """
  CASE WHEN m.page IS NULL THEN '[no_cargo] pagina ' || f.seq || ': el indice remoto no devolvio la pagina ' || f.seq || ': sin respuesta' END,
  CASE WHEN r_log <> '' AND log_number <> '' AND r_log <> log_number THEN '[desalineado] pagina ' || f.seq || ': el indice remoto tiene el log ' || r_log || ' y el manifiesto ' || log_number END,
  CASE WHEN r_reg <> '' AND registration <> '' AND r_reg <> registration AND r_log = '' THEN '[matricula_distinta] pagina ' || f.seq || ': el indice remoto tiene ' || r_reg || ' y el manifiesto ' || registration END,
  CASE WHEN m.state = 0 THEN '[ya_indexada] pagina ' || f.seq || ': la pagina ya esta en Valid; usar --sobrescribir para pisarla' END"""


@register("check_alignment", "long seq, string notice", f"""
SELECT seq, notice FROM (SELECT f.seq, unnest([{_NOTICES}]) AS notice FROM records f LEFT JOIN remote m ON m.page = f.seq WHERE separator = '') WHERE notice IS NOT NULL""", REMOTE)
def check_alignment(spark, folder):
    recs = saved_records(spark, folder)
    found = R.check_alignment(recs, remote(spark, folder, recs))
    return found.select("seq", F.concat(F.lit("["), "code", F.lit("] pagina "), F.col("seq").cast("string"), F.lit(": "), "detail").alias("notice"))


_EMPTY = ", ".join(f"CASE WHEN {c} = '' THEN '[obligatorio_vacio] pagina ' || f.seq || ': el campo {i} quedaria vacio' END" for i, c in ((9633, "registration"), (9699, "fleet"), (9675, "log_number"), (9593, "date")))
PLAN = REMOTE + f"""
firsts AS (SELECT log_number AS fl, min(seq) AS first FROM records WHERE separator = '' AND log_number <> '' GROUP BY log_number),
plan AS (SELECT f.*, coalesce(m.state = 0, false) AND separator = '' AS already, CASE WHEN separator <> '' THEN '' ELSE concat_ws(' | ',
  CASE WHEN registration = '' THEN '[matricula_vacia] pagina ' || f.seq || ': no se pudo leer la matricula' WHEN registration NOT IN (SELECT value FROM picklist) THEN '[matricula_desconocida] pagina ' || f.seq || ': ' || registration || ' no esta en el picklist del indice remoto' END,
  CASE WHEN f.seq > first THEN '[log_duplicado] pagina ' || f.seq || ': el log ' || log_number || ' ya salio en la pagina ' || first END, {_EMPTY}, {_NOTICES}) END AS avisos
  FROM fixed f LEFT JOIN remote m ON m.page = f.seq LEFT JOIN firsts ON fl = log_number),
actions AS (SELECT *, CASE WHEN separator <> '' THEN 'separador' WHEN avisos = '' THEN 'escribir' ELSE 'bloqueada' END AS accion FROM plan),
"""
PLAN_COLUMNS = ("long pagina_lote, long seq, string archivo_origen, long pagina_origen, string doc_type, string matricula, string fleet, string fleet_inferido, string log_number, string audit_status, "
                "string end_date, string ya_indexada, string accion, string avisos")


def plan(spark, folder):
    recs = saved_records(spark, folder)
    return R.plan_pages(recs, remote(spark, folder, recs), picklist(spark, folder), cache(spark, folder), remote_pages=recs.agg(F.count("*")).scalar(), batch_name="LOTE")


@register("plan_pages", PLAN_COLUMNS, """
SELECT seq AS pagina_lote, seq, file AS archivo_origen, page AS pagina_origen, CASE WHEN separator = '' THEN 'Log Page' ELSE '' END AS doc_type, CASE WHEN separator <> '' THEN separator ELSE registration END AS matricula,
  CASE WHEN separator = '' THEN fleet ELSE '' END AS fleet, CASE WHEN fleet_inferred THEN 'si' ELSE '' END AS fleet_inferido, log_number, CASE WHEN separator = '' THEN 'PUBLISHED' ELSE '' END AS audit_status,
  CASE WHEN date = '' THEN '' ELSE date[6:7] || '/' || date[9:10] || '/' || date[1:4] END AS end_date, CASE WHEN already THEN 'si' ELSE '' END AS ya_indexada, accion, avisos FROM actions""", PLAN)
def plan_pages(spark, folder):
    return R.plan_rows(plan(spark, folder))


@register("plan_upload_only", "long seq, string accion, string avisos", """
SELECT seq, CASE WHEN separator <> '' THEN 'separador' ELSE 'bloqueada' END AS accion, CASE WHEN separator <> '' THEN '' ELSE '[revisar_a_mano] pagina ' || seq || ': sin avion confirmado; se indexa a mano en el indice remoto' END AS avisos FROM records""", RECORDS)
def plan_upload_only(spark, folder):
    recs = saved_records(spark, folder)
    return R.plan_rows(R.plan_pages(recs, remote(spark, folder, recs), picklist(spark, folder), cache(spark, folder), upload_only=True))


@register("plan_summary", "long total, long writable, long blocked, long separators", """
SELECT count(*) AS total, count(*) FILTER (accion = 'escribir') AS writable, count(*) FILTER (accion = 'bloqueada') AS blocked, count(*) FILTER (accion = 'separador') AS separators FROM actions""", PLAN)
def plan_summary(spark, folder):
    return R.plan_summary(plan(spark, folder))


@register("blocked_reasons", "string code, long pages", r"""
SELECT code, count(*) AS pages FROM (SELECT unnest(regexp_extract_all(avisos, '\[([a-z_]+)\] pagina', 1)) AS code FROM actions) GROUP BY code""", PLAN)
def blocked_reasons(spark, folder):
    return R.blocked_reasons(plan(spark, folder))


@register("index_values", "long seq, long field_id, string value", """
SELECT seq, f.id AS field_id, f.v AS value FROM records, LATERAL (VALUES (9586, 'Log Page'), (9633, registration), (9699, fleet), (9675, log_number), (9754, 'PUBLISHED'),
  (9593, CASE WHEN date = '' THEN '' ELSE date[6:7] || '/' || date[9:10] || '/' || date[1:4] END), (9783, CASE WHEN lessor <> '' THEN lessor END), (9631, 'LOTE')) f(id, v) WHERE separator = '' AND f.v IS NOT NULL""", RECORDS)
def index_values(spark, folder):
    return records(spark, folder).where("separator = ''").select("seq", F.explode(R.index_values("LOTE")).alias("field_id", "value"))


def outcomes(recs):
    """Every 17th write fails, the connection drops at a late one."""
    seq = F.col("seq")
    return recs.select("seq", F.when(seq % 5000 == 4999, "connection").when(seq % 17 == 0, "error").otherwise("ok").alias("result"), F.concat(F.lit("m"), seq.cast("string")).alias("message"))


OUTCOMES = PLAN + """
tried AS (SELECT *, seq % 6 = 0 AS was_written, CASE WHEN seq % 5000 = 4999 THEN 'connection' WHEN seq % 17 = 0 THEN 'error' ELSE 'ok' END AS result FROM actions),
ended AS (SELECT *, coalesce((SELECT min(seq) FROM tried WHERE accion = 'escribir' AND NOT was_written AND result = 'connection'), 9223372036854775807) AS cutoff FROM tried),
"""


@register("apply_outcomes", "long seq, string state, string outcome", """
SELECT seq, CASE WHEN seq > cutoff OR accion = 'separador' THEN old WHEN accion = 'bloqueada' THEN 'omitida' WHEN was_written THEN old WHEN result = 'ok' THEN 'escrita' WHEN result = 'error' THEN 'error' ELSE old END AS state,
  CASE WHEN seq > cutoff OR accion = 'separador' THEN '' WHEN accion = 'bloqueada' OR was_written THEN 'omitida' WHEN result = 'ok' THEN 'escrita' WHEN result = 'error' THEN 'fallida' ELSE '' END AS outcome
FROM (SELECT *, CASE WHEN was_written THEN 'escrita' ELSE 'pendiente' END AS old FROM ended)""", OUTCOMES)
def apply_outcomes(spark, folder):
    planned = save_rows(plan(spark, folder)).withColumn("state", F.when(F.col("seq") % 6 == 0, "escrita").otherwise("pendiente"))
    return R.apply_outcomes(planned, outcomes(planned), stop_on_error=False)


@register("apply_outcomes_stopping", "long written, long failed, long pending", """
SELECT count(*) FILTER (state = 'ok') AS written, count(*) FILTER (state = 'error') AS failed, count(*) FILTER (state IS NULL) AS pending FROM (SELECT CASE WHEN seq <= cut THEN result END AS state FROM
 (SELECT *, (SELECT min(seq) FROM tried WHERE accion = 'escribir' AND result <> 'ok') AS cut FROM tried WHERE accion = 'escribir'))""", OUTCOMES)
def apply_outcomes_stopping(spark, folder):
    planned = save_rows(plan(spark, folder)).withColumn("state", F.lit("pendiente"))
    done = R.apply_outcomes(planned, outcomes(planned)).join(planned.select("seq", "action"), "seq").where("action = 'escribir'")
    return done.agg(F.count_if(F.col("state") == "escrita").alias("written"), F.count_if(F.col("state") == "error").alias("failed"), F.count_if(F.col("state") == "pendiente").alias("pending"))


@register("verify_written", "long valid, long checked, long unreadable, long other_state", """
SELECT count(*) FILTER (m.state = 0) AS valid, count(*) AS checked, count(*) FILTER (m.page IS NULL) AS unreadable, count(*) FILTER (m.state <> 0) AS other_state FROM records r LEFT JOIN remote m ON m.page = r.seq WHERE separator = ''""", REMOTE)
def verify_written(spark, folder):
    recs = saved_records(spark, folder)
    return R.verify_written(recs, remote(spark, folder, recs))


@register("manifest_summary", "long records, long separators, long pending, long written, long with_notices, long errors", """
SELECT count(*) AS records, count(*) FILTER (separator <> '') AS separators, count(*) FILTER (separator = '' AND seq % 3 = 0) AS pending, count(*) FILTER (seq % 3 = 1) AS written, count(*) FILTER (seq % 10 = 0) AS with_notices, count(*) FILTER (seq % 3 = 2) AS errors FROM records""", RECORDS)
def manifest_summary(spark, folder):
    state = F.element_at(F.array(F.lit("pendiente"), F.lit("escrita"), F.lit("error")), (F.col("seq") % 3 + 1).cast("int"))
    return R.manifest_summary(records(spark, folder).withColumn("state", state).withColumn("notes", F.when(F.col("seq") % 10 == 0, "[x]").otherwise("")))


# Jobs named after customers; the listing holds each name once or more, sometimes with the uploader's suffix.
LISTING = """
listing AS (SELECT 'b' || c_custkey AS batch_id, c_custkey % 3 AS repo_id, c_custkey % 7 AS pages, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' - ana@x' WHEN c_custkey % 4 = 1 THEN replace(lower(c_name), '#', '#') ELSE c_name END AS name FROM customer
  UNION ALL SELECT 'd' || c_custkey, 0, c_custkey % 5, c_name FROM customer WHERE c_custkey % 6 = 0),
jobs AS (SELECT c_custkey AS job_id, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN 1 END AS repo_id, c_custkey % 7 AS pages FROM customer),
matched AS (SELECT j.job_id, l.batch_id, l.name NOT LIKE '% - ana@x' AS exact, l.pages = j.pages AS same FROM jobs j JOIN listing l ON trim(regexp_replace(lower(replace(l.name, ' - ana@x', '')), '[\\s_|\\-]+', ' ', 'g')) = trim(regexp_replace(lower(j.name), '[\\s_|\\-]+', ' ', 'g'))
  WHERE j.repo_id IS NULL OR l.repo_id = 0 OR l.repo_id = j.repo_id),
best AS (SELECT * FROM matched QUALIFY exact = max(exact) OVER (PARTITION BY job_id)),
narrowed AS (SELECT *, count(*) OVER (PARTITION BY job_id) > 1 AND bool_or(same) OVER (PARTITION BY job_id) AS by_pages FROM best),
final AS (SELECT job_id, count(*) AS n, min(batch_id) AS batch_id FROM narrowed WHERE NOT by_pages OR same GROUP BY job_id),
"""


@register("match_batches", "long job_id, string match, string batch_id, long candidates", """
SELECT j.job_id, CASE WHEN f.n IS NULL THEN 'none' WHEN f.n > 1 THEN 'ambiguous' ELSE 'found' END AS match, CASE WHEN f.n = 1 THEN f.batch_id END AS batch_id, coalesce(f.n, 0) AS candidates FROM jobs j LEFT JOIN final f USING (job_id)""", LISTING)
def match_batches(spark, folder):
    customers = D.table(spark, folder, "customer")
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, F.concat("c_name", F.lit(" - ana@x"))).when(key % 4 == 1, F.lower("c_name")).otherwise(F.col("c_name"))
    listing = customers.select(F.concat(F.lit("b"), key.cast("string")).alias("batch_id"), (key % 3).alias("repo_id"), (key % 7).alias("pages"), name.alias("name")).unionByName(
        customers.where(key % 6 == 0).select(F.concat(F.lit("d"), key.cast("string")).alias("batch_id"), F.lit(0).cast("long").alias("repo_id"), (key % 5).alias("pages"), F.col("c_name").alias("name")))
    jobs = customers.select(key.alias("job_id"), F.col("c_name").alias("name"), F.when(key % 5 != 0, 1).alias("repo_id"), (key % 7).alias("pages"))
    return R.match_batches(jobs, listing)


@register("remote_batches", "string batch_id, string name, long pages, long repo_id, string step", """
SELECT 'b' || c_custkey AS batch_id, c_name || ' & co' AS name, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS pages, c_custkey % 9 AS repo_id, c_mktsegment AS step FROM customer""")
def remote_batches(spark, folder):
    key = F.col("c_custkey")
    pages = F.when(key % 3 == 0, "n/a").otherwise(key.cast("string"))
    named = F.to_json(F.struct(F.concat(F.lit("b"), key.cast("string")).alias("batchid"), F.concat("c_name", F.lit(" &amp; co")).alias("userbatchname"), pages.alias("imagecount"),
                               (key % 9).cast("string").alias("appid"), F.lit("r").alias("appname"), F.col("c_mktsegment").alias("eventlabel")))
    listed = F.to_json(F.array(F.concat(F.lit("b"), key.cast("string")), F.concat("c_name", F.lit(" &amp; co")), pages, (key % 9).cast("string"), F.lit("r"), F.col("c_mktsegment")))
    return readers.remote_batches(D.table(spark, folder, "customer").select(F.when(key % 2 == 0, named).otherwise(listed).alias("cell")))


@register("picklist_values", "long item_no, string value", """
SELECT c_custkey % 100 AS item_no, trim(c_name) AS value FROM customer WHERE c_custkey // 100 = 2""")
def picklist_values(spark, folder):
    """Views of a hundred customers each; the third and every fifth after it name the field."""
    key = F.col("c_custkey")
    views = D.table(spark, folder, "customer").groupBy(F.floor(key / 100).alias("view_no")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("i")).select(
        "view_no", F.when(F.col("view_no") % 5 == 2, "9633").otherwise("1").alias("field_id"), F.transform("i", lambda x: x["c_name"]).alias("items"))
    return readers.picklist_values(views, 9633)


@register("batch_names", "long run, long pos, string batch_name", """
SELECT l_orderkey AS run, l_linenumber AS pos, 'LOTE ' || CASE WHEN l_orderkey % 2 = 0 THEN lpad(CAST(l_orderkey % 28 + 1 AS VARCHAR), 2, '0') || ' AUG 2026 05 42' ELSE upper(strftime(min(l_shipdate), '%d %b %Y %H %M')) END ||
  CASE WHEN l_linenumber = 7 THEN ' REVISAR' WHEN l_orderkey % 3 > 0 THEN ' -' || l_linenumber ELSE '' END AS batch_name FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def batch_names(spark, folder):
    lines = D.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("pos")).agg(F.min("l_shipdate").alias("moment"))
    day = (F.col("run") % 28 + 1).cast("string")
    path = F.when(F.col("run") % 2 == 0, F.concat(F.lit("out/lote  "), day, F.lit(" aug 2026 05 42/x.csv"))).otherwise("out/x.csv")
    parts = lines.select("run", "pos", path.alias("path"), "moment", F.col("pos").alias("number"), F.when(F.col("run") % 3 > 0, 9).otherwise(1).alias("total"), (F.col("pos") == 7).alias("is_review"))
    return R.batch_names(parts, " lote ")


STAGE_LIST = "['procesar','preparar','subir','descubrir','indexar','verificar']"


@register("stage_status", "long job_id, string stage, boolean done, boolean ready", f"""
SELECT job_id, stage, done, coalesce(bool_and(done) OVER (PARTITION BY job_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ready FROM (
 SELECT o_orderkey AS job_id, {STAGE_LIST}[i] AS stage, i, i <= o_orderkey % 7 AND (o_orderkey + i) % 5 <> 0 AS done FROM orders, range(1, 7) t(i) WHERE o_orderkey % 7 > 0)""")
def stage_status(spark, folder):
    key = F.col("o_orderkey")
    stage = F.array(*[F.lit(s) for s in ("procesar", "preparar", "subir", "descubrir", "indexar", "verificar")])
    rows = D.table(spark, folder, "orders").select(key.alias("job_id"), F.posexplode(stage).alias("i", "stage")).where(F.col("i") + 1 <= F.col("job_id") % 7)
    n = F.col("job_id") + F.col("i") + 1
    return R.stage_status(rows.select("job_id", "stage", F.when(n % 5 == 0, "error").when(n % 2 == 0, "hecha").otherwise("omitida").alias("state")))


@register("resume_jobs", "long job_id, string decision", """
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'reuse' WHEN o_orderkey % 5 = 0 THEN 'needs_part' WHEN o_orderkey % 3 = 1 THEN 'rebuild' ELSE 'new' END AS decision FROM orders""")
def resume_jobs(spark, folder):
    key = F.col("o_orderkey")
    orders = D.table(spark, folder, "orders")
    wanted = orders.select(key.alias("job_id"), F.concat(F.lit("run"), (key % 10).cast("string")).alias("source"), F.when(key % 5 == 0, 4).otherwise(1).alias("parts"), F.when(key % 5 != 0, 1).alias("part"))
    stored = orders.where(key % 3 != 2).select(key.alias("job_id"), F.concat(F.lit("run"), F.when(key % 3 == 0, key % 10).otherwise(99).cast("string")).alias("source"))
    return R.resume_jobs(wanted, stored)
