"""Index records, remote batches and the plan of what would be written to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.constants import (AUDIT_STATUS, DEFAULT_FLEET, DOC_TYPE, DONE_STAGES, FIELD_AUDIT_STATUS, FIELD_BATCH_NAME, FIELD_DOC_TYPE,
                               FIELD_END_DATE, FIELD_FLEET, FIELD_LESSOR, FIELD_LOG_NUMBER, FIELD_REGISTRATION, FLEET_PREFIXES,
                               MANDATORY_FIELDS, MONTH_NAMES_EN, STAGES, STATE_VALID)
from foliant.functions.dates import remote_date
from foliant.functions.registrations import index_log_number, index_registration
from foliant.functions.text import base_name, comparable_name
from foliant.operators.skew import join_groups, positions
from foliant.session import save_rows

RECORD = ["seq", "file", "page", "separator", "registration", "log_number", "date", "fleet", "lessor", "fleet_inferred", "dup", "disc", "missing_row"]


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def resolve_fleet(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Fleet and lessor of each registration: from the cache, else by prefix and marked inferred.

    ``cache`` is keyed by canonical registration (two prefixes, four digits, three suffixes:
    at most 60,000 rows), so it is broadcast.
    """
    known = (cache.select(index_registration(F.col("registration")).alias("registration"), F.col("fleet").alias("_fleet"), F.col("lessor").alias("_lessor"))
             .where("registration <> ''").groupBy("registration").agg(F.max_by("_fleet", F.length("_fleet")).alias("_fleet"), F.max("_lessor").alias("_lessor")))
    joined = records.drop("fleet", "lessor", "fleet_inferred").join(F.broadcast(known), "registration", "left")
    reg, cached = F.col("registration"), F.coalesce(F.col("_fleet"), F.lit("")) != ""
    rule = reduce(lambda acc, p: acc.when(reg.startswith(p[0]), p[1]), FLEET_PREFIXES[1:], F.when(reg.startswith(FLEET_PREFIXES[0][0]), FLEET_PREFIXES[0][1]))
    return joined.select(
        *[c for c in joined.columns if c not in ("_fleet", "_lessor")],
        F.when(reg == "", "").when(cached, F.col("_fleet")).otherwise(rule.otherwise(DEFAULT_FLEET)).alias("fleet"),
        F.when((reg != "") & cached, F.coalesce(F.col("_lessor"), F.lit(""))).otherwise("").alias("lessor"),
        ((reg != "") & ~cached).alias("fleet_inferred"))


def _values(rows: DataFrame) -> DataFrame:
    """Report columns -> index values."""
    return rows.select(
        *[c for c in rows.columns if c not in ("matricula", "log_number", "date", "dup", "disc")],
        index_registration(F.col("matricula")).alias("registration"), index_log_number(F.col("log_number")).alias("log_number"),
        _text("date").alias("date"), (F.lower(_text("dup")) == "true").alias("dup"), (F.lower(_text("disc")) == "true").alias("disc"))


def _last_row_per_page(csv: DataFrame) -> DataFrame:
    """The last CSV row (by ``row``) of each (file, page)."""
    keyed = csv.withColumn("file", _text("file")).withColumn("page", _text("page").try_cast("long")).where("page is not null")
    names = ["matricula", "log_number", "date", "dup", "disc"]
    return keyed.groupBy("file", "page").agg(F.max_by(F.struct(*names), "row").alias("r")).select("file", "page", "r.*")


def records_from_delivery(csv: DataFrame, index: DataFrame, cache: DataFrame) -> DataFrame:
    """One record per delivery entry (``seq, separator, file, page``), in delivery order.

    Separators keep their place; a page missing from the report keeps its record, marked.
    """
    entries = index.select("seq", F.trim(F.coalesce("separator", F.lit(""))).alias("separator"), _text("file").alias("file"),
                           F.coalesce(_text("page").try_cast("long"), F.lit(0)).alias("page"))
    rows = _last_row_per_page(csv).withColumn("_found", F.lit(True))
    is_page = F.col("separator") == ""
    # Separators name no page: joined, they would all meet under one key.
    joined = _values(entries.where(is_page).join(rows, ["file", "page"], "left").unionByName(entries.where(~is_page), allowMissingColumns=True))
    blank = {"registration": "", "log_number": "", "date": ""}
    cleared = joined.select(
        "seq", F.when(is_page, F.col("file")).otherwise("").alias("file"), F.when(is_page, F.col("page")).otherwise(0).alias("page"), "separator",
        *[F.when(is_page & F.col("_found"), F.col(c)).otherwise(v).alias(c) for c, v in blank.items()],
        *[F.coalesce(is_page & F.col("_found") & F.col(c), F.lit(False)).alias(c) for c in ("dup", "disc")],
        (is_page & F.col("_found").isNull()).alias("missing_row"))
    return resolve_fleet(cleared, cache).select(*RECORD)


def is_blank_row() -> Column:
    return (F.col("registration") == "") & (F.col("log_number") == "") & (F.col("date") == "")


def records_from_csv(csv: DataFrame, cache: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Records in report order, or in the given page order (``pos, file, page``); empty rows are dropped."""
    if order is not None:
        chosen = order.select("pos", "file", "page").join(_last_row_per_page(csv), ["file", "page"])
    else:
        chosen = csv.select(F.col("row").alias("pos"), _text("file").alias("file"), F.coalesce(_text("page").try_cast("long"), F.lit(0)).alias("page"),
                            "matricula", "log_number", "date", "dup", "disc")
    kept = _values(chosen).where(~is_blank_row())
    numbered = positions(kept, ["pos"], "seq").drop("pos").withColumn("separator", F.lit("")).withColumn("missing_row", F.lit(False))
    return resolve_fleet(numbered, cache).select(*RECORD)


def learn_fleet(cache: DataFrame, remote: DataFrame) -> DataFrame:
    """Cache updated with what the remote pages (``seq, registration, fleet, lessor``) confirm.

    The last non-empty pair wins; an empty lessor does not erase a known one.
    """
    seen = remote.select("seq", index_registration(F.col("registration")).alias("registration"), _text("fleet").alias("fleet"), _text("lessor").alias("lessor"))
    learned = seen.where("registration <> '' and fleet <> ''").groupBy("registration").agg(
        F.max_by("fleet", "seq").alias("new_fleet"), F.max_by("lessor", F.when(F.col("lessor") != "", F.col("seq"))).alias("new_lessor"))
    old = cache.select(index_registration(F.col("registration")).alias("registration"), "fleet", "lessor").where("registration <> ''")
    return old.join(learned, "registration", "full").select(
        "registration", F.coalesce("new_fleet", "fleet").alias("fleet"), F.coalesce("new_lessor", "lessor", F.lit("")).alias("lessor"))


def correct_inferred_fleet(records: DataFrame, learned: DataFrame) -> DataFrame:
    """Replace inferred fleets that the learned cache now confirms."""
    known = learned.where("fleet <> ''").select("registration", F.col("fleet").alias("_fleet"), F.col("lessor").alias("_lessor"))
    joined = records.join(F.broadcast(known), "registration", "left")
    fix = F.col("fleet_inferred") & (F.col("separator") == "") & F.col("_fleet").isNotNull()
    return (joined.withColumn("_fix", F.coalesce(fix, F.lit(False)))
            .withColumn("lessor", F.when(F.col("_fix") & (F.col("lessor") == ""), F.coalesce("_lessor", F.lit(""))).otherwise(F.col("lessor")))
            .withColumn("fleet", F.when(F.col("_fix"), F.col("_fleet")).otherwise(F.col("fleet")))
            .withColumn("fleet_inferred", F.col("fleet_inferred") & ~F.col("_fix")).select(*records.columns))


def _notice(seq: Column, code: str, detail: Column | str) -> Column:
    return F.struct(seq.alias("seq"), F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _with_picklist(records: DataFrame, picklist: DataFrame) -> DataFrame:
    """Add ``_unlisted``, the notice of ``check_picklist`` or null."""
    listed = (picklist.select(F.upper(F.trim("value")).alias("registration")).where(F.col("registration").rlike(r"^(HP|HK)-\d{4}(CMP|WWP)?$"))
              .distinct().withColumn("_listed", F.lit(True)))
    any_listed = picklist.where(F.trim("value") != "").agg(F.count("*") > 0).scalar()
    joined = records.join(F.broadcast(listed), "registration", "left")
    reg = F.col("registration")
    notice = (F.when(reg == "", _notice(F.col("seq"), "matricula_vacia", "no se pudo leer la matricula"))
              .when(any_listed & F.col("_listed").isNull(), _notice(F.col("seq"), "matricula_desconocida", F.concat(reg, F.lit(" no esta en el picklist del indice remoto")))))
    return joined.withColumn("_unlisted", F.when(F.col("separator") == "", notice)).drop("_listed")


def check_picklist(records: DataFrame, picklist: DataFrame) -> DataFrame:
    """Notices for empty registrations and for those missing from a non-empty picklist (``value``).

    The picklist is a form's drop-down; it is matched on canonical registrations, of which
    there are at most 60,000.
    """
    return _with_picklist(records, picklist).where("_unlisted is not null").select("_unlisted.*")


def _repeated_logs(records: DataFrame) -> DataFrame:
    """Log numbers of more than one record, with the first; saved, since the join reads them several times."""
    logged = records.where("separator = '' and log_number <> ''")
    return save_rows(logged.groupBy("log_number").agg(F.min("seq").alias("first_seq"), F.count("*").alias("_rows")).where("_rows > 1"))


def _with_duplicates(records: DataFrame) -> DataFrame:
    """Add ``_repeats``, the notice of ``check_record_duplicates`` or null."""
    # Records without a number, and separators, get scattered keys that match nothing.
    key = F.when((F.col("separator") == "") & (F.col("log_number") != ""), F.col("log_number"))
    keyed = records.withColumn("_key", F.coalesce(key, F.concat(F.lit(" "), F.pmod(F.xxhash64("seq"), F.lit(1_000_003)).cast("string"))))
    joined = join_groups(keyed, _repeated_logs(records).withColumnRenamed("log_number", "_key"), ["_key"], ["seq"], rows_in="_rows")
    detail = F.concat(F.lit("el log "), "log_number", F.lit(" ya salio en la pagina "), F.col("first_seq").cast("string"))
    notice = F.when(F.col("seq") > F.col("first_seq"), _notice(F.col("seq"), "log_duplicado", detail))
    return joined.withColumn("_repeats", notice).drop("_key", "first_seq", "_rows")


def check_record_duplicates(records: DataFrame) -> DataFrame:
    """Notice on every later record of a log number, naming the first."""
    return _with_duplicates(records.select("seq", "separator", "log_number")).where("_repeats is not null").select("_repeats.*")


def index_values(batch_name: str = "") -> Column:
    """{field id: value} sent for a record; lessor and batch name only when there is one."""
    pairs = ((FIELD_DOC_TYPE, F.lit(DOC_TYPE)), (FIELD_REGISTRATION, F.col("registration")), (FIELD_FLEET, F.col("fleet")),
             (FIELD_LOG_NUMBER, F.col("log_number")), (FIELD_AUDIT_STATUS, F.lit(AUDIT_STATUS)), (FIELD_END_DATE, remote_date(F.col("date"))),
             (FIELD_LESSOR, F.col("lessor")), (FIELD_BATCH_NAME, F.lit(batch_name)))
    full = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    return F.map_filter(full, lambda k, v: ~k.isin(FIELD_LESSOR, FIELD_BATCH_NAME) | (v != ""))


def _alignment_notices(overwrite: bool) -> list[Column]:
    """Notices from comparing a record with its remote page (``state``, ``values``)."""
    seq, values = F.col("seq"), F.col("remote_values")
    log = F.trim(F.coalesce(F.try_element_at(values, F.lit(FIELD_LOG_NUMBER)), F.lit("")))
    reg = F.trim(F.coalesce(F.try_element_at(values, F.lit(FIELD_REGISTRATION)), F.lit("")))
    own_log, own_reg = F.col("log_number"), F.col("registration")
    found = F.col("state").isNotNull()
    notices = [
        F.when(~found, _notice(seq, "no_cargo", F.concat(F.lit("el indice remoto no devolvio la pagina "), F.col("batch_page").cast("string"), F.lit(": sin respuesta")))),
        F.when(found & (log != "") & (own_log != "") & (log != own_log),
               _notice(seq, "desalineado", F.concat(F.lit("el indice remoto tiene el log "), log, F.lit(" y el manifiesto "), own_log))),
        F.when(found & (reg != "") & (own_reg != "") & (F.upper(reg) != F.upper(own_reg)) & (log == ""),
               _notice(seq, "matricula_distinta", F.concat(F.lit("el indice remoto tiene "), reg, F.lit(" y el manifiesto "), own_reg)))]
    if not overwrite:
        notices.append(F.when(F.col("state") == STATE_VALID, _notice(seq, "ya_indexada", "la pagina ya esta en Valid; usar --sobrescribir para pisarla")))
    return notices


def _with_remote(records: DataFrame, remote: DataFrame) -> DataFrame:
    return records.withColumn("batch_page", F.col("seq")).join(
        remote.select(F.col("page").alias("batch_page"), "state", F.col("values").alias("remote_values")), "batch_page", "left")


def check_alignment(records: DataFrame, remote: DataFrame, overwrite: bool = False) -> DataFrame:
    """Notices from comparing each record with the remote page at its position."""
    joined = _with_remote(records.where("separator = ''"), remote)
    return joined.select(F.explode(F.array_compact(F.array(*_alignment_notices(overwrite)))).alias("n")).select("n.*")


def plan_pages(records: DataFrame, remote: DataFrame, picklist: DataFrame, cache: DataFrame, remote_pages: int | Column | None = None,
               upload_only: bool = False, overwrite: bool = False, batch_name: str = "") -> DataFrame:
    """What would be written per page, with the notices that block it.

    Fails when the batch and the records differ in size (``remote_pages``, separators included).
    """
    is_page = F.col("separator") == ""
    if remote_pages is not None:
        expected = F.lit(remote_pages) if isinstance(remote_pages, int) else remote_pages
        wrong = records.agg(F.count("*")).scalar() != expected
        records = records.where(F.when(wrong, F.raise_error(F.lit("batch and records differ in pages"))).otherwise(F.lit(True)))
    no_values = F.create_map().cast("map<int,string>")
    no_notices = F.array().cast("array<struct<seq:bigint,code:string,detail:string>>")
    if upload_only:
        manual = F.array(_notice(F.col("seq"), "revisar_a_mano", "sin avion confirmado; se indexa a mano en el indice remoto"))
        planned = records.withColumn("batch_page", F.col("seq")).withColumn("values", no_values).withColumn(
            "notices", F.when(is_page, manual).otherwise(no_notices)).withColumn("already_indexed", F.lit(False))
    else:
        reg = remote.select(F.col("page").alias("seq"), *[F.try_element_at("values", F.lit(k)).alias(n) for k, n in (
            (FIELD_REGISTRATION, "registration"), (FIELD_FLEET, "fleet"), (FIELD_LESSOR, "lessor"))])
        read = records.where(is_page).select("seq")
        # The duplicates depend on log numbers alone, which the fleet's correction leaves as they are.
        noticed = _with_picklist(_with_duplicates(records), picklist)
        fixed = correct_inferred_fleet(noticed, learn_fleet(cache, reg.join(read, "seq", "left_semi")))
        joined = _with_remote(fixed, remote).withColumn("values", F.when(is_page, index_values(batch_name)).otherwise(no_values))
        empty = [F.when(F.trim(F.coalesce(F.try_element_at("values", F.lit(f)), F.lit(""))) == "",
                        _notice(F.col("seq"), "obligatorio_vacio", f"el campo {f} quedaria vacio")) for f in MANDATORY_FIELDS]
        own = F.array_compact(F.array("_unlisted", "_repeats", *empty, *_alignment_notices(overwrite)))
        planned = joined.withColumn("notices", F.when(is_page, own).otherwise(no_notices)).withColumn(
            "already_indexed", is_page & F.coalesce(F.col("state") == STATE_VALID, F.lit(False))).drop("_unlisted", "_repeats", "state", "remote_values")
    return planned.withColumn("action", F.when(~is_page, "separador").when(F.size("notices") == 0, "escribir").otherwise("bloqueada"))


def plan_rows(plan: DataFrame) -> DataFrame:
    """Review projection of a plan."""
    def value(field: int) -> Column:
        return F.coalesce(F.try_element_at("values", F.lit(field)), F.lit(""))

    notices = F.transform("notices", lambda n: F.concat(F.lit("["), n["code"], F.lit("] pagina "), n["seq"].cast("string"), F.lit(": "), n["detail"]))
    return plan.select(
        F.col("batch_page").alias("pagina_lote"), "seq", F.col("file").alias("archivo_origen"), F.col("page").alias("pagina_origen"),
        value(FIELD_DOC_TYPE).alias("doc_type"), F.when(F.col("separator") != "", F.col("separator")).otherwise(value(FIELD_REGISTRATION)).alias("matricula"),
        value(FIELD_FLEET).alias("fleet"), F.when(F.col("fleet_inferred"), "si").otherwise("").alias("fleet_inferido"),
        value(FIELD_LOG_NUMBER).alias("log_number"), value(FIELD_AUDIT_STATUS).alias("audit_status"), value(FIELD_END_DATE).alias("end_date"),
        F.when(F.col("already_indexed"), "si").otherwise("").alias("ya_indexada"), F.col("action").alias("accion"), F.array_join(notices, " | ").alias("avisos"))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("total"), F.count_if(F.col("action") == "escribir").alias("writable"),
                    F.count_if(F.col("action") == "bloqueada").alias("blocked"), F.count_if(F.col("action") == "separador").alias("separators"))


def blocked_reasons(plan: DataFrame) -> DataFrame:
    """Notice codes of the blocked pages, most frequent first."""
    return (plan.where("action = 'bloqueada'").select(F.explode("notices").alias("n")).groupBy(F.col("n.code").alias("code"))
            .agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "code"))


def apply_outcomes(plan: DataFrame, outcomes: DataFrame, stop_on_error: bool = True) -> DataFrame:
    """Record states after a write run. ``outcomes``: ``seq, result`` (ok, error, connection), ``message``.

    A connection failure always stops the run, a page error when asked to; what comes later
    stays pending.
    """
    results = outcomes.select("seq", "result", F.coalesce("message", F.lit("")).alias("message"))
    joined = plan.join(results, "seq", "left")
    attempted = (F.col("action") == "escribir") & (F.col("state") != "escrita")
    stops = attempted & F.col("result").isin(*(("connection", "error") if stop_on_error else ("connection",)))
    cutoff = joined.agg(F.min(F.when(stops, F.col("seq")))).scalar()
    reached = cutoff.isNull() | (F.col("seq") <= cutoff)
    state = (F.when(~reached | (F.col("action") == "separador"), F.col("state")).when(F.col("action") == "bloqueada", "omitida")
             .when(~attempted, F.col("state")).when(F.col("result") == "ok", "escrita").when(F.col("result") == "error", "error").otherwise(F.col("state")))
    texts = F.transform("notices", lambda n: F.concat(F.lit("["), n["code"], F.lit("] pagina "), n["seq"].cast("string"), F.lit(": "), n["detail"]))
    notes = (F.when(reached & (F.col("action") == "bloqueada"), F.array_join(texts, " | "))
             .when(reached & attempted & (F.col("result") == "error"), F.concat(F.lit("[error_escritura] "), "message")).otherwise(""))
    outcome = (F.when(~reached | (F.col("action") == "separador"), "").when(F.col("action") == "bloqueada", "omitida").when(~attempted, "omitida")
               .when(F.col("result") == "ok", "escrita").when(F.col("result") == "error", "fallida").otherwise(""))
    return joined.select("seq", state.alias("state"), notes.alias("notes"), outcome.alias("outcome"))


def verify_written(records: DataFrame, remote: DataFrame) -> DataFrame:
    """Counts after reading the batch back: valid, checked, unreadable and in another state."""
    joined = _with_remote(records.where("separator = ''"), remote)
    return joined.agg(F.count_if(F.col("state") == STATE_VALID).alias("valid"), F.count("*").alias("checked"),
                      F.count_if(F.col("state").isNull()).alias("unreadable"), F.count_if(F.col("state") != STATE_VALID).alias("other_state"))


def manifest_summary(records: DataFrame) -> DataFrame:
    """Counts over records with ``state`` and ``notes``."""
    page = F.col("separator") == ""
    return records.agg(F.count("*").alias("records"), F.count_if(~page).alias("separators"), F.count_if(page & (F.col("state") == "pendiente")).alias("pending"),
                       F.count_if(F.col("state") == "escrita").alias("written"), F.count_if(F.col("notes") != "").alias("with_notices"),
                       F.count_if(F.col("state") == "error").alias("errors"))


def match_batches(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """Remote batch of each job (``job_id, name, repo_id, pages``): exact names before names
    without the uploader's suffix, page count as tie-break, otherwise ambiguous or not found."""
    target = comparable_name(F.col("name"))
    wanted = jobs.select("job_id", target.alias("key"), F.col("repo_id").alias("want_repo"), F.col("pages").alias("want_pages")).where("key <> ''")
    names = listing.select("batch_id", "repo_id", "pages", target.alias("own"), comparable_name(base_name(F.col("name"))).alias("stem"))
    keyed = names.select("*", F.explode(F.array_compact(F.array(
        F.struct(F.col("own").alias("key"), F.lit(True).alias("exact")),
        F.when(F.col("stem") != F.col("own"), F.struct(F.col("stem").alias("key"), F.lit(False).alias("exact")))))).alias("k")).select("batch_id", "repo_id", "pages", "k.*")
    # Aggregated per name first: a name that many batches share stays one row.
    options = keyed.groupBy("key", "exact", "repo_id", "pages").agg(F.count("*").alias("n"), F.min("batch_id").alias("batch_id"))
    joined = wanted.join(options, "key").where(F.col("want_repo").isNull() | (F.col("repo_id") == 0) | (F.col("repo_id") == F.col("want_repo")))
    same = F.coalesce(F.col("pages") == F.col("want_pages"), F.lit(False))

    def tally(cond: Column) -> Column:
        return F.struct(F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias("n"), F.min(F.when(cond, F.col("batch_id"))).alias("batch_id"))

    exact = F.col("exact")
    found = joined.groupBy("job_id").agg(tally(exact).alias("e"), tally(exact & same).alias("ep"), tally(~exact).alias("s"), tally(~exact & same).alias("sp"))

    def narrowed(all_, paged) -> Column:
        return F.when((all_["n"] > 1) & (paged["n"] > 0), paged).otherwise(all_)

    picked = found.withColumn("_p", F.when(F.col("e")["n"] > 0, narrowed(F.col("e"), F.col("ep"))).otherwise(narrowed(F.col("s"), F.col("sp"))))
    return jobs.select("job_id").join(picked, "job_id", "left").select(
        "job_id", F.when(F.col("_p").isNull(), "none").when(F.col("_p")["n"] > 1, "ambiguous").otherwise("found").alias("match"),
        F.when(F.col("_p")["n"] == 1, F.col("_p")["batch_id"]).alias("batch_id"), F.coalesce(F.col("_p")["n"], F.lit(0)).alias("candidates"))


def batch_names(parts: DataFrame, prefix: str = "LOTE") -> DataFrame:
    """Batch name of each part (``path, moment, number, total, is_review``): the time stamp of the
    run's path, or else the given moment; upper case with single spaces."""
    pattern = r"(?i)(\d{1,2})\s+(" + "|".join(MONTH_NAMES_EN) + r")\s+(\d{4})\s+(\d{2})\s+(\d{2})"

    def piece(i: int) -> Column:
        return F.regexp_extract("path", pattern, i)

    stamped = F.concat_ws(" ", F.lpad(piece(1), 2, "0"), F.upper(piece(2)), piece(3), piece(4), piece(5))
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES_EN]), F.month("moment"))
    clock = F.concat_ws(" ", F.date_format("moment", "dd"), month, F.date_format("moment", "yyyy HH mm"))
    base = F.concat(F.lit(prefix.strip() + " "), F.when(piece(1) != "", stamped).otherwise(clock))
    tail = F.when(F.col("is_review"), " REVISAR").when(F.col("total") > 1, F.concat(F.lit(" -"), F.col("number").cast("string"))).otherwise("")
    return parts.withColumn("batch_name", F.trim(F.regexp_replace(F.upper(F.concat(base, tail)), r"\s+", " ")))


def stage_status(stages: DataFrame) -> DataFrame:
    """Per job and stage (``job_id, stage, state``): done flag, and whether all earlier stages are."""
    done = F.col("state").isin(*DONE_STAGES)
    # Six stages per job.
    per_job = stages.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", done.alias("done")))).alias("_d"))
    rows = [F.struct(F.lit(s).alias("stage"), F.lit(i).alias("stage_no"), F.coalesce(F.try_element_at("_d", F.lit(s)), F.lit(False)).alias("done"),
                     reduce(lambda a, b: a & b, [F.coalesce(F.try_element_at("_d", F.lit(p)), F.lit(False)) for p in STAGES[:i]], F.lit(True)).alias("ready"),
                     F.lit(",".join(STAGES[:i])).alias("earlier")) for i, s in enumerate(STAGES)]
    return per_job.select("job_id", F.explode(F.array(*rows)).alias("s")).select("job_id", "s.*")


def resume_jobs(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Reuse a stored job (``job_id, source``) only when it belongs to the same run; a run in several
    parts cannot be prepared without naming the part (``parts, part``)."""
    joined = wanted.join(stored.select("job_id", F.col("source").alias("_stored")), "job_id", "left")
    same = F.coalesce(F.col("_stored") == F.col("source"), F.lit(False))
    decision = (F.when(same, "reuse").when(F.col("part").isNull() & (F.col("parts") > 1), "needs_part")
                .when(F.col("_stored").isNotNull(), "rebuild").otherwise("new"))
    return joined.withColumn("decision", decision).drop("_stored")
