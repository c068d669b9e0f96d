"""Logbook tables derived from the given star-schema tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.constants import ERROR, OK, SIGNATURE_FIELDS, WARNING, WWP_NUMBERS
from foliant.functions.dates import month_name
from foliant.functions.fields import MEMBERS, READING

PAGE_FIELDS = {"log_number": "ocr", "matricula": "ocr", "day": "ocr", "month": "ocr", "year": "ocr",
               **{f: "signature" for f in SIGNATURE_FIELDS}}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Rows of one task: a page is some hundred times as wide as the order it is derived from.
TASK_ROWS = 100_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores, and tasks of a bounded number of rows, on inputs of a few file splits; others are left as they are read."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() < tasks else df


def _reading(field_type: str, value: Column, confidence: Column, raw: Column | None = None,
             alternatives: Column | None = None, source: str = "ocr") -> Column:
    low = confidence < 0.5
    status = F.when(value.isNull(), ERROR).when(low & F.lit(field_type != "signature"), WARNING).otherwise(OK)
    comment = (F.when(value.isNull(), "Required field empty")
               .when(status == WARNING, F.concat(F.lit("Low confidence ("), F.format_number(confidence, 2), F.lit(")"))).otherwise("OK"))
    members = {"field_type": F.lit(field_type), "value": value, "raw_value": value if raw is None else raw,
               "confidence": confidence, "status": status, "comment": comment, "source": F.lit(source),
               "inference_method": F.lit(None), "alternatives": F.array() if alternatives is None else alternatives}
    return F.struct(*[members[m].cast(READING[m].dataType).alias(m) for m in MEMBERS])


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per scanned page, with a struct column per field."""
    k = F.col("k")
    orders = spread(table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 20).alias("file_seq")), "k")
    b, s = F.floor(k / 40), k % 40
    base = orders.select("*", b.alias("b"), s.alias("s"))
    b, s = F.col("b"), F.col("s")
    twin = F.when((k % 97 == 5) & (s > 0), s - 1).otherwise(s)
    printed = (20000 + F.floor(b / 2)) * 100 + (b % 2) * 50 + twin
    log = F.when(k % 13 != 0, F.lpad(printed.cast("string"), 7, "0"))
    true = 1000 + (b * 37) % 9000
    read = F.when(k % 11 == 3, true - true % 10 + (true % 10 + 1) % 10).otherwise(true).cast("string")
    date = F.date_add(F.to_date(F.lit("2024-01-01")), (b % 600 + F.floor(s / 3)).cast("int"))
    base = base.select("*", log.alias("log"), F.when(k % 13 != 0, printed).cast("long").alias("printed_number"), true.alias("true_number"), read.alias("n"), date.alias("d"))
    n, d = F.col("n"), F.col("d")
    registration = F.concat(F.lit("HP-"), n, F.when(n.isin(*WWP_NUMBERS), "WWP").otherwise("CMP"))
    raw = (F.when(k % 10 == 7, F.concat(F.lit("hp "), n, F.lit(" cmp")))
           .when(k % 10 == 8, F.concat(F.lit("HP-"), F.translate(n, "1", "I"), F.lit("CMP")))
           .when(k % 10 == 9, F.concat(F.lit("HP "), F.substring(n, 1, 1), F.lit("X"), F.substring(n, 2, 2), F.lit("Y"), F.substring(n, 4, 1)))
           .otherwise(F.concat(F.lit("HP-"), n, F.lit("CMP"))))
    read_day = k % 19 != 2
    true_day = F.lpad(F.day(d).cast("string"), 2, "0")
    other_day = F.lpad((F.day(d) % 28 + 1).cast("string"), 2, "0")

    def turn(i: int) -> Column:
        return (F.floor(k / (2 * i)) + i) % 10

    values = base.select(
        "k", "file_seq", "printed_number", F.col("log").alias("v_log_number"),
        F.when(k % 17 != 4, registration).alias("v_matricula"), F.when(k % 17 != 4, raw).alias("raw"),
        F.when(read_day, F.when(k % 31 == 9, other_day).otherwise(true_day)).alias("v_day"),
        F.when((k % 31 == 9) & read_day, F.array(true_day)).otherwise(F.array().cast("array<string>")).alias("other_days"),
        F.when(k % 23 != 7, month_name(F.month(d))).alias("v_month"),
        F.when(k % 37 != 5, F.lpad(((F.year(d) + F.when(k % 29 == 11, 3).otherwise(0)) % 100).cast("string"), 2, "0")).alias("v_year"),
        *[((25 + (k * 7 + 13 * i) % 76) / F.lit(100.0)).alias(f"c_{i}") for i in range(5)],
        *[F.when(turn(i) == 0, "unclear").when(turn(i) <= 2, "false").otherwise("true").alias(f"v_{f}")
          for i, f in enumerate(SIGNATURE_FIELDS, 1)],
        *[((20 + (k * 3 + 5 * i) % 80) / F.lit(100.0)).alias(f"s_{i}") for i in range(1, 6)])
    extra = {"matricula": {"raw": F.col("raw")}, "day": {"alternatives": F.col("other_days")}}
    return values.select(
        "file_seq", F.concat(F.lit("scan_"), F.lpad(F.col("file_seq").cast("string"), 2, "0"), F.lit(".pdf")).alias("file"),
        (k + 1).alias("page_number"), "printed_number", (k % 101 == 0).alias("blank"),
        F.when(k % 43 == 6, "low").otherwise("ok").alias("alignment"), F.lit(OK).alias("status"),
        F.lit(None).cast("string").alias("date"), (100 + k % 900).cast("double").alias("processing_ms"),
        *[_reading("ocr", F.col(f"v_{f}"), F.col(f"c_{i}"), **extra.get(f, {})).alias(f)
          for i, f in enumerate(("log_number", "matricula", "day", "month", "year"))],
        *[_reading("signature", F.col(f"v_{f}"), F.col(f"s_{i}"), source="vision").alias(f) for i, f in enumerate(SIGNATURE_FIELDS, 1)])


def fleet(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct registrations of the books whose number is not a multiple of three."""
    b = F.floor(F.col("o_orderkey") / 40)
    number = (1000 + (b * 37) % 9000).cast("string")
    return (table(spark, folder, "orders").where(b % 3 != 0)
            .select(F.concat(F.lit("HP-"), number, F.lit("CMP")).alias("registration")).distinct())
