"""Groups too large for one task give the same results as ordinary ones."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions.fields import page_status
from foliant.operators import books, delivery, reports, sampling, segments, skew
from foliant.plans import derived

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def both(spark, build):
    """The result with ordinary settings and with every group above 20 rows split."""
    plain = rows(build())
    spark.conf.set("foliant.hotRows", "20")
    try:
        return plain, rows(build())
    finally:
        spark.conf.unset("foliant.hotRows")


def skewed(spark):
    """Derived pages with a third of them scans of one log number."""
    pages = derived.pages(spark, FOLDER)
    same = pages["log_number"].withField("value", F.lit("2000010"))
    return pages.withColumn("log_number", F.when(F.col("page_number") % 3 == 0, same).otherwise(F.col("log_number")))


@pytest.mark.parametrize("build", [
    lambda p: books.mark_duplicates(p).select("page_number", "dup"),
    lambda p: books.duplicate_groups(p),
    lambda p: books.book_vote(p, derived.PAGE_FIELDS).select("page_number", "matricula", "status", "vote_change"),
    lambda p: delivery.split_parts(delivery.delivery_sequence(p, ("avion",)), 30).select("part", "part_pos", "separator", "page_number"),
], ids=["duplicates", "groups", "vote", "parts"])
def test_hot_groups(spark, build):
    pages = skewed(spark)
    plain, split = both(spark, lambda: build(pages))
    assert plain == split and plain


@pytest.mark.parametrize("limit", ["20", "100000"])
def test_neighbours_across_segments(spark, limit):
    """Groups of 370 and 10 rows, cut or whole."""
    spark.conf.set("foliant.hotRows", limit)
    try:
        df = spark.range(380).select(F.when(F.col("id") < 370, "large").otherwise("small").alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
        books = segments.segmented(df, "g", ["o"])
        assert books.cut == (limit == "20") and books.rows.count() == 380
        got = books.nearest(before={"p": F.col("v")}, after={"n": F.col("v")}).attach(df.groupBy("g").agg(F.sum("v").alias("total"))).rows.collect()
    finally:
        spark.conf.unset("foliant.hotRows")
    known = {"large": range(0, 370, 7), "small": range(371, 380, 7)}
    assert {r.o: (r.p, r.n, r.total) for r in got} == {
        o: (max((v for v in known[g] if v < o), default=None), min((v for v in known[g] if v > o), default=None), sum(known[g])) for o in range(380) for g in ["large" if o < 370 else "small"]}


@pytest.mark.parametrize("most", [1, 2, 7, 30])
def test_sections_pack_the_same_in_any_number_of_ranges(spark, most):
    rng = random.Random(most)
    sections, start = [], 1
    for _ in range(300):
        size = rng.choice([1, 2, 3, 5, rng.randint(1, 3 * most)])
        sections.append((start, size, rng.random() < 0.5))
        start += size
    df = spark.createDataFrame(sections, "start long, size long, header boolean").repartition(3)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("1", "4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got.append({r.start: (r.first_part, r.base) for r in delivery.pack_sections(df, most).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    # One section after the other, on one open part.
    part, used, plain = 1, 0, {}
    for start, size, header in sections:
        if size > most:
            part += used > 0
            plain[start] = (part, 0)
            repeat = header and most > 1
            left = size - header
            room = most - repeat
            while left > room:
                left, part = left - room, part + 1
            used = left + repeat
        else:
            if used and used + size > most:
                part, used = part + 1, 0
            plain[start] = (part, used)
            used += size
    assert got == [plain] * 3


def test_positions_number_every_row_once(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("o")).repartition(7)
    got = {r["o"]: r["pos"] for r in skew.positions(df, ["o"]).collect()}
    assert got == {o: o + 1 for o in range(1000)}


def test_vote_needs_a_number_somebody_read(spark):
    """Mixing positions gives 1112, which nobody read: the heaviest whole reading wins."""
    base = derived.pages(spark, FOLDER).where("page_number = 2").drop("log_number", "matricula", "page_number")
    reads = spark.createDataFrame([(1, "2000001", "HP-1111CMP", 0.9), (2, "2000002", "HP-1222CMP", 0.8), (3, "2000003", "HP-2112CMP", 0.8)], "page_number long, log string, reg string, conf double")
    def field(value, conf):
        return F.struct(F.lit("ocr").alias("field_type"), value.alias("value"), value.alias("raw_value"), conf.alias("confidence"), F.lit("OK").alias("status"), F.lit("OK").alias("comment"),
                        F.lit("ocr").alias("source"), F.lit(None).cast("string").alias("inference_method"), F.array().cast("array<string>").alias("alternatives"))
    pages = reads.join(F.broadcast(base)).withColumn("log_number", field(F.col("log"), F.lit(0.9))).withColumn("matricula", field(F.col("reg"), F.col("conf")))
    winner = books.book_votes(books.with_books(pages)).first()
    assert (winner["winner"], winner["readers"], winner["winner_confidence"]) == ("HP-1111CMP", 1, 0.9)


def test_random_sample_is_repeatable_and_checked(spark):
    pages = derived.pages(spark, FOLDER)
    assert rows(sampling.random_sample(pages, 9, 3).select("page_number")) == rows(sampling.random_sample(pages.repartition(3), 9, 3).select("page_number"))
    with pytest.raises(Exception, match="fewer pages"):
        sampling.random_sample(pages, 10**6, 3).collect()


@pytest.mark.parametrize("text,expected", [("5", (5, 5)), ("2-9", (2, 9)), ("4-", (4, None)), ("-7", (1, 7)), (" 3:8 ", (3, 8))])
def test_page_ranges(text, expected):
    assert sampling.parse_page_range(text) == expected


@pytest.mark.parametrize("text", ["", "x", "0", "9-2", "-0"])
def test_bad_page_ranges(text):
    with pytest.raises(ValueError):
        sampling.parse_page_range(text)


def test_blank_page_is_an_error(spark):
    status = derived.pages(spark, FOLDER).where("blank").select(page_status(derived.PAGE_FIELDS).alias("s")).distinct().collect()
    assert [r["s"] for r in status] == ["ERROR"]


def test_output_columns_follow_the_template():
    assert reports.output_columns({"log_number": "ocr", "pilot_signature": "signature"}) == [
        "file", "page", "log_number", "dup", "disc", "log_number_conf", "log_number_status", "log_number_comment", "log_number_source",
        "pilot_signature", "pilot_signature_conf", "pilot_signature_source", "date", "time_ms"]
    assert reports.output_columns({"x": "ocr"})[-4:] == ["dup", "disc", "date", "time_ms"]
