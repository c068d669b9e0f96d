"""Many small segments are read as sorted streams, not handed over one by one."""

from pyspark.sql import functions as F

from foliant.operators import sequence
from foliant.operators.books import with_books
from foliant.operators.dates import ORDER, decide_years, narrow
from foliant.operators.segments import segmented
from foliant.plans import derived

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_segments_are_streams(spark, monkeypatch):
    made, plain, got = [], sequence._solve_segments, []
    monkeypatch.setattr(sequence, "_solve_segments", lambda df: made.append(plain(df)) or made[-1])
    for limit in ("200000", "7"):
        spark.conf.set("foliant.hotRows", limit)
        try:
            books = decide_years(segmented(narrow(with_books(derived.pages(spark, FOLDER))), "book", ORDER)).saved()
            assert books.cut == (limit == "7")
            got.append(sorted(map(tuple, sequence.sequence_choices(books).select("page_number", "c_day", "c_month", "c_year").collect())))
        finally:
            spark.conf.unset("foliant.hotRows")
    assert got[0] == got[1] and got[0]
    assert len(made) == 1 and "Pandas" not in plan_of(made[0]) and "MapInArrow" in plan_of(made[0])
