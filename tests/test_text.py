"""Text rules on hand-picked readings."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text

FUZZY = "flight number matched against the logbook vocabulary"
CASES = {
    "day": [("21 0", "21"), ("2 0", "20"), ("Z0", "20"), ("32", ""), ("", ""), ("15 JUL", "15"), ("5", "5"), ("123", "")],
    "month": [("JUL", "JUL"), ("JUIL", "JUL"), ("GUL", "JUL"), ("jan", "ENE"), ("JU1", "JUL"), ("50c", ""), ("7", "7"), ("13", ""), ("JTUIC", "JUL"), ("UUC", "")],
    "year": [("Year YR 26", "26"), ("Z6", "26"), ("216", "216"), ("2 0 2 6", "2026"), ("2 6", "26"), ("8313", ""), ("x", "")],
    "flight_number": [("Tek", "TCK"), ("7S8", "758"), ("CMIO3", "CM103"), ("cmloy", "CM104"), ("4C2", "402"), ("SV3", "SV3"), ("000", ""), ("S9V", "SPV"), ("CM 40", "CM40"),
                      ("FLT NO 123", "123"), ("A123", "A123"), ("12345", ""), ("ZCC", ""), ("CMPBA3", "CM843"), ("JCK", "TCK"), ("", "")],
    "date": [("15 jul 26", "2026/07/15"), ("15-07-26", "2026/07/15"), ("07-15-26", "2026/07/15"), ("31/02/26", ""), ("15JUL26", "2026/07/15"), ("x", ""), ("15 jul 1999", "15 jul 1999")],
    "matricula": [("1717", "HP-1717CMP"), ("hp-1717-cmp", "HP-1717CMP"), ("HP-I7I7CMP", "HP-1717CMP"), ("HP-1F17CMP", "HP-1717CMP"), ("GLOB", ""), ("1990", "HP-1990WWP"), ("HP 1X23Y4", "HP-1234CMP")],
    "char": [(" a", "A"), ("9", "9"), ("ñ", ""), ("", "")],
    "digits": [("a1b2", "12"), ("zz", "zz")],
}


@pytest.mark.parametrize("rule", list(CASES))
def test_rule(spark, rule):
    df = spark.createDataFrame(CASES[rule], "raw string, want string")
    got = df.select("raw", "want", text.RULES[rule](F.col("raw"))["value"].alias("got")).collect()
    assert [(r["raw"], r["got"]) for r in got] == [(r["raw"], r["want"]) for r in got]


def test_unknown_rule_keeps_the_text(spark):
    row = spark.range(1).select(text.normalise(F.lit("nope"), F.lit("abc")).alias("r")).first()["r"]
    assert tuple(row) == ("abc", "unknown postprocessor: nope")
