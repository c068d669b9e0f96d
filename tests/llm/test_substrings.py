import hashlib
import random

from pyspark.sql import functions as F

from foliant.llm import substrings
from tests.llm.brute import WORD
from tests.llm.oracle import compare


def brute(rows, window=20):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_words, kept text)}."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall((text or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        out[doc_id] = (len(words), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def agree(spark, rows, window=20):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("spans", F.lit(1)).withColumn("mark", F.lit("x")).withColumn("start", F.lit(2))
    got = substrings.without_repeats(table, window=window).collect()
    wanted = brute(rows, window)
    assert {r.doc_id: (r.n_words, r.text) for r in got} == wanted and len(got) == len(rows)
    assert all(r.n_removed == sum(s.words for s in r.spans) == r.n_words - len(r.text.encode().split()) for r in got)
    return got


def test_whole_table(spark, sf):
    assert compare(spark, sf, "op12_substring_dedup") == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_passages(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choices(words, k=n)) for n in (19, 20, 21, 60, 150)]
    rows = [(i, "\t".join(x for _ in range(rng.randint(0, 4)) for x in (" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(passages)))) for i in range(300)]
    # One hot line in ever new surroundings, copies, loops of few words, and a single very long text.
    rows += [(1000 + i, " ".join(rng.choices(words, k=12)) + " " + passages[0] + " " + " ".join(rng.choices(words, k=12))) for i in range(400)]
    rows += [(2000 + i, passages[4]) for i in range(50)] + [(3000, "a " * 500), (3001, "a " * 500), (3002, "a b " * 100), (3003, " ".join(rng.choices(words, k=60_000)))]
    got = agree(spark, rows)
    assert sum(r.n_removed for r in got) > 10_000


def test_few_words_and_short_windows(spark):
    rng = random.Random(9)
    for window in (4, 5, 7):
        agree(spark, [(i, " ".join(rng.choices("abc", k=rng.randint(0, 25)))) for i in range(120)], window)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "é" * 10), (5, long), (5, long), (5, long + " end"), (None, long), (None, long), (None, "alone")]
    got = substrings.without_repeats(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, runs string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()))
    assert [x[:2] for x in by[1] + by[2] + by[3] + by[4]] == [(0, 0)] * 3 + [(1, 0)]
    # Of id 5 exactly one row keeps the passage, whatever the order of its two texts.
    assert sorted(x[0] for x in by[5]) == [30, 30, 31] and sum(x[1] == 0 for x in by[5]) == 1
    assert sorted(x[:2] for x in by[None]) == [(1, 0), (30, 30), (30, 30)]
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
