import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import quality


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    good = labels == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[x.doc_id].score, x.quality) for x in labels.collect() if got[x.doc_id].held_out]
    scores, truth = np.array([s for s, _ in held]), np.array([q for _, q in held])
    assert auc(scores, truth) > 0.97 and ((scores >= 0.3) == (truth == 1)).mean() > 0.9
    # Labels of held-out rows and other columns change nothing; nor does another run.
    turned = labels.withColumn("quality", F.when(quality.remainder() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None)).repartition(5), turned).collect()
    assert all(got[r.doc_id].score == pytest.approx(r.score, abs=1e-9) for r in again)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(30)) if i % 3 else "!!! " * 20) for i in range(300)]
    odd = [(900, None), (901, ""), (902, " \n"), (None, "ab cd"), (903, "ab cd"), (903, "ab cd"), (904, "ab " * 200_000), (905, "漢字 😀 \x00 é")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (901, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows + odd)
    by = {r.doc_id: r for r in got}
    assert len({by[i].score for i in (900, 901, 902)}) == 1 and by[None].held_out is False
    assert all(by[i].predicted == int(i % 3 > 0) for i in range(300))


def test_no_or_one_class_of_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.score >= 0.5 for r in quality.classify(docs, one).collect())


def test_empty_table(spark):
    assert quality.classify(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect() == []


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 10))
    chance = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < chance).astype(float)
    net = quality.fit(x[:300], y[:300], (x[300:2000], y[300:2000]))
    p = net.scores(x[2000:])
    loss = -np.mean(np.where(y[2000:] > 0, np.log(p), np.log(1 - p)))
    raw = net._replace(temperature=1.0).scores(x[2000:])
    assert net.temperature != 1 and loss < -np.mean(np.where(y[2000:] > 0, np.log(raw), np.log(1 - raw)))


def test_words_beside_other_marks_are_the_words():
    """Typographic quotes, dashes and the like are marks as ASCII ones are."""
    plain, quoted = (quality._slots(t.encode()) for t in ("word", "“word”"))
    assert plain[0] == quoted[0] and quality._slots("¿word".encode()) == plain and len(quality._slots("—".encode())) == 2


def test_features_of_neighbouring_words():
    """Equal words in another order differ in how alike neighbours are."""
    rng = np.random.default_rng(3)
    matrix, weight = rng.normal(size=(quality.SLOTS, quality.DIMENSIONS)).astype(np.float32), rng.uniform(0.1, 1, quality.SLOTS).astype(np.float32)
    one, two = quality.pooled([b"aa bb aa cc", b"aa cc bb aa"], quality.pooling_table(quality.Vectors(matrix, weight)))
    slots = quality.words([b"aa bb aa cc"])[0]
    rows = matrix[slots]
    assert one[-2] == pytest.approx((rows[1:] * rows[:-1]).sum() / 4, rel=1e-4) and one[-2] != pytest.approx(two[-2], rel=1e-4)
    assert quality.DIMENSIONS == 48 and quality.index_vectors()[0].shape == (quality.SLOTS, 4) and one.shape == (2 * 48 + 6,)
