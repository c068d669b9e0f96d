import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import covertree, negatives
from tests.llm.oracle import compare

SCHEMA = "vec_id long, embedding array<double>, label long"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchor, positives=5, most=5, least=(80, 100)):
    held = [(i, [int(np.floor(256.0 * x)) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(held):
        if i is None or not anchor(i):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), j is None, j or 0, j, z) for b, (j, w, z) in enumerate(held) if b != a), key=lambda r: r[:3])
        for score, _, _, j, _ in [r for r in scored if r[4] == y][:positives]:
            fits = [r for r in scored if r[4] != y and least[0] * -score <= least[1] * -r[0] <= least[1] * -score][:most]
            out += [(i, j, n + 1, r[3], -score, -r[0]) for n, r in enumerate(fits)]
    return sorted(out, key=str)


def found(spark, rows, anchor, parts=3):
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("row", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("anchor", F.lit(1))
    return sorted((tuple(r) for r in negatives.hard_negatives(table, anchor).select(*COLUMNS).collect()), key=str)


def test_whole_table(spark, sf):
    assert compare(spark, sf, "op11_hard_negatives") > 0


@pytest.mark.parametrize("spread", [0.05, 0.4, 3.0])
def test_many_cells(spark, monkeypatch, spread):
    """Clusters from tight to none, one label with a third of the rows, repeated vectors (ties), over many small cells."""
    monkeypatch.setattr(negatives, "PIVOTS", 5)
    monkeypatch.setattr(negatives, "DEALT", 200)
    monkeypatch.setattr(negatives, "ROOTS", 7)
    monkeypatch.setattr(negatives, "ASKED", 16)
    plain = negatives.cells
    monkeypatch.setattr(negatives, "cells", lambda rows: plain(rows, 60))
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.normal(size=(9, 6))
    rows = []
    for i in range(1500):
        at = int(rng.integers(9))
        rows.append((i, (centres[at] + rng.normal(size=6) * spread).round(2).tolist(), 1 if i % 3 == 0 else int(rng.integers(4)) if i % 11 == 0 else at))
    rows += [(5000 + i, rows[3][1], 2 + i % 2) for i in range(200)]
    assert found(spark, rows, F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i % 50 == 0)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(60)]
    rows += [(60, None, 1), (61, [1.0, None], 1), (62, [float("nan")] * 4, 1), (63, [float("inf")] * 4, 2), (64, [1.0] * 4, None), (65, [1.0, 2.0], 1), (66, [], 2), (67, [0.0] * 4, 0)]
    rows += [(None, [1.0, 1.0, 0.5, 0.5], 1), (10, rng.normal(size=4).tolist(), 1), (10, [0.0] * 4, 0), (70, [0.3] * 4, 7)]
    assert found(spark, rows, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)
    assert found(spark, [], F.col("vec_id") > 0) == []
    assert found(spark, [(1, [], 1), (2, [], 2), (3, [], 1)], F.col("vec_id") == 1) == [(1, 3, 1, 2, 0, 0)]
    assert found(spark, rows, F.col("vec_id") > 10**6) == []
    # Beyond 2**24 after scaling.
    assert found(spark, [(1, [1e9], 1), (2, [1e12], 1), (3, [1e300], 2)], F.col("vec_id") == 1) == [(1, 2, 1, 3, 1 << 48, 1 << 48)]


def test_descent_skips_what_it_can():
    """In clustered points a query multiplies with few of them, and still gets what all of them give."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 200
    points = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16)) * 8).astype(np.int64)
    names, labels = np.arange(2000), rng.integers(0, 3, 2000)
    tree = covertree.Tree.from_bytes(covertree.build(points, names, names, names < 0, labels).to_bytes())
    asked = covertree.Queries(points[:100], labels[:100], np.arange(100) % 2 == 0, np.where(np.arange(100) % 3 == 0, 10_000, -(1 << 60)), np.where(np.arange(100) % 5 == 0, 500_000, 1 << 60), names[:100])
    q, p, s, count = covertree.best(tree, asked, 5)
    scores = points[:100] @ points.T
    for i in range(100):
        fits = [j for j in range(2000) if (labels[j] == labels[i]) == (i % 2 == 0) and j != i and asked.lo[i] <= scores[i, j] <= asked.hi[i]]
        wanted = sorted(fits, key=lambda j: (-scores[i, j], j))[:5]
        assert p[q == i].tolist() == wanted and s[q == i].tolist() == scores[i, wanted].tolist()
    assert count < 100 * 2000 // 3
