from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import whitening
from foliant.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, most=8):
    """Exact integer covariance with Python integers, deviations row by row."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    xs = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in kept]
    n, width = len(xs), len(xs[0])
    sums = [sum(x[d] for x in xs) for d in range(width)]
    covariance = np.array([[float(Fraction(n * sum(x[i] * x[j] for x in xs) - sums[i] * sums[j], n * n)) for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(covariance)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in xs]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in xs])
    return kept, n, deviation, values[::-1][:most], centred @ vectors[:, ::-1][:, :most], np.trace(covariance)


def agree(got, rows, most=8):
    kept, n, deviation, values, along, trace = brute(rows, most)
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    k = len(values)
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [(kept[i][0], c + 1, n, deviation[i]) for i in sorted(range(n), key=lambda i: kept[i][0]) for c in range(k)]
    white = np.array([r.whitened for r in got]).reshape(n, k)
    order = sorted(range(n), key=lambda i: kept[i][0])
    wanted = along[order] / np.sqrt(values)
    signs = np.sign((white * wanted).sum(axis=0))
    assert np.allclose(white, wanted * signs, atol=1e-6)
    assert np.allclose([r.explained for r in got[:k]], values / trace, rtol=1e-6)
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-6 and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-6


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    agree(QUERIES["op13_embedding_whitening"](spark, sf).collect(), rows)


def test_partitions_agree(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    first, again = (sorted(whitening.whiten(table.repartition(n)).collect()) for n in (1, 7))
    assert [r[:4] + r[5:] for r in first] == [r[:4] + r[5:] for r in again] and np.allclose([r.whitened for r in first], [r.whitened for r in again], rtol=0, atol=1e-12)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(40, [0.1, 0.2, 0.3]), (41, [0.1, 0.2, 0.3])]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 1.0, 1.0]), (53, [1.0, float("inf"), 1.0]), (54, [1.0, 2.0]), (55, [])]
    table = spark.createDataFrame(rows + odd, SCHEMA).withColumn("n", F.lit("x")).withColumn("component", F.lit(1))
    agree(whitening.whiten(table).collect(), rows)
    repeated = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [2.0, 1.0])], SCHEMA)
    got = whitening.whiten(repeated).collect()
    assert len(got) == 6 and all(r.whitened is None for r in got if r.component == 2) and all(r.whitened is not None for r in got if r.component == 1)
    single = whitening.whiten(spark.createDataFrame([(1, [5.0])], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in single] == [(1, 0, None, 0.0, 0.0)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], SCHEMA)).collect()
    assert len(huge) == 4 and all(r.deviation is None for r in huge)


def test_empty(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], SCHEMA)).collect() == []


def test_scatter_is_exact():
    rng = np.random.default_rng(3)
    for rows, low, high in ((1, -5, 5), (63, -2000, 2000), (130, 0, 2 ** 40), (64, 7, 8)):
        values = rng.integers(low, high, (rows, 5))
        sums, products = whitening.scatter(values)
        exact = values.astype(object)
        assert sums == exact.sum(axis=0).tolist() and products == (exact.T @ exact).tolist()
