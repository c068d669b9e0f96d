"""Embedding whitening from an exact integer scatter, by bit slices.

Components become integers. A block of rows is shifted so that every dimension starts at 0, and each dimension's bit planes are
packed across the rows into 64-bit words: the sum of products of two dimensions is the sum, over pairs of their planes, of the
population count of the planes' AND, weighted by the planes' powers of two. Blocks add up as decimals, without rounding.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry becomes floor(SCALE * entry) + SHIFT; floors beyond REACH count as REACH, so that all sums stay exact decimals.
SCALE, SHIFT, REACH = 1024.0, 100_000, 1 << 40
#: Rows of a block; its planes are some megabytes at a few hundred dimensions.
BLOCK = 4096
#: An eigenvalue below this share of the largest counts as zero.
FLAT = 1e-13


def _matrices(batches, width: int, column: int):
    """(batch, rows x width integers) of at most ``BLOCK`` rows, from list columns without nulls."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            entries = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, width)
            yield part, np.clip(np.floor(entries * SCALE), -REACH, REACH).astype(np.int64) + SHIFT


def plane_words(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit planes of non-negative ``values`` (rows x dimensions): (planes x dimensions x words) and their number."""
    planes = max(1, int(values.max(initial=0)).bit_length())
    padded = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), np.uint64)
    padded[:len(values)] = values.astype(np.uint64)
    bits = np.stack([np.packbits(((padded >> np.uint64(p)) & np.uint64(1)).astype(np.uint8).T, axis=1) for p in range(planes)])
    return np.ascontiguousarray(bits).view(np.uint64), planes


def scatter(values: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and sums of products of integer columns, as Python integers."""
    least = values.min(axis=0)
    shifted = values - least
    words, planes = plane_words(shifted)
    width = values.shape[1]
    total = np.zeros((width, width), object)
    for p in range(planes):
        for q in range(planes):
            counts = np.empty((width, width), np.int64)
            for i in range(width):
                counts[i] = np.bitwise_count(words[p, i] & words[q]).sum(axis=1, dtype=np.int64)
            total += counts.astype(object) << (p + q)
    n, low = len(values), least.astype(object)
    over = shifted.astype(object).sum(axis=0) if planes > 50 else shifted.sum(axis=0).astype(object)
    products = total + np.outer(low, over) + np.outer(over, low) + n * np.outer(low, low)
    return (over + n * low).tolist(), products.tolist()


def _scatters(batches, width):
    """(i, j, value): for each block the sums (j = -1) and the sums of products of its columns, i <= j."""
    cells = [(i, -1) for i in range(width)] + [(i, j) for i in range(width) for j in range(i, width)]
    first, second = (pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1))
    sums, products, seen = [0] * width, np.zeros((width, width), object), False
    for _, values in _matrices(batches, width, 0):
        s, m = scatter(values)
        sums, products, seen = [a + b for a, b in zip(sums, s)], products + np.array(m, object), True
    if seen:
        from decimal import Decimal

        values = sums + [products[i, j] for i in range(width) for j in range(i, width)]
        yield pa.RecordBatch.from_arrays([first, second, pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["i", "j", "value"])


class Whitening:
    """What the fit found: n, sums, the components (columns), their eigenvalues and shares of the trace, and the error of identity."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, most: int):
        self.n, self.sums, self.width = n, sums, len(sums)
        # Centred as integers: n * n * covariance, exact until here.
        centred = n * products - np.outer(np.array(sums, object), np.array(sums, object))
        power = max(0, max((abs(int(v)) for v in centred.ravel()), default=0).bit_length() - 1000)
        covariance = np.array([[int(v) / (n * n) if not power else float((int(v) >> power) / (n * n)) * 2.0 ** power for v in row] for row in centred], float).reshape(self.width, self.width)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:most]
        self.values, self.components = values[order], vectors[:, order]
        trace = float(np.trace(covariance))
        self.explained = self.values / trace if trace > 0 else np.zeros(len(order))
        self.good = self.values > FLAT * max(float(values.max(initial=0.0)), 0.0)
        self.scale = np.where(self.good, 1 / np.sqrt(np.where(self.good, self.values, 1.0)), np.nan)
        white = self.components[:, self.good] * self.scale[self.good]
        self.error = float(np.abs(white.T @ covariance @ white - np.eye(white.shape[1])).max(initial=0.0))

    def centred(self, values: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Rows times n less the sums, as floats, and their exact squared lengths (None beyond a long)."""
        bound = max(max(abs(self.n * int(values.max(initial=0)) - s), abs(self.n * int(values.min(initial=0)) - s)) for s in self.sums) if len(values) else 0
        if bound * bound * self.width < 1 << 63:
            far = values * self.n - np.array(self.sums, np.int64)
            return far.astype(float), (far * far).sum(axis=1).tolist()
        far = values.astype(object) * self.n - np.array(self.sums, object)
        lengths = (far * far).sum(axis=1)
        return far.astype(float), [int(x) if x < 1 << 63 else None for x in lengths]


def _whole(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and how many entries they have."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") == width) & sound), max(width, 0)


def fit(rows: DataFrame, width: int, most: int = 8) -> Whitening | None:
    """The driver gets one number for each pair of dimensions, whatever the number of rows; None without rows."""
    n = rows.count()
    if not n or not width:
        return None
    found = rows.select("vector").mapInArrow(lambda it: _scatters(it, width), "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()
    sums, products = [0] * width, np.zeros((width, width), object)
    for i, j, value in found:
        if j < 0:
            sums[i] = int(value)
        else:
            products[i, j] = products[j, i] = int(value)
    return Whitening(n, sums, products, most)


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each row of ``vectors`` that takes part and each component up to ``most``.

    Rows whose vector is null, or has null or non-finite entries, take no part; nor do rows with fewer entries than the longest
    vector, which lack some. An empty table, or one of empty vectors only, gives no rows. Rows that repeat an id or a vector are
    rows of their own; a null id stays null. Extra columns are ignored. Where an eigenvalue is zero (constant or dependent
    dimensions, or a single row) ``whitened`` is null; ``identity_error`` is that of the other components. ``deviation`` is null
    where it exceeds a long.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, width = _whole(vectors, id_column, vector_column)
    model = fit(rows, width, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def project(batches):
        k = len(model.values)
        for part, values in _matrices(batches, width, 1):
            far, lengths = model.centred(values)
            white = ((far / model.n) @ model.components * model.scale).ravel()
            count = part.num_rows
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(np.repeat(np.arange(count), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, model.n)),
                pa.array(lengths, pa.int64()).take(pa.array(np.repeat(np.arange(count), k))), pa.array(white, mask=np.isnan(white)),
                pa.array(np.tile(model.explained, count)), pa.array(np.full(count * k, model.error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
