"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import scratch

#: A word: what stands between ASCII white space (0x09-0x0D and 0x20); bytes.split() cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables stored since the innermost ``passing`` began; None outside of it.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at the end, but for those given to the function that this yields, and leave no shuffle files."""
    outer, made, kept = _MADE.get(), [], []
    token = _MADE.set(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _MADE.reset(token)
        stay = {t.stored_at for t in kept}
        discard(*(t for t in made if t.stored_at not in stay))
        if outer is not None:
            outer += kept


def stored(df: DataFrame, name: str, release: bool = False, compression: str = "snappy") -> DataFrame:
    """Write to the shared scratch folder and read back: lineage is cut, row ids keep their values, columns prune.

    With ``release``, and inside of ``passing``, the shuffle files of this write go as soon as it is done.
    """
    spark, made = df.sparkSession, _MADE.get()
    release = release or made is not None
    path, before = scratch(spark, name), spark.conf.get(_RELEASE, "false")
    try:
        if release:
            spark.conf.set(_RELEASE, "true")
        df.write.parquet(path, compression=compression)
    finally:
        if release:
            spark.conf.set(_RELEASE, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    if made is not None:
        made.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be none of the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str, row: str = "_row", compression: str = "snappy") -> DataFrame:
    """Stored rows with a unique number, ``_row`` unless named otherwise, that no retry can change."""
    return stored(df.withColumn(row, F.monotonically_increasing_id()), name, compression=compression)


def slices(batch: pa.RecordBatch, text: int, limit: int = 4 << 20):
    """Cut a batch into runs of rows that hold about ``limit`` bytes in column number ``text``."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)) // limit
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:]):
        for start in range(low, high, 2000):
            yield batch.slice(start, min(2000, high - start))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``links`` (a, b); component: its smallest node.

    Alternates the large-star and small-star steps until nothing moves: the number of rounds grows with the
    logarithm of the longest chain. A hub's links meet in a split join, never in one task.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        # Stars are what is wanted: no node has two centres, and no centre one of its own.
        roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("leaf")))
        if roles.groupBy("node").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("least")).where("n > 1 OR (n = 1 AND least = 0)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        edges = stored(small, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
