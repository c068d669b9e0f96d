"""Hard negatives: for an anchor and each of its positives, rows of other labels that score almost as high, found in cover trees.

Rows are split into cells of near rows, each with a cover tree. An anchor asks first the cell that is nearest to the window of
scores it looks for; what it finds there and the cells' radii tell which other cells can hold an answer, and only those are asked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import discard, numbered, stored
from foliant.llm.covertree import Queries, Tree, best, bounds, build, exact_kind
from foliant.operators.skew import join_groups

#: Rows of a cell at most, but for chance; pivots that split a larger one; rows that meet the pivots in one task.
CELL, PIVOTS, DEALT = 2048, 64, 20_000
#: Queries that meet one cell's tree, or one block of cells' roots, together; cells of such a block.
ASKED, ROOTS, TOGETHER = 1024, 1024, 256
#: Components beyond this count as it, so that inner products of up to 2**15 components are exact longs.
REACH = 1 << 24
FAR = 1 << 62

_ROW = "row long, vec_id long, label long, vector binary"
_COLUMNS = ["query", "block", "vector", "label", "same", "lo", "hi", "own"]
_QUERY = "query long, block long, vector binary, label long, same boolean, lo long, hi long, own long"


def _vectors(column) -> np.ndarray:
    """Rows of little-endian 32-bit integers."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array([np.frombuffer(v, "<i4") for v in values.to_pylist()], np.int64).reshape(len(values), -1)


def integer_rows(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: float, extra: dict) -> DataFrame:
    """(row, vec_id, label, vector, ...): the rows that take part, their components as integers, padded with zeros to the longest."""
    held = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"),
                          *[c.alias(n) for n, c in extra.items()])
    held = held.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    width = max(1, held.agg(F.max(F.size("vector"))).first()[0] or 1)

    def packed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                sizes = part.column(2).value_lengths().to_numpy()
                flat = np.clip(np.floor(part.column(2).flatten().to_numpy() * scale), -REACH, REACH)
                out = np.zeros((part.num_rows, width), "<i4")
                owner = np.repeat(np.arange(part.num_rows), sizes)
                out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in out], pa.binary()), *part.columns[3:]], part.schema.names)

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in held.schema.fields[3:])
    return numbered(held.mapInArrow(packed, f"vec_id long, label long, vector binary{kinds}"), "vectors").withColumnRenamed("_row", "row")


def _nearest(key: tuple[pa.Scalar, ...], rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """The rows of one share of a cell with the number of their nearest pivot."""
    order = np.argsort(pivots.column("row").to_numpy())
    x, p = _vectors(rows.column("vector")).astype(float), _vectors(pivots.column("vector")).astype(float)[order]
    if len(x):
        near = (x @ (-2 * p.T) + (p * p).sum(axis=1)).argmin(axis=1) if len(p) else np.zeros(len(x), np.int64)
    else:
        near = np.empty(0, np.int64)
    return rows.select(["row", "vec_id", "label", "vector", "cell", "n"]).append_column("near", pa.array(near, pa.int64()))


def cells(rows: DataFrame, most: int = CELL) -> DataFrame:
    """``rows`` with a ``cell`` of about ``most`` rows or fewer: a larger cell is split by its rows' nearest pivots, rows that pivots can't tell apart by a hash."""
    todo = rows.select("row", "vec_id", "label", "vector", F.lit(0).cast("long").alias("cell"), F.lit(None).cast("long").alias("parent"))
    done = None
    while True:
        sizes = stored(todo.groupBy("cell").agg(F.count("*").alias("n"), F.max("parent").alias("parent")), "sizes", True)
        large = sizes.where(F.col("n") > most)
        small = todo.join(sizes.where(F.col("n") <= most).select("cell"), "cell", "left_semi").select("row", "vec_id", "label", "vector", "cell")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        # A cell that kept nine tenths of its parent has equal rows, or nearly so: any deal is as good.
        alike = (F.col("n") * 10 > F.col("parent") * 9) & F.col("parent").isNotNull()
        named = join_groups(todo.drop("parent"), large.select("cell", "n", alike.alias("alike")), ["cell"], ["row"], how="inner", rows_in="n")
        dealt = named.where("alike").withColumn("near", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") * 2 / most)))
        spread = named.where("NOT alike").withColumn("share", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / DEALT)))
        rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("row", F.lit(1)), "row"))
        pivots = (stored(named.where("NOT alike").select("cell", "row", "vector", "n").withColumn("rank", rank).where(F.col("rank") <= PIVOTS), "pivots", True)
                  .withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / DEALT) - 1))).select("cell", "share", "row", "vector"))
        near = spread.groupBy("cell", "share").cogroup(pivots.groupBy("cell", "share")).applyInArrow(_nearest, f"{_ROW}, cell long, n long, near long")
        near = near.unionByName(dealt.select(*near.columns))
        todo = stored(near.select("row", "vec_id", "label", "vector", F.xxhash64("cell", "near").alias("cell"), F.col("n").alias("parent")), "cells", True)


def _plant(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("row")
    vectors = _vectors(rows.column("vector"))
    ids = rows.column("vec_id")
    kind = np.int16 if np.abs(vectors).max(initial=0) < 1 << 15 else np.int32
    tree = build(vectors.astype(kind), rows.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), rows.column("label").to_numpy())
    top = tree.first[tree.root]
    labels = tree.labels
    return pa.table({"cell": [key[0].as_py()], "root": pa.array([vectors[tree.root].astype("<i4").tobytes()], pa.binary()), "norm": [float(tree.norm)],
                     "angle": [float(tree.radius[top]) if top >= 0 else 0.0], "low": [int(labels.min())], "high": [int(labels.max())], "tree": pa.array([tree.to_bytes()], pa.binary())})


def plant(rows: DataFrame) -> DataFrame:
    """One row for each cell: its root, what the root covers, and the packed tree."""
    return stored(cells(rows).groupBy("cell").applyInArrow(_plant, "cell long, root binary, norm double, angle double, low long, high long, tree binary"), "trees", True)


def _asked(table: pa.Table) -> Queries:
    return Queries(_vectors(table.column("vector")), *(table.column(c).to_numpy() for c in ("label", "same", "lo", "hi", "own")))


def _reach(queries: pa.Table, roots: pa.Table):
    """(scores, possible): inner products of queries and cells' roots, and whether the cell may hold an answer."""
    asked, points = _asked(queries), _vectors(roots.column("root"))
    kind = exact_kind(asked.vectors, points)
    scores = (asked.vectors.astype(kind) @ points.astype(kind).T).astype(float)
    norms = np.sqrt((asked.vectors.astype(float) ** 2).sum(axis=1))[:, None]
    low, high = (roots.column(c).to_numpy()[None, :] for c in ("low", "high"))
    least, most = bounds(scores, np.broadcast_to(norms, scores.shape), roots.column("norm").to_numpy()[None, :], roots.column("angle").to_numpy()[None, :])
    label = asked.labels[:, None]
    named = np.where(asked.same[:, None], (low <= label) & (label <= high), ~((low == label) & (label == high)))
    return asked, scores, named & (most >= asked.lo[:, None]) & (least <= asked.hi[:, None])


def _first(key: tuple[pa.Scalar, ...], queries: pa.Table, roots: pa.Table) -> pa.Table:
    """Of this block of cells the one whose root scores nearest to the top of each query's window."""
    found = {"query": [], "nearness": [], "cell": []}
    if queries.num_rows and roots.num_rows:
        roots = roots.sort_by("cell")
        asked, scores, possible = _reach(queries, roots)
        nearness = np.where(possible, np.where(asked.hi[:, None] < FAR, -np.abs(scores - asked.hi[:, None]), scores), -np.inf)
        at = nearness.argmax(axis=1)
        some = np.flatnonzero(possible.any(axis=1))
        found = {"query": queries.column("query").take(pa.array(some)), "nearness": nearness[some, at[some]], "cell": roots.column("cell").take(pa.array(at[some]))}
    return pa.table(found, pa.schema([("query", pa.int64()), ("nearness", pa.float64()), ("cell", pa.int64())]))


def _others(key: tuple[pa.Scalar, ...], queries: pa.Table, roots: pa.Table) -> pa.Table:
    """Every query with every cell of this block that may hold a better answer than those it has."""
    if not queries.num_rows or not roots.num_rows:
        return queries.slice(0, 0).select(_COLUMNS).append_column("cell", pa.array([], pa.int64()))
    _, _, possible = _reach(queries, roots)
    names = roots.column("cell").to_numpy()
    possible &= names[None, :] != queries.column("been").to_numpy()[:, None]
    q, c = np.nonzero(possible)
    return queries.select(_COLUMNS).take(pa.array(q)).append_column("cell", pa.array(names[c], pa.int64()))


def _visit(most: int):
    def visit(key: tuple[pa.Scalar, ...], queries: pa.Table, trees: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and trees.num_rows:
            tree, asked = Tree.from_bytes(trees.column("tree")[0].as_py()), _asked(queries)
            for start in range(0, queries.num_rows, TOGETHER):
                q, p, s, _ = best(tree, asked.part(start, start + TOGETHER), most)
                found.append((q + start, p, s))
        q, p, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        names = queries.column("query").to_numpy()
        ids = pa.array(tree.ids[p], pa.int64(), mask=tree.nameless[p]) if found else pa.array([], pa.int64())
        return pa.table({"query": pa.array(names[q], pa.int64()), "vec_id": ids, "row": pa.array(tree.rows[p] if found else [], pa.int64()), "score": pa.array(s, pa.int64())})
    return visit


def search(trees: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query, rank, vec_id, row, score): the best ``most`` answers of every query (``query, vector, label, same, lo, hi, own``) over all cells."""
    queries = stored(queries, "queries", True)
    n, cells_there = queries.count(), trees.count()
    blocks, shelves = max(1, -(-n // ASKED)), max(1, -(-cells_there // ROOTS))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).select(*_COLUMNS)
    roots = (trees.select("cell", "root", "norm", "angle", "low", "high").withColumn("shelf", F.pmod(F.xxhash64("cell"), F.lit(shelves)))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))

    def shelved(asked):
        return asked.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shelves - 1).cast("long")))).groupBy("block", "shelf")

    def answers(visits):
        wanted = visits.select("cell", "block").distinct().select("cell", (F.col("block") + F.lit(0)).alias("block"))
        held = trees.select("cell", "tree").join(wanted, "cell")
        return visits.groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInArrow(_visit(most), "query long, vec_id long, row long, score long")

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    first = shelved(queries).cogroup(roots.groupBy("block", "shelf")).applyInArrow(_first, "query long, nearness double, cell long").groupBy("query").agg(F.max(F.struct("nearness", "cell")).alias("at")).select("query", "at.cell")
    first = stored(queries.join(first, "query"), "first", True)
    near = stored(answers(first), "near", True)
    # The worst of a full set of answers is what another cell has to reach.
    full = near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= most).select("query", "least")
    open_ = (first.join(full, "query", "left").withColumn("lo", F.greatest("lo", F.coalesce("least", "lo"))).withColumnRenamed("cell", "been")
             .select(*_COLUMNS, "been"))
    others = stored(shelved(open_).cogroup(roots.groupBy("block", "shelf")).applyInArrow(_others, f"{_QUERY}, cell long"), "others", True)
    found = near.unionByName(answers(others)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    out = stored(found.select("query", "rank", "vec_id", "row", "score"), "answers", True)
    discard(first, near, others)
    return out


def hard_negatives(vectors: DataFrame, anchors, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                   positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows for which the condition ``anchors`` holds.

    A component x counts as floor(scale * x), a score is the integer inner product with the anchor. An anchor's positives are its
    ``positives`` best other rows of the same label, its negatives those of other labels with a score from ``least`` (a fraction)
    of the positive's up to the positive's; the best ``negatives`` of them are returned, equal scores by the smaller id, null last.

    Rows with a null label, a null vector or null or non-finite components take no part. Shorter vectors end in zeros. Components
    beyond 2**24 after scaling count as 2**24. Rows that repeat an id are rows of their own. A positive score below zero has no
    negatives. An empty table gives no rows; extra columns are ignored.
    """
    spark: SparkSession = vectors.sparkSession
    rows = integer_rows(vectors, id_column, vector_column, label_column, scale, {"anchor": F.coalesce(anchors, F.lit(False))})
    if rows.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    trees = plant(rows)
    asked = stored(rows.where("anchor").select("row", "vec_id", "label", "vector"), "anchors", True)
    own = search(trees, asked.select(F.col("row").alias("query"), "vector", "label", F.lit(True).alias("same"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"), F.col("row").alias("own")), positives)
    # Positives with one score ask for the same negatives.
    windows = numbered(own.where("score >= 0").select("query", "score").distinct(), "windows")
    above, below = least
    limits = windows.select("_row", F.col("query").alias("row"), F.expr(f"(score * {above} + {below - 1}) div {below}").alias("lo"), F.col("score").alias("hi"))
    other = search(trees, limits.join(asked, "row").select(F.col("_row").alias("query"), "vector", "label", F.lit(False).alias("same"), "lo", "hi", F.col("row").alias("own")), negatives)
    pairs = own.select(F.col("query").alias("row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row")
    pairs = pairs.join(windows.select("_row", F.col("query").alias("row"), F.col("score").alias("positive_score")), ["row", "positive_score"])
    return (pairs.join(other.select(F.col("query").alias("_row"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "_row")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
