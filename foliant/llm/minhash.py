"""Near-duplicate groups from SetSketch registers: banded, estimated jointly by likelihood, then verified on full sets.

A sketch holds ``REGISTERS`` exponentially spaced, truncated minima of a random process that every shingle starts: register i
is the largest k with ``min x_i <= BASE ** (1 - k) * SCALE``. Sketches of two sets merge by taking the larger registers, and
two registers agree about as often as the sets' Jaccard similarity.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import connected, free_name, numbered, passing, slices, stored

REGISTERS = 128
BAND = 4
BASE = 1.02
SCALE = 1024.0
TOP = 65535
#: Estimates this many standard errors below the threshold end a candidate; a true link falls there once in 10**7.
ERRORS = 5.5
#: Text bytes that a worker takes apart at a time, and points of their processes that it draws at a time: what it holds beside its batch is some 50 times the former.
SLICE_BYTES = 1 << 20
POINTS = 500_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; A-Z count as a-z."""
    words = [(t or b"").lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    total = int(counts.sum())
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, total)
    with np.errstate(over="ignore"):
        span = max(0, total - k + 1)
        rolled = np.full(span, np.uint64(k))
        for i in range(k):
            rolled = _mix(rolled * _GOLDEN + hashes[i:i + span])
        out, start = [], 0
        for n in counts.tolist():
            if n >= k:
                out.append(np.unique(rolled[start:start + n - k + 1]))
            elif n:
                whole = np.array([n], np.uint64)
                for h in hashes[start:start + n]:
                    whole = _mix(whole * _GOLDEN + h)
                out.append(whole)
            else:
                out.append(np.empty(0, np.uint64))
            start += n
    return out


def fingerprint(shingles: np.ndarray) -> bytes | None:
    """Equal for equal sets; null for the empty one."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of ``m`` registers per set (zeros for an empty one).

    Each element runs a Poisson process of rate m whose points fall on random registers; a set's elements stop once
    their next point lies above all its registers, so a set of n elements costs about n + m ln m points.
    """
    docs = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    low = np.full(docs * m, np.inf)
    owner, element = np.repeat(np.arange(docs), sizes), (np.concatenate(sets) if docs else np.empty(0, np.uint64))
    at, step, block = np.zeros(len(element)), 0, 1
    with np.errstate(over="ignore"):
        while len(element):
            steps = np.arange(step + 1, step + 1 + block, dtype=np.uint64) * _GOLDEN
            bits = _mix(element[:, None] + steps[None, :])
            gaps = -np.log(((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52) / m
            points = at[:, None] + np.cumsum(gaps, axis=1)
            slots = (_mix(bits ^ _GOLDEN) % np.uint64(m)).astype(np.int64) + (owner * m)[:, None]
            np.minimum.at(low, slots.ravel(), points.ravel())
            at, step = points[:, -1], step + block
            alive = at < low.reshape(docs, m).max(axis=1)[owner]
            owner, element, at = owner[alive], element[alive], at[alive]
            block = int(np.clip(POINTS // max(1, len(element)), 1, 16))
    with np.errstate(divide="ignore"):
        registers = np.floor(1 - np.log(low / SCALE) / math.log(BASE))
    return np.clip(np.where(np.isinf(low), 0, registers), 0, TOP).astype("<u2").reshape(docs, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketch rows, by maximum likelihood over how many registers are larger, smaller and equal."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u

    def chance(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        up, down = chance(np.maximum(u - v * j, 0)), chance(np.maximum(v - u * j, 0))
        tiny = 1e-300
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = likelihood(left) > likelihood(right)
        high, low = np.where(better, right, high), np.where(better, low, left)
    return (low + high) / 2


def _describe(batches, k):
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), k)
            rows = sketches(sets)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()),
                pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, rows)], pa.binary())], ["doc_id", "n_shingles", "fingerprint", "sketch"])


def _named(batches, k):
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), part.column(1)], ["fingerprint", "text"])


def _exploded(batches, k):
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), k)
            edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))],
                                             ["fingerprint", "shingles"])


def _promising(batches, floor):
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS).astype(np.int32) for c in ("sketch_a", "sketch_b"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            keep = estimate(a, b, na, nb) >= floor
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _verified(batches, k, above, below):
    for batch in batches:
        for part in slices(batch, 2, SLICE_BYTES):
            texts_a, texts_b = (part.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
            known = list(dict.fromkeys(texts_a + texts_b))
            sets = dict(zip(known, shingle_sets(known, k)))
            keep = []
            for x, y in zip(texts_a, texts_b):
                p, q = sets[x], sets[y]
                shared = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(below * shared >= above * (len(p) + len(q) - shared))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Search:
    """What it takes to judge candidate pairs: one node per distinct shingle set, and the texts."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, k: int, above: int, below: int):
        self.nodes, self.texts, self.k, self.above, self.below = nodes, texts, k, above, below
        t = above / below
        self.floor = t - ERRORS * math.sqrt(t * (1 - t) / REGISTERS)

    def found(self, asked: DataFrame, read, schema: str) -> DataFrame:
        """What ``read`` makes of the texts of the nodes ``asked``. A document is found again by its id; the set's fingerprint tells rows with one id apart."""
        asked = stored(self.nodes.join(asked, "node", "left_semi").select("node", "doc_id", "fingerprint", "n_shingles"), "asked")
        rows = self.texts.join(asked.select("doc_id").distinct(), self.texts.doc_id.eqNullSafe(asked.doc_id), "left_semi")
        return rows.mapInArrow(read, f"fingerprint binary, {schema}").join(asked, "fingerprint")

    def rest(self, mixed: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that may still be linked, from nodes that share buckets across components.

        Linked sets share all but a few of their shingles, so they have one in common among the rarest few of each: only
        those are met. A copy with too many shingles of its own meets nobody, however many near copies are around it.
        """
        k, above, below = self.k, self.above, self.below
        named = mixed.select("node", "component").distinct()
        sets = self.found(named.select("node"), lambda it: _exploded(it, k), "shingles array<long>").join(named, "node")
        tokens = stored(sets.select("node", "component", "n_shingles", F.explode("shingles").alias("shingle")), "shingles")
        often = tokens.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("n > 1")
        own = Window.partitionBy("node")
        most = F.col("n_shingles") - F.ceil(F.col("n_shingles") * above / below) + 1
        ranked = (tokens.join(often, "shingle").withColumn("alone", F.col("n_shingles") - F.count("*").over(own))
                  .withColumn("rank", F.col("alone") + F.row_number().over(own.orderBy("n", "shingle"))).where(F.col("rank") <= most).where("low <> high"))
        members = stored(ranked.select("shingle", "component", "n_shingles", "rank", "node"), "rarest")
        # Nodes of one component that are alike here are one part, so that no pair within a component is made.
        keys = ["shingle", "component", "n_shingles", "rank"]
        parts = members.select(*keys).distinct()
        others = parts.select("shingle", *[F.col(c).alias(f"other_{c}") for c in keys[1:]])
        # Of two linked sets the rarest shared shingle comes before as many others as the overlap leaves room for.
        overlap = F.ceil((F.col("n_shingles") + F.col("other_n_shingles")) * above / (above + below))
        fits = ((F.col("component") < F.col("other_component")) & (F.col("rank") <= F.col("n_shingles") - overlap + 1)
                & (F.col("other_rank") <= F.col("other_n_shingles") - overlap + 1))
        across = parts.join(others, "shingle").where(fits)
        return (across.join(members.withColumnRenamed("node", "p"), keys)
                .join(members.select("shingle", *[F.col(c).alias(f"other_{c}") for c in keys[1:]], F.col("node").alias("q")), ["shingle", *[f"other_{c}" for c in keys[1:]]])
                .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that hold: sizes allow it, the joint estimate is near enough, and the full sets agree."""
        k, above, below, floor = self.k, self.above, self.below, self.floor

        def side(name):
            return self.nodes.select(F.col("node").alias(name), F.col("sketch").alias(f"sketch_{name}"), F.col("n_shingles").alias(f"n{name}"))

        near = stored(pairs.join(side("a"), "a").join(side("b"), "b")
                      .where(F.least("na", "nb") * below >= F.greatest("na", "nb") * above)
                      .select("a", "b", "sketch_a", "sketch_b", "na", "nb").mapInArrow(lambda it: _promising(it, floor), "a long, b long"), "near")
        asked = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        texts = stored(self.found(asked, lambda it: _named(it, k), "text string").groupBy("node").agg(F.max("text").alias("text")), "texts")
        full = (near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
                .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b"))
        return stored(full.mapInArrow(lambda it: _verified(it, k, above, below), "a long, b long"), "links")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component of ``labels`` (node, component); a node without a label is one of its own."""
    named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    buckets = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return named.join(buckets.select("bucket"), "bucket", "left_semi")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept, for every row of ``docs``.

    Two rows are linked if the Jaccard similarity of their sets of ``shingle``-word shingles is at least the fraction
    ``similarity``. Texts with fewer words are one shingle; null, empty and wordless texts have none and stay alone. Rows that
    repeat an id are rows of their own; a null id counts as larger than any other. Extra columns are ignored.

    Equal sets fall into one node first. Nodes that share a band of registers meet in a bucket, whose pivot is tried against its
    other members. Nodes that then still share buckets with other components meet by their rarest shingles, which loses no
    link; pairs within a component are never made, so a group of copies of any size costs about its rows.
    """
    above, below = similarity
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = numbered(texts.mapInArrow(lambda it: _describe(it, shingle), "doc_id long, n_shingles long, fingerprint binary, sketch binary"), "sets")
    first = rows.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("_row").alias("_row"))
    # xxhash64 of one long is one-to-one, so nodes are in random order and their ids stay unique.
    nodes = stored(rows.join(first.select("_row"), "_row", "left_semi")
                   .select(F.xxhash64("_row").alias("node"), "doc_id", "fingerprint", "n_shingles", "sketch"), "nodes")
    search = _Search(nodes, texts, shingle, above, below)
    bands = [F.xxhash64(F.lit(i), F.expr(f"substring(sketch, {i * BAND * 2 + 1}, {BAND * 2})")) for i in range(REGISTERS // BAND)]
    members = nodes.select("node", F.explode(F.array(*bands)).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(members.join(shared, "bucket"), "members")
    # The pivot of a bucket is the node that meets most others: of edited copies, the one that is nearest to all.
    central = stored(members.groupBy("node").agg(F.sum("n").alias("weight")), "central")
    pivots = members.join(central, "node").groupBy("bucket").agg(F.max_by("node", "weight").alias("pivot"))
    pairs = members.join(pivots, "bucket").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).where("a <> b").distinct()
    tried = stored(pairs, "pairs")
    links = search.links(tried)
    # Whole components, not what a node's own links show: pairs that a chain of links already connects are the most of a large group's.
    labels = stored(connected(links), "labels")
    rest = search.rest(stored(_mixed(members, labels), "mixed")).join(tried, ["a", "b"], "left_anti")
    links = search.links(stored(rest, "rest"))
    labels = connected(links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    classes = nodes.join(labels, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component"))
    named = rows.select("doc_id", "n_shingles", "fingerprint")
    least = named.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = stored(classes.join(least, "fingerprint"), "roots")
    roots = roots.join(roots.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fingerprint", "component_id")
    return (named.join(roots, "fingerprint", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with all its columns, whatever their names. Rows that share an id stay if one of them does."""
    name = free_name(docs, "_gone")
    with passing() as keep:
        found = near_duplicates(docs, id_column, text_column, shingle, similarity)
        gone = keep(stored(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col("doc_id").alias(name)), "gone"))
    return docs.join(gone, docs[id_column].cast("long").eqNullSafe(gone[name]), "left_anti")
