"""Repeated passages of many words: winnowed seeds, extended both ways, kept as maximal repeats.

Every window of ``window`` words is filed under one seed: the least hash among its runs of ``SEED`` words, the leftmost of equal
ones. The choice depends on the window's words alone, so equal windows meet at equal seeds, at the same distance from them.
Neighbouring windows under one seed form a run, whose words reach as far to both sides of the seed as the seed decides.
"""

from __future__ import annotations

from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, slices, stored
from foliant.operators.skew import join_groups

SEED = 4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """Hashes of ``left`` spans and the ``right`` spans that begin ``step`` words later."""
    n = max(0, min(len(left), len(right) - step))
    return _mix(left[:n] * _GOLDEN + right[step:step + n])


def span_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """One hash for every run of ``length`` words, joined from runs of 1, 2, 4, ... words."""
    out, covered, power, size = None, 0, words, 1
    while True:
        if length & size:
            out, covered = (power if out is None else _joined(out, power, covered)), covered + size
        if 2 * size > length:
            return out
        power, size = _joined(power, power, size), 2 * size


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the place of its least one, the leftmost of equal ones."""
    best, size = np.arange(len(values)), 1

    def wider(step):
        n = max(0, len(best) - step)
        left, right = best[:n], best[step:]
        return np.where(values[left] <= values[right], left, right)

    while 2 * size <= width:
        best, size = wider(size), 2 * size
    return wider(width - size) if size < width else best


def _split(texts: list[bytes | None]):
    """Words of each text, their hashes in one array, and where each text begins in it."""
    words = [(t or b"").split() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(edges[-1]))
    return words, hashes, edges


def _runs(batches, window):
    """(seed, context, doc, mark, start, size): windows start .. start + size - 1 of a document have one seed; equal contexts are equal words around it."""
    for batch in batches:
        for part in slices(batch, 2):
            _, hashes, edges = _split(part.column(2).cast(pa.binary()).to_pylist())
            with np.errstate(over="ignore"):
                seeds, whole = span_hashes(hashes, SEED), span_hashes(hashes, window)
                sizes = np.maximum(np.diff(edges) - window + 1, 0)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + edges[owner]
                seed = least_places(seeds, window - SEED + 1)[place] if len(place) else place
                begin = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])[:len(seed)])
                size = np.diff(np.concatenate([begin, [len(seed)]])).astype(np.int64)
                low, owner, seed = place[begin], owner[begin], seed[begin]
                # The first and the last window of a run overlap, so their hashes and distances tell all its words.
                context = _mix(_mix(whole[low] * _GOLDEN + whole[low + size - 1]) + (size << 32 | seed - low).astype(np.uint64)) if len(low) else np.empty(0, np.uint64)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([
                pa.array((seeds[seed] if len(low) else context).view(np.int64)), pa.array(context.view(np.int64)), part.column(0).take(take), part.column(1).take(take),
                pa.array(low - edges[owner], pa.int64()), pa.array(size, pa.int32())], ["seed", "context", "doc", "mark", "start", "size"])


def _windows(batches, window):
    """(seed, words, doc, mark, start): every window of the runs listed for a document, with the hash of its words."""
    for batch in batches:
        for part in slices(batch, 2):
            _, hashes, edges = _split(part.column(2).cast(pa.binary()).to_pylist())
            listed = part.column(3)
            owner = np.repeat(np.arange(part.num_rows), listed.value_lengths().to_numpy())
            fields = listed.flatten()
            start, size, seed = (fields.field(i).to_numpy() for i in range(3))
            with np.errstate(over="ignore"):
                whole = span_hashes(hashes, window)
            size = size.astype(np.int64)
            again = np.repeat(np.arange(len(size)), size)
            place = start[again] + np.arange(len(again)) - np.repeat(np.cumsum(size) - size, size)
            take = pa.array(owner[again])
            yield pa.RecordBatch.from_arrays([
                pa.array(seed[again], pa.int64()), pa.array(whole[edges[owner[again]] + place].view(np.int64)), part.column(0).take(take), part.column(1).take(take),
                pa.array(place, pa.int64())], ["seed", "words", "doc", "mark", "start"])


def _cut(batches, window):
    """Texts without the words of their listed runs of windows."""
    for batch in batches:
        for part in slices(batch, 3):
            rows = []
            for text, listed in zip(part.column(3).cast(pa.binary()).to_pylist(), part.column(4)):
                words = (text or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                if listed.is_valid and len(listed.values):
                    start, size = (listed.values.field(i).to_numpy() for i in range(2))
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + size + window - 1, -1)
                gone = (np.cumsum(gone) > 0)[:-1]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
                rows.append((b" ".join(compress(words, ~gone)), len(words), int(gone.sum()), [{"start": a, "words": b - a} for a, b in edges.tolist()]))
            kept, count, removed, spans = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), part.column(2), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))], ["doc_id", "doc", "mark", "text", "n_words", "n_removed", "spans"])


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Texts in their order: by id, null after all, then by a hash of the text, which tells rows of one id apart."""
    key = F.col(id_column).cast("long")
    text = F.col(text_column).cast("string")
    return docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(_LAST)).alias("doc"), (F.xxhash64(text).bitwiseXOR(F.when(key.isNull(), 1).otherwise(0).cast("long"))).alias("mark"), text.alias("text"))


def repeated_windows(texts: DataFrame, window: int) -> DataFrame:
    """(doc, mark, runs): per document the runs (start, size) of its windows that have begun before, in the order of (doc, mark, start)."""
    key = ["doc", "mark", "start"]
    runs = stored(texts.select("doc", "mark", "text").mapInArrow(lambda it: _runs(it, window), "seed long, context long, doc long, mark long, start long, size int"), "runs", True)
    # Runs of equal words are one class. All but the first of a class repeat it with all their windows.
    classes = stored(runs.groupBy("seed", "context").agg(F.min(F.struct(*key, "size")).alias("first")).select("seed", "first.*"), "classes", True)
    later = stored(runs.select(*key, "size").join(classes.select(*key), key, "left_anti"), "later", True)
    # Classes with one seed may share some windows: each is extended to both sides of the seed, window by window.
    shared = stored(classes.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "shared", True)
    asked = stored(join_groups(classes, shared, ["seed"], key, how="inner", rows_in="n").groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "size", "seed")).alias("runs")), "asked", True)
    windows = stored(texts.select("doc", "mark", "text").join(asked, ["doc", "mark"]).mapInArrow(lambda it: _windows(it, window), "seed long, words long, doc long, mark long, start long"), "windows", True)
    firsts = windows.groupBy("seed", "words").agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    single = windows.select(*key).join(firsts, key, "left_anti").withColumn("size", F.lit(1))
    found = stored(later.unionByName(single).groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "size")).alias("runs")), "found", True)
    discard(runs, classes, later, shared, asked, windows)
    return found


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20) -> DataFrame:
    """doc_id, text (the words that stay, joined by one space), n_words, n_removed and spans (start, words), for every row of ``docs``.

    A word goes if it lies in ``window`` consecutive words that also begin earlier: in a document with a smaller id, or further
    up in the same one. ``spans`` are the maximal repeats, of ``window`` words or more. Windows are judged on the input, so the
    first of several copies stays whole. Words are what stands between ASCII white space, compared as they are.

    Null, empty and wordless texts have no words; texts shorter than a window lose none. Rows that share an id are ordered by
    a hash of their texts; of rows equal in id and text one counts as the first, the others lose every word that a window covers.
    A null id comes after all others. Extra columns are ignored. Words, seeds and windows are compared by 64-bit hashes,
    windows only among those with the same seed.
    """
    texts = _keyed(docs, id_column, text_column)
    found = repeated_windows(texts, window)
    copies = stored(texts.groupBy("doc", "mark").agg(F.count("*").alias("copies")).where("copies > 1"), "copies", True)
    once = texts.join(copies, ["doc", "mark"], "left_anti").withColumn("copies", F.lit(1).cast("long"))
    many = texts.join(copies, ["doc", "mark"]).dropDuplicates(["doc", "mark"]).select(*once.columns)
    schema = "doc_id long, doc long, mark long, text string, n_words long, n_removed long, spans array<struct<start:long,words:long>>"

    def cut(rows):
        return (rows.join(found, ["doc", "mark"], "left").select("doc_id", "doc", "mark", "text", "runs").mapInArrow(lambda it: _cut(it, window), schema))

    columns = ["doc_id", "text", "n_words", "n_removed", "spans"]
    later = (F.col("copy") > 1) & (F.col("n_words") >= window)
    repeated = (cut(many).join(copies, ["doc", "mark"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
                .select("doc_id", F.when(later, "").otherwise(F.col("text")).alias("text"), "n_words", F.when(later, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
                        F.when(later, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("words")))).otherwise(F.col("spans")).alias("spans")))
    return cut(once).select(*columns).unionByName(repeated)
