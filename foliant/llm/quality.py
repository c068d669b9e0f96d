"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Words are hashed into a fixed vocabulary, so the vectors have one size whatever the corpus. A word's vector is the sum of the random
sparse index vectors of its neighbours over the whole corpus. A document is the mean, by rarity, of its words' vectors, with
their spread and how even and repetitive it is, so a two-layer network tells ordinary prose from other text.
"""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foliant.llm.common import slices, stored

#: Word slots, dimensions, non-zero places of an index vector, and words to each side that count as neighbours.
SLOTS = 1 << 15
DIMENSIONS = 48
PLACES = 4
WINDOW = 2
#: Labelled rows that fit the network, and those that set the temperature and the logit's offset, at most; drawn by a hash of the id.
FIT_ROWS = 20_000
CALIBRATION_ROWS = 5_000
HIDDEN = 32
EPOCHS = 60
SEED = 11


#: How many words a worker keeps; those not met in two generations are forgotten.
KEPT = 150_000
_KNOWN: dict[bytes, tuple[int, ...]] = {}
_BEFORE: dict[bytes, tuple[int, ...]] = {}


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every word of all texts, and how many each text has. A word without its outer marks, in small letters, is one slot; capitals
    and marks other than a full stop or comma are slots of their own after it, so that they have vectors as well."""
    global _KNOWN, _BEFORE
    if len(_KNOWN) > KEPT:
        _KNOWN, _BEFORE = {}, _KNOWN
    known, before, found, counts = _KNOWN, _BEFORE, [], []
    for text in texts:
        parts = (text or b"").split()
        try:
            slots = [known[w] for w in parts]
        except KeyError:
            for w in parts:
                if w not in known:
                    known[w] = before.get(w) or _slots(w)
            slots = [known[w] for w in parts]
        slots = list(chain.from_iterable(slots))
        counts.append(len(slots))
        found.append(np.array(slots, np.int32))
    return (np.concatenate(found) if found else np.empty(0, np.int32)), np.array(counts, np.int64)


def _forget() -> None:
    """Workers outlive their tasks; what they have learnt need not."""
    global _KNOWN, _BEFORE
    _KNOWN, _BEFORE = {}, {}


def _slots(word: bytes) -> tuple[int, ...]:
    text = word.decode("utf-8", "replace")
    marks = "".join(c for c in text if not c.isalnum()) or " "
    core = text.strip(marks)
    tail = text[len(text.rstrip(marks)):]
    out = [core.lower().encode()] if core else []
    if len(core) > 1 and core.isupper():
        out.append(b"\x00upper")
    if tail not in ("", ".", ","):
        out.append(b"\x00tail" + tail[:3].encode())
    if not core:
        out.append(b"\x00mark" + text[:3].encode())
    elif not core.isalpha():
        out.append(b"\x00mixed")
    return tuple(xxhash.xxh3_64_intdigest(w) & (SLOTS - 1) for w in out)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every slot's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMENSIONS, (SLOTS, PLACES)).astype(np.int32), rng.choice([-1.0, 1.0], (SLOTS, PLACES))


def _contexts(batches):
    """Per task: the sums of neighbours' index vectors, and the counts, of the slots it has met."""
    places, signs = index_vectors()
    total, seen = np.zeros(SLOTS * DIMENSIONS), np.zeros(SLOTS, np.int64)
    for batch in batches:
        for part in slices(batch, 0, 2 << 20):
            slots, counts = words(part.column(0).cast(pa.binary()).to_pylist())
            seen += np.bincount(slots, minlength=SLOTS)
            owner = np.repeat(np.arange(len(counts)), counts)
            pairs = []
            for step in range(1, WINDOW + 1):
                near = owner[:-step] == owner[step:]
                pairs += [(slots[:-step][near], slots[step:][near]), (slots[step:][near], slots[:-step][near])]
            one, two = (np.concatenate(x) for x in zip(*pairs))
            for k in range(PLACES):
                total += np.bincount(one * DIMENSIONS + places[two, k], signs[two, k], SLOTS * DIMENSIONS)
    _forget()
    met = np.flatnonzero(seen)
    for start in range(0, len(met), 4096):
        some = met[start:start + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), pa.array(list(total.astype(np.int64).reshape(SLOTS, -1)[some]), pa.list_(pa.int64()))], ["slot", "n", "context"])


class Vectors(NamedTuple):
    matrix: np.ndarray
    weight: np.ndarray


def word_vectors(docs: DataFrame, text_column: str = "text") -> Vectors:
    """Unit vectors and rarity weights of all word slots, from every text; ``SLOTS`` rows whatever the corpus."""
    parts = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(_contexts, "slot long, n long, context array<long>")
    sums = [F.sum(F.element_at("context", i + 1)).alias(f"c{i}") for i in range(DIMENSIONS)]
    table = parts.groupBy("slot").agg(F.sum("n").alias("n"), *sums).toPandas()
    matrix, seen = np.zeros((SLOTS, DIMENSIONS)), np.zeros(SLOTS)
    matrix[table.slot.to_numpy()] = table[[f"c{i}" for i in range(DIMENSIONS)]].to_numpy()
    seen[table.slot.to_numpy()] = table.n.to_numpy()
    # The common direction of all contexts tells words apart no better than chance.
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
    share = seen / max(1.0, seen.sum())
    matrix -= share @ matrix
    return Vectors(matrix.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32))


WIDTH = 2 * DIMENSIONS + 6


def pooling_table(vectors: Vectors) -> np.ndarray:
    """What a word adds to its document: its weighted vector, the vector's squares and its weight."""
    return np.column_stack([vectors.matrix * vectors.weight[:, None], vectors.matrix ** 2, vectors.weight]).astype(np.float32)


def pooled(texts: list[bytes | None], table: np.ndarray) -> np.ndarray:
    """One row per text: weighted mean of its word vectors, their spread, and how long, varied, common, even, alike from word to word and repetitive it is. Zeros for a wordless one."""
    slots, counts = words(texts)
    out = np.zeros((len(texts), WIDTH), np.float32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts, n = (np.cumsum(counts) - counts)[full], counts[full]
    rows = table[slots]
    sums = np.add.reduceat(rows, starts)
    mean, spread, weight = sums[:, :DIMENSIONS] / sums[:, -1:], np.sqrt(sums[:, DIMENSIONS:-1] / n[:, None]), sums[:, -1]
    owner = np.repeat(np.arange(len(counts)), counts)
    distinct = np.bincount(np.unique(owner * SLOTS + slots) // SLOTS, minlength=len(counts))[full]
    again, near, beside = np.zeros(len(slots), np.float32), np.zeros(len(slots), np.float32), owner[1:] == owner[:-1]
    again[1:] = beside & (slots[1:] == slots[:-1])
    plain = rows[:, :DIMENSIONS] / rows[:, -1:]
    near[1:] = np.where(beside, np.einsum("ij,ij->i", plain[1:], plain[:-1]), 0)
    out[full] = np.column_stack([mean, spread, np.log1p(n), distinct / n, weight / n, np.linalg.norm(mean, axis=1), np.add.reduceat(near, starts) / n, np.add.reduceat(again, starts) / n])
    return out


class Network(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, calibration: tuple[np.ndarray, np.ndarray]) -> Network:
    """Adam on the cross-entropy; the temperature is the one that makes the calibration rows likeliest. One class or no rows: its smoothed share for all."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        width = x.shape[1]
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(SEED)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - center) / scale
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(share / (1 - share)))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            xs, ys = x[order[at:at + 256]], y[order[at:at + 256]]
            hidden = np.tanh(xs @ params[0] + params[1])
            gap = (1 / (1 + np.exp(-(hidden @ params[2] + params[3]))) - ys) / len(ys)
            back = np.outer(gap, params[2]) * (1 - hidden ** 2)
            grads = [xs.T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ gap + 1e-4 * params[2], gap.sum()]
            step += 1
            rate = 3e-3 * (1 - epoch / EPOCHS)
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * first[i] / (1 - 0.9 ** step) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    raw = Network(center, scale, params[0], params[1], params[2], float(params[3]), 1.0)
    cx, cy = calibration if len(calibration[1]) else (x * scale + center, y)
    logits = raw.logits(cx)

    def cost(t):
        z = logits / t
        return np.logaddexp(0, np.where(cy > 0, -z, z)).sum()

    return raw._replace(temperature=float(min(np.geomspace(0.25, 20, 120), key=cost)))


def remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def _drawn(labels: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` labels with the smallest hash of their id: the same ones in every run."""
    return labels.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, label_column: str = "quality", fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> tuple[Vectors, Network]:
    """Word vectors from all ``docs`` (doc_id, text); a network from at most ``fit_rows`` labelled rows whose id's remainder is 2, 3 or 4,
    calibrated on at most ``calibration_rows`` with remainder 1. Rows without an id or label teach nothing; of several labels of an id the largest holds."""
    vectors = word_vectors(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pooling_table(vectors))
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label")).dropna()
             .groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("part", remainder()))
    drawn = stored(_drawn(known.where("part > 1"), fit_rows).unionByName(_drawn(known.where("part = 1"), calibration_rows)), "labels")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 3, 1 << 20):
                rows = pooled(part.column(3).cast(pa.binary()).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "label", "part", "features"])

    found = (docs.join(drawn, "doc_id").select("doc_id", "label", "part", "text").mapInArrow(run, "doc_id long, label int, part long, features binary")).toPandas()
    found = found.assign(features=[bytes(f) for f in found.features]).sort_values(["doc_id", "features"])
    x = np.frombuffer(b"".join(found.features), np.float32).reshape(-1, WIDTH).astype(float)
    y, taught = (found.label > 0).to_numpy(float), (found.part > 1).to_numpy()
    return vectors, fit(x[taught], y[taught], (x[~taught], y[~taught]))


def score(docs: DataFrame, model: tuple[Vectors, Network], threshold: float = 0.3, text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on), in place of any columns so named; without the text if it is not kept."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast((pooling_table(model[0]), model[1]))
    names = docs.columns
    at = names.index(text_column)
    kept = [i for i in range(len(names)) if keep_text or i != at]

    def run(batches):
        table, network = shared.value
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(network.scores(pooled(part.column(at).cast(pa.binary()).to_pylist(), table)))],
                                                 [*(names[i] for i in kept), "score"])
        _forget()

    schema = StructType([docs.schema[i] for i in kept] + [StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (its id's remainder is 0), score and predicted per row.

    Only text is scored; labels, language, source and id are no inputs. Null, empty and wordless texts get the score of a text without
    words; a null id is not held out. Without labels, or with labels of one class, every row gets that class's smoothed share.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = score(texts, train(texts, labels, label_column), threshold, keep_text=False)
    return rows.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
