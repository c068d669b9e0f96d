"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on distributed islands.

Pieces are dealt into shards of bounded size. Each shard is evolved on several islands, each with its own population of whole
packings: crossover puts well-filled bins of one parent into the other, drops the bins that share a piece with them, and best-fits
the displaced pieces. Between epochs the elite of each island moves on to the next one. What the best packing of a shard leaves in
poorly filled bins goes to the next level, whose shards gather the leftovers of many.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import numbered, slices, stored
from foliant.llm.encoding import KEPT, encoder

SHARD = 1500
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
#: Bins filled less than this are packed anew at the next level.
WELL_FILLED = 0.995


def pieces(docs: DataFrame, path: str, end_id: int | None, capacity: int, id_column: str = "doc_id", text_column: str = "text", kept: int = KEPT) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids_crc32: each text's ids and ``end_id``, cut every ``capacity`` ids."""
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        own = encoder(path, kept)
        for batch in batches:
            for part in slices(batch, 1):
                owner, piece, length, crc = [], [], [], []
                for i, ids in enumerate(own.ids(part.column(1).cast(pa.binary()).to_pylist())):
                    ids += tail
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at:at + 4 * capacity]
                        owner.append(i)
                        piece.append(n)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                order = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(order, pa.int32()), pa.array(order * capacity),
                                                  pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return (docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def best_fit(items, sizes, capacity: int, bins: list[list[int]], fill: list[int]) -> None:
    """Put ``items``, in order, into the fullest bin that still takes each, opening bins as needed."""
    room = sorted((capacity - f, i) for i, f in enumerate(fill) if f < capacity)
    for item in items:
        need = sizes[item]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, i = room.pop(at)
        else:
            left, i = capacity, len(bins)
            bins.append([])
            fill.append(0)
        bins[i].append(item)
        fill[i] += need
        if left > need:
            insort(room, (left - need, i))


def fitness(bins, fill, capacity: int) -> tuple[int, float]:
    """Fewer bins first; of as many, the more uneven filling, which leaves room together."""
    return -len(bins), sum(f * f for f in fill) / capacity ** 2


def crossover(one, other, sizes, capacity: int, rng: random.Random):
    """``one`` with well-filled bins of ``other`` put in; bins that share a piece with those go, and their other pieces are best-fitted."""
    (bins, fill), (given, given_fill) = one, other
    ranked = sorted(range(len(given)), key=lambda i: -given_fill[i])
    chosen = [i for i in ranked[:max(1, len(ranked) * 2 // 3)] if rng.random() < 0.5]
    injected = {x for i in chosen for x in given[i]}
    new, new_fill, displaced = [given[i] for i in chosen], [given_fill[i] for i in chosen], []
    for b, f in zip(bins, fill):
        if injected.isdisjoint(b):
            new.append(b)
            new_fill.append(f)
        else:
            displaced += [x for x in b if x not in injected]
    return repair(new, new_fill, displaced, sizes, capacity)


def mutate(one, sizes, capacity: int, rng: random.Random):
    """Empty the worst bins and a few others, and best-fit their pieces."""
    bins, fill = one
    order = sorted(range(len(bins)), key=lambda i: fill[i])
    out = set(order[:max(1, len(bins) // 50)]) | {rng.randrange(len(bins)) for _ in range(max(2, len(bins) // 20))}
    return repair([b for i, b in enumerate(bins) if i not in out], [f for i, f in enumerate(fill) if i not in out],
                  [x for i in out for x in bins[i]], sizes, capacity)


def replace(bins, fill, items: list[int], sizes, capacity: int) -> list[int]:
    """Trade one or two pieces of a bin for one or two larger displaced ones that fill it better; what is left displaced."""
    for i, f in enumerate(fill):
        if f == capacity or not items:
            continue
        few = items[:24]
        offers = sorted([(sizes[x], (x,)) for x in few] + [(sizes[x] + sizes[y], (x, y)) for x, y in combinations(few, 2)])
        takes = [(0, ())] + [(sizes[x], (x,)) for x in bins[i][:12]] + [(sizes[x] + sizes[y], (x, y)) for x, y in combinations(bins[i][:12], 2)]
        best = (0, (), ())
        for size, out in takes:
            at = bisect_left(offers, (size + capacity - f + 1,)) - 1
            if at >= 0 and offers[at][0] - size > best[0]:
                best = (offers[at][0] - size, out, offers[at][1])
        if best[0]:
            gain, out, into = best
            bins[i] = [x for x in bins[i] if x not in out] + list(into)
            fill[i] += gain
            items = [x for x in items if x not in into] + list(out)
    return items


def repair(bins, fill, items, sizes, capacity: int):
    bins, fill = [list(b) for b in bins], list(fill)
    if bins:
        items = replace(bins, fill, sorted(items, key=lambda x: -sizes[x]), sizes, capacity)
    best_fit(sorted(items, key=lambda x: -sizes[x]), sizes, capacity, bins, fill)
    return bins, fill


def evolve(sizes: list[int], capacity: int, population: list, rng: random.Random, generations: int = GENERATIONS):
    """The population after some generations, best first. It ends early once no packing can have fewer bins."""
    least = -(-sum(sizes) // capacity)

    def rank(p):
        return sorted(p, key=lambda x: fitness(*x, capacity), reverse=True)[:POPULATION]

    if not population:
        order = sorted(range(len(sizes)), key=lambda x: -sizes[x])
        population = [repair([], [], order, sizes, capacity)]
    population = rank(population)
    for _ in range(generations):
        if len(population[0][0]) <= least:
            break
        while len(population) < POPULATION:
            population.append(mutate(population[0], sizes, capacity, rng))
        children = []
        for one in population:
            child = crossover(one, rng.choice(population), sizes, capacity, rng)
            children.append(mutate(child, sizes, capacity, rng) if rng.random() < 0.5 else child)
        population = rank(population + children)
    return population


def _pack_out(bins, n: int) -> bytes:
    where = np.empty(n, "<i4")
    for i, b in enumerate(bins):
        where[b] = i
    return where.tobytes()


def _unpack(where: bytes, sizes: np.ndarray):
    place = np.frombuffer(where, "<i4")
    bins = [[] for _ in range(int(place.max()) + 1)]
    for item, i in enumerate(place.tolist()):
        bins[i].append(item)
    return bins, np.bincount(place, sizes).astype(int).tolist()


STATE = "shard long, island int, rank int, bins int, squares double, sizes binary, rows binary, packing binary"


def _epoch(capacity: int, epoch: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shard, island = (int(x) for x in key)
        rng = random.Random((shard * 31 + island) * 31 + epoch)
        sizes = np.frombuffer(group.sizes.iloc[0], "<i4")
        items = sizes.tolist()
        population = [_unpack(p, sizes) for p in sorted(p for p in group.packing if p)]
        population = evolve(items, capacity, population, rng)
        rows = []
        for rank, (bins, fill) in enumerate(population):
            n, squares = fitness(bins, fill, capacity)
            rows.append((shard, island, rank, -n, squares, group.sizes.iloc[0], group.rows.iloc[0], _pack_out(bins, len(items))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])

    return run


def _gather(shard: pd.DataFrame) -> pd.DataFrame:
    """One state row per shard: sizes and row ids of its pieces, the longest first."""
    shard = shard.sort_values(["length", "_row"], ascending=[False, True])
    return pd.DataFrame([(int(shard["shard"].iloc[0]), 0, 0, 0, 0.0, shard.length.to_numpy("<i4").tobytes(), shard["_row"].to_numpy("<i8").tobytes(), b"")],
                        columns=[c.split()[0] for c in STATE.split(", ")])


def _placed(groups):
    """Best packings spread to one row per piece: bins numbered in their shard, with how full they are."""
    for part in groups:
        for row in part.itertuples():
            sizes, place = np.frombuffer(row.sizes, "<i4").astype(np.int64), np.frombuffer(row.packing, "<i4")
            order = np.lexsort((np.arange(len(place)), place))
            first = np.flatnonzero(np.diff(place[order], prepend=-1))
            ends = np.cumsum(sizes[order])
            starts = ends - sizes[order]
            offset = starts - np.repeat(starts[first], np.diff(np.append(first, len(order))))
            yield pd.DataFrame({"_row": np.frombuffer(row.rows, "<i8")[order], "shard": row.shard, "bin": place[order].astype(np.int64), "offset": offset,
                                "length": sizes[order], "fill": np.bincount(place, sizes).astype(np.int64)[place[order]]})


def _level(items: DataFrame, shards: int, capacity: int, level: int) -> DataFrame:
    """Pack (_row, length) into bins, shard by shard: _row, shard, bin, offset, length, fill."""
    dealt = items.select("_row", "length", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(shards)).alias("shard"))
    state = dealt.groupBy("shard").applyInPandas(_gather, STATE)
    islands = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))
    state = state.withColumn("island", islands)
    for epoch in range(EPOCHS):
        state = state.groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch), STATE)
        if epoch + 1 < EPOCHS:
            # Elites also go to the next island; each row is used once, so both copies come from one explode.
            there = F.when(F.col("rank") == 0, F.array("island", (F.col("island") + 1) % ISLANDS)).otherwise(F.array("island"))
            state = state.withColumn("island", F.explode(there))
    best = Window.partitionBy("shard").orderBy("bins", F.desc("squares"), "island", "rank")
    best = state.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return best.mapInPandas(_placed, "_row long, shard long, bin long, offset long, length long, fill long")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int | None = 1, id_column: str = "doc_id", text_column: str = "text",
         shard: int = SHARD, kept: int = KEPT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row.

    Null and empty texts are their end id alone. Only texts longer than ``capacity`` are cut; full pieces are sequences of their own.
    Rows that repeat an id are packed as rows of their own. Offsets are gapless from 0 in each sequence. ``kept``: words a worker remembers.
    """
    table = numbered(pieces(docs, path, end_id, capacity, id_column, text_column, kept).where("length > 0"), "pieces")
    done = table.where(F.col("length") >= capacity).select("_row", (F.col("_row") * 64).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, level = table.where(F.col("length") < capacity).select("_row", "length"), 0
    count = left.count()
    while count:
        level += 1
        shards = -(-count // shard)
        placed = stored(_level(left, shards, capacity, level), "packed")
        kept, rest = placed, None
        if shards > 1 and level < 30:
            full = F.col("fill") >= int(capacity * WELL_FILLED)
            kept, rest = placed.where(full), placed.where(~full)
        # Levels count from 1 below 64, so ids of different levels and of full pieces differ.
        done = done.unionByName(kept.select("_row", ((F.col("shard") * 65536 + F.col("bin")) * 64 + level).alias("sequence_id"), "offset"))
        after = rest.count() if rest is not None else 0
        if rest is not None and after == count:
            return _joined(table, done.unionByName(rest.select("_row", ((F.col("shard") * 65536 + F.col("bin")) * 64 + level).alias("sequence_id"), "offset")))
        left, count = (rest.select("_row", "length") if rest is not None else None), after
    return _joined(table, done)


def _joined(table: DataFrame, places: DataFrame) -> DataFrame:
    return table.join(places, "_row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
