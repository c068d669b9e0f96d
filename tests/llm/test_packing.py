import random
import zlib
from collections import defaultdict

import numpy as np

from foliant.llm import packing
from foliant.llm.queries import op9_best_fit_packing, tokenizer_path


def check(rows, mine, capacity, end):
    """Every piece once, with its ids; sequences gapless and within capacity. The number of sequences."""
    from tokenizers import Tokenizer

    tokenizer, expected = Tokenizer.from_file(tokenizer_path()), []
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        expected += [(doc_id, n, at, len(ids[at:at + capacity]), zlib.crc32(ids[at:at + capacity].tobytes())) for n, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in mine))) == sorted(map(str, expected))
    sequences = defaultdict(list)
    for r in mine:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    mine = op9_best_fit_packing(spark, sf).collect()
    assert check(rows, mine, 4096, 1) <= -(-sum(r.length for r in mine) // 4096) + 1


def test_odd_rows_over_several_levels(spark):
    rng = random.Random(5)
    rows = [(i, "a " * rng.randint(0, 150)) for i in range(300)]
    rows += [(1, None), (1, ""), (None, "a b"), (7, "a " * 1000), (7, "a " * 1000), (8, "a " * 63), (9, "a " * 64)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    mine = packing.pack(docs, tokenizer_path(), capacity=64, end_id=1, shard=40).collect()
    assert check(rows, mine, 64, 1) <= 1.03 * -(-sum(r.length for r in mine) // 64)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


def test_evolution_beats_best_fit():
    """Triplets that fill bins exactly: best-fit decreasing wastes bins, the evolved packing wastes fewer."""
    gains = 0
    for seed in range(5):
        rng, sizes = random.Random(seed), []
        for _ in range(40):
            a = rng.randint(380, 490)
            b = rng.randint(250, (1000 - a) // 2)
            sizes += [a, b, 1000 - a - b]
        first = packing.repair([], [], sorted(range(len(sizes)), key=lambda x: -sizes[x]), sizes, 1000)
        best = packing.evolve(sizes, 1000, [], rng, generations=60)[0]
        assert sorted(x for b in best[0] for x in b) == list(range(len(sizes)))
        assert all(sum(sizes[x] for x in b) == f <= 1000 for b, f in zip(*best))
        assert len(best[0]) <= len(first[0])
        gains += len(first[0]) - len(best[0])
    assert gains > 0
