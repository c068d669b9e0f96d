import random
from collections import defaultdict

import pytest

from foliant.llm.mixing import mix


def expected_targets(sizes, weights, cap):
    """sizes by source. Share by weight; what lies above a cap is shared anew among the others until nothing does."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if level * weight[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def check(rows, mine, weights=(1, 2, 3), cap=3):
    sizes = {s: 0 for _, _, s in rows}
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    targets = expected_targets(sizes, weights, cap)
    assert sorted((str(r.doc_id), r.size) for r in mine) == sorted((str(d), len((t or "").encode().split())) for d, t, _ in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in mine:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= cap * r.size and r.taken == r.copies * r.size
        whole = int(r.target / r.source_size + 1e-9) if r.source_size else 0
        assert r.size == 0 or abs(r.copies - whole) <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(1, largest[source] / 2)
    return {s: taken[s] / targets[s] for s in targets if targets[s]}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    mine = mix(docs).collect()
    near = check(rows, mine)
    assert all(abs(x - 1) < 0.05 for x in near.values())
    again = mix(docs.repartition(7)).drop("_row").collect()
    assert sorted(map(str, again)) == sorted(map(str, mix(docs).drop("_row").collect()))


def test_hot_source_caps_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 60), "big") for i in range(3000)] + [(5000 + i, "w " * rng.randint(1, 9), rng.choice(["a", "é", "𝒳", "￿", None])) for i in range(200)]
    rows += [(9000, None, "a"), (9001, "", None), (9002, " \n", "blank"), (None, "w w w", "a"), (9003, "same", "a"), (9003, "same", "a"), (9004, "w " * 20000, "one")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, size int")
    mine = mix(docs).collect()
    check(rows, mine)


def test_expectations_are_kept(spark):
    """Over seeds, every document is taken as often as its source's ratio says."""
    rows = [(i, "w " * (1 + 7 * i % 23), "ab"[i % 3 == 0]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    copies, ratio, runs = defaultdict(int), {}, 12
    for seed in range(runs):
        for r in mix(docs, seed=seed).collect():
            copies[r.source] += r.copies
            ratio[r.source] = r.target / r.source_size
    for source, n in (("a", 40), ("b", 20)):
        assert copies[source] / (runs * n) == pytest.approx(ratio[source], rel=0.08)


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_partitions_do_not_matter(spark):
    """Many chunks a source, rows that repeat ids, sizes and texts."""
    rng = random.Random(3)
    rows = [(i if i % 50 else 7, "w " * rng.randint(1, 60), "big" if i % 3 else "small") for i in range(4000)] + [(None, "w w", "big")] * 20 + [(8, "w w w", "small")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(str, mix(docs.repartition(n)).drop("_row").collect())) for n in (2, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == len(rows)
