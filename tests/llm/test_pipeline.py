"""Every stage of the pipeline on its own input, against a plain restatement."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from foliant.llm.common import stored
from foliant.llm.cuckoo import without_duplicates
from foliant.llm.minhash import without_near_duplicates
from foliant.llm.mixing import mixed
from foliant.llm.quality import classify
from tests.llm import brute
from tests.llm.test_mixing import expected_targets
from tests.llm.test_packing import check


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_each_stage(spark, sf):
    docs, tables = spark.read.parquet(f"{sf}/documents.parquet"), []
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        tables.append(docs)
    quality, exact, near, mix, packed = tables
    assert all(t.columns == first.columns for t in tables[:-1])

    good = {r.doc_id for r in classify(first, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted == 1}
    assert sorted(rows_of(quality), key=str) == sorted((r for r in rows_of(first) if r[0] in good), key=str) and good

    largest = {}
    for r in rows_of(quality):
        largest[r[1]] = max(largest.get(r[1], -1), r[0])
    assert sorted(r[0] for r in rows_of(exact)) == sorted(largest.values())

    kept = sorted(d for d, _, _, keep in brute.near_duplicates([(r[0], r[1]) for r in rows_of(exact)], 5, 4, 5) if keep)
    assert sorted(r[0] for r in rows_of(near)) == kept and len(kept) < exact.count() < quality.count()

    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows_of(near):
        sizes[r[3]] += len(r[1].encode().split())
        biggest[r[3]] = max(biggest[r[3]], len(r[1].encode().split()))
    for r in rows_of(mix):
        taken[r[3]] += len(r[1].encode().split())
    for source, target in expected_targets(sizes, (1, 2, 3), 3).items():
        assert abs(taken[source] - target) <= max(1, biggest[source] / 2)
    assert set(rows_of(mix)) <= set(rows_of(near)) and max(Counter(rows_of(mix)).values()) <= 3

    mine = packed.collect()
    assert check([(r[0], r[1]) for r in rows_of(mix)], mine, 4096, 1) <= -(-sum(r.length for r in mine) // 4096) + 1


def test_run_is_registered():
    from __spark_entry__ import queries

    assert queries()["pipeline"].__wrapped__ is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "source_mixing", "best_fit_packing"]


@pytest.mark.parametrize("stage", [without_duplicates, without_near_duplicates, mixed])
def test_stages_keep_columns_of_any_name(spark, stage):
    """Input columns named as the stages' own; null, empty, short and repeated rows; an empty table."""
    words = " ".join(f"x{i}" for i in range(40))
    rows = [(1, words, "a"), (2, words + " end", "a"), (3, words, "b"), (4, "a b c", "b"), (5, None, "a"), (6, "", None), (7, "lone words here and there", "b"), (None, "no id", "a")]
    columns = ["_row", "_copy", "_copies", "_gone", "kept", "copies", "_row_"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in columns)
    table = spark.createDataFrame([(*r, *[f"{c}{i}" for c in columns]) for i, r in enumerate(rows)], schema).repartition(8)
    got = stage(table)
    assert got.columns == table.columns
    found, known = [tuple(r) for r in got.collect()], {tuple(r) for r in table.collect()}
    assert set(found) <= known and found
    plain = stage(table.select("doc_id", "text", "source"))
    assert sorted((r[:3] for r in found), key=str) == sorted(map(tuple, plain.collect()), key=str)
    empty = stage(spark.createDataFrame([], schema))
    assert empty.columns == table.columns and empty.collect() == []
