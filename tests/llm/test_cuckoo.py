import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import cuckoo
from tests.llm.oracle import compare


def test_whole_table(spark, sf):
    assert compare(spark, sf, "op5_exact_dedup") == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (None, "a"), (None, "b"), (5, "b"), (None, "c"), (None, "c"), (6, "A"), (7, "x" * 3_000_000), (8, "x" * 3_000_000)]
    rows += [(100 + i, "hot") for i in range(3000)]
    got = cuckoo.exact_duplicates(spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, digest binary")).collect()
    ids = {}
    for doc_id, text in rows:
        ids.setdefault(text or "", []).append(doc_id)
    keep = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in v if i is not None), default=None), len(v)) for t, v in ids.items()}
    assert len(got) == len(rows) and all((r.keep_id, r.group_size) == keep[r.text_sha256] for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(ids) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    assert cuckoo.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_index_lives(spark):
    """Insert in two batches, delete some, look up: the index knows what is live."""
    rows = cuckoo.numbered(cuckoo.digests(spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2500).alias("text")), "text"), "rows")
    index = cuckoo.insert(cuckoo.empty_index(spark, 3), rows.where("doc_id < 2500"))
    index = cuckoo.insert(index, rows.where("doc_id >= 2500"))
    live = {k.digest: k.live for r in index.collect() for k in r["keys"]}
    assert len(live) == 2500 and sum(live.values()) == 4000
    index = cuckoo.delete(index, rows.where("doc_id < 2000"))
    assert cuckoo.lookup(index, rows.where("doc_id between 1500 and 1999")).count() == 0
    assert cuckoo.lookup(index, rows).count() == 2000


def test_overflow_grows_from_keys():
    index, names = cuckoo.ShardIndex(), [hashlib.sha256(str(i).encode()).digest() for i in range(30_000)]
    start = index.filter.buckets
    for at in range(0, len(names), 1000):
        index.add(names[at:at + 1000], [1] * 1000, list(range(at, at + 1000)))
    assert index.filter.buckets > start and all(index.found(names))
    strangers = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(30_000)]
    assert not any(index.found(strangers))
    assert index.filter.contains(index.hashes(strangers)).mean() < 0.001


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=300))
def test_filter_never_forgets(steps):
    """What is live is always found, whatever went in and out before."""
    keep, live = cuckoo.CuckooFilter(64), []
    for put, key in steps:
        h = np.array([key * 0x9E3779B97F4A7C15 % 2**64], np.uint64)
        if put and live.count(key) < 4:
            assert keep.insert(h)
            live.append(key)
        elif not put and key in live:
            keep.delete(h)
            live.remove(key)
        held = np.array([k * 0x9E3779B97F4A7C15 % 2**64 for k in set(live)], np.uint64)
        assert keep.contains(held).all()
