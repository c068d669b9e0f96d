import random

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import minhash
from tests.llm import brute


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, similarity in ((3, (85, 100)), (5, (4, 5))):
        mine = minhash.near_duplicates(docs, shingle=k, similarity=similarity).collect()
        assert sorted(map(tuple, mine)) == sorted(brute.near_duplicates(rows, k, *similarity))


def test_chains_and_odd_rows(spark):
    """Chains of small edits reach over many components; nulls, blanks, short and repeated rows keep a defined place."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for group in range(6):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(25):
            text = list(text)
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two"), (905, "one"), (906, "x " * 30000), (None, "alone here today now"), (907, "one two"), (907, "one two")]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, node string")
    mine = minhash.near_duplicates(docs, shingle=3, similarity=(85, 100)).collect()
    theirs = brute.near_duplicates(rows, 3, 85, 100)
    assert sorted(map(str, map(tuple, mine))) == sorted(str((a, b, c, a == c)) for a, b, c, _ in theirs)
    assert len({r.component_id for r in mine if r.doc_id is not None and r.doc_id < 900}) < 120


def test_connected_nodes_are_not_met_again(spark, monkeypatch):
    """The second search is for links between components; a chain of links makes one, whatever its ends show."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    text = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):
        text = list(text)
        for _ in range(2):
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    kept, plain = {}, minhash.stored

    def stored(df, name, *rest):
        kept.setdefault(name, []).append(plain(df, name, *rest))
        return kept[name][-1]

    monkeypatch.setattr(minhash, "stored", stored)
    mine = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, similarity=(85, 100)).collect()
    assert sorted(map(tuple, mine)) == sorted(brute.near_duplicates(rows, 3, 85, 100))
    links = [tuple(r) for r in kept["links"][0].collect()]
    again = [tuple(r) for r in kept["rest"][0].collect()]
    place = {n: i for i, n in enumerate({n for pair in links + again for n in pair})}
    roots = brute.components(len(place), [(place[a], place[b]) for a, b in links])
    assert links and all(roots[place[a]] != roots[place[b]] for a, b in again)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_are_taken_apart_in_small_slices():
    """What a worker holds beside its batch follows the slice; the sketches are those of the whole."""
    texts = [" ".join(f"w{i}x{j}" for j in range(9000)) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": texts})
    parts = list(minhash._describe([batch], 3))
    assert batch.nbytes > 2_000_000 and len(parts) >= 3
    alone = minhash.sketches(minhash.shingle_sets([texts[7].encode()], 3))
    assert [s for p in parts for s in p.column(3).to_pylist()][7] == alone[0].tobytes()


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(40)]
    for j in (0.2, 0.6, 0.9):
        # Both sets have s elements and share c of them: j = c / (2 s - c).
        s = 1000
        c = round(2 * s * j / (1 + j))
        a, b = [x[:s] for x in sets], [np.concatenate([x[:c], x[s:2 * s - c]]) for x in sets]
        ka, kb = minhash.sketches(a), minhash.sketches(b)
        size = np.full(40, float(s))
        assert abs(minhash.estimate(ka, kb, size, size).mean() - j) < 0.03
        assert (minhash.merge(ka, kb) == minhash.sketches([np.union1d(x, y) for x, y in zip(a, b)])).all()


@pytest.mark.parametrize("k", range(2, 8))
def test_batches_of_few_words(k):
    """A batch may hold fewer words than a shingle."""
    for n in range(k + 2):
        sets = minhash.shingle_sets([b" ".join(b"w%d" % i for i in range(n))], k)
        assert len(sets) == 1 and len(sets[0]) == (0 if n == 0 else max(1, n - k + 1))
