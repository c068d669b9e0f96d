"""Exact duplicates by a cuckoo-filter index over digests: a miss is new for certain, a hit is checked against the stored keys.

The index is dealt over shards by digest. A shard is one row: a cuckoo filter (four 16-bit fingerprints to a bucket, two buckets to a
key) and the keys behind it, sorted by digest, each with its number of live rows and the largest id among them. Keys can be inserted and
deleted; when a filter has no room it grows and is filled again from its keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import free_name, numbered, passing, stored

SLOTS = 4
KICKS = 200
#: Digests behind one shard.
SHARD = 50_000
SALTS = 16
#: Share of a filter's slots that a new one leaves free.
ROOM = 0.3


class CuckooFilter:
    """Approximate membership of 64-bit hashes with insertion and deletion; ``insert`` returns False when it overflows."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), "<u2")
        self.rng = np.random.default_rng(buckets)

    @classmethod
    def for_keys(cls, n: int) -> "CuckooFilter":
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * (1 - ROOM)))))))

    @classmethod
    def load(cls, data: bytes) -> "CuckooFilter":
        found = cls(len(data) // (2 * SLOTS))
        found.table = np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()
        return found

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets; each bucket follows from the other and the fingerprint."""
        prints = (hashes >> np.uint64(48)).astype(np.uint64) % np.uint64(65535) + np.uint64(1)
        one = (hashes & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints.astype("<u2"), one, self.other(one, prints)

    def other(self, bucket, prints):
        with np.errstate(over="ignore"):
            step = np.asarray(prints, np.uint64) * np.uint64(0x5BD1E995A7C15F39) >> np.uint64(16)
        return bucket ^ (step & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(hashes)
        return ((self.table[one] == prints[:, None]) | (self.table[two] == prints[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> bool:
        """Put the hashes in, whether present or not. Free slots are filled in bulk; the rest move others out of their way."""
        prints, one, two = self.places(hashes)
        waiting = np.arange(len(prints))
        for bucket in (one, two):
            for slot in range(SLOTS):
                free = waiting[self.table[bucket[waiting], slot] == 0]
                _, first = np.unique(bucket[free], return_index=True)
                taken = free[first]
                self.table[bucket[taken], slot] = prints[taken]
                waiting = np.setdiff1d(waiting, taken, assume_unique=True)
        return all(self._push(int(prints[i]), int(two[i])) for i in waiting.tolist())

    def _push(self, mark: int, bucket: int) -> bool:
        for _ in range(KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return True
            slot = int(self.rng.integers(SLOTS))
            mark, row[slot] = int(row[slot]), mark
            bucket = int(self.other(np.int64(bucket), np.uint64(mark)))
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Take one copy of each hash out. Only what was inserted may be deleted."""
        for mark, one, two in zip(*(x.tolist() for x in self.places(hashes))):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


class ShardIndex:
    """One shard: the filter, and the keys it stands for, by bucket of their hash. ``live`` counts a key's rows."""

    def __init__(self, digests: list[bytes] = (), live: list[int] = (), largest: list[int | None] = (), table: bytes | None = None):
        self.live = dict(zip(digests, live))
        self.largest = dict(zip(digests, largest))
        self.filter = CuckooFilter.load(table) if table else CuckooFilter.for_keys(1024)

    @staticmethod
    def hashes(digests: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join([d[:8] for d in digests]), "<u8")

    def add(self, digests: list[bytes], counts: list[int], ids: list[int | None]) -> None:
        """Merge distinct ``digests``. Misses are new; hits are looked up among the keys, where a false one turns out new as well."""
        hits = self.filter.contains(self.hashes(digests)).tolist()
        new = []
        for digest, n, largest, hit in zip(digests, counts, ids, hits):
            if hit and digest in self.live:
                self.live[digest] += n
                self.largest[digest] = max((x for x in (self.largest[digest], largest) if x is not None), default=None)
            else:
                self.live[digest], self.largest[digest] = n, largest
                new.append(digest)
        if new and not self.filter.insert(self.hashes(new)):
            self.grow()

    def grow(self) -> None:
        """A larger filter, filled from the stored keys; larger again while it overflows."""
        keys = self.hashes(list(self.live))
        size = max(2 * self.filter.buckets, CuckooFilter.for_keys(2 * len(keys)).buckets)
        while True:
            self.filter = CuckooFilter(size)
            if self.filter.insert(keys):
                return
            size *= 2

    def remove(self, digests: list[bytes], counts: list[int]) -> None:
        """Take rows away; a key without rows leaves the filter and the shard. Unknown digests are left alone."""
        gone = []
        for digest, n, hit in zip(digests, counts, self.filter.contains(self.hashes(digests)).tolist()):
            if hit and digest in self.live:
                self.live[digest] -= n
                if self.live[digest] <= 0:
                    del self.live[digest], self.largest[digest]
                    gone.append(digest)
        if gone:
            self.filter.delete(self.hashes(gone))

    def found(self, digests: list[bytes]) -> list[bool]:
        return [hit and d in self.live for d, hit in zip(digests, self.filter.contains(self.hashes(digests)).tolist())] if digests else []


KEYS = "digest binary, live long, largest long"
INDEX = f"shard int, filter binary, keys array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in KEYS.split(', '))}>>"


def digests(rows: DataFrame, column: str) -> DataFrame:
    """``digest`` (SHA-256 of the text's UTF-8; null counts as empty) in place of the text."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")), 256))).drop(column)


def _partial(rows: DataFrame, shards: int) -> DataFrame:
    """shard, digest, n, largest: rows summed by digest and one of ``SALTS`` salts, in each task before the shuffle, so that the copies of a hot digest come to few rows."""
    salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS))
    sums = rows.groupBy("digest", salt.alias("salt")).agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"))
    return sums.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", "n", "largest")


def _load(state: pa.Table) -> ShardIndex:
    if not state.num_rows:
        return ShardIndex()
    keys = state.column("keys").combine_chunks().flatten()
    return ShardIndex(*(keys.field(c).to_pylist() for c in ("digest", "live", "largest")), state.column("filter")[0].as_py())


def _dump(shard: int, index: ShardIndex) -> pa.Table:
    names = sorted(index.live)
    keys = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array([index.live[d] for d in names], pa.int64()),
                                       pa.array([index.largest[d] for d in names], pa.int64())], ["digest", "live", "largest"])
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([index.filter.dump()], pa.binary()),
                     "keys": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), keys)})


def _applied(change):
    """A cogrouped step: load the shard, apply ``change`` to it batch by batch, write it back."""
    def run(key: tuple[pa.Scalar, ...], state: pa.Table, rows: pa.Table) -> pa.Table:
        index = _load(state)
        for start in range(0, rows.num_rows, 10_000):
            part = rows.slice(start, 10_000).group_by("digest").aggregate([("n", "sum"), ("largest", "max")])
            change(index, part.column("digest").to_pylist(), part.column("n_sum").to_pylist(), part.column("largest_max").to_pylist())
        return _dump(key[0].as_py(), index)

    return run


def shards_for(rows: int) -> int:
    return max(1, -(-rows // SHARD))


def empty_index(spark: SparkSession, shards: int) -> DataFrame:
    none = F.from_json(F.lit("[]"), INDEX.partition("keys ")[2])
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(CuckooFilter.for_keys(1024).dump()).alias("filter"), none.alias("keys"))


def _changed(index: DataFrame, rows: DataFrame, change) -> DataFrame:
    shards = index.count()
    return stored(index.groupBy("shard").cogroup(_partial(rows, shards).groupBy("shard")).applyInArrow(_applied(change), INDEX), "index")


def insert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with ``rows`` (_row, doc_id, digest) added."""
    return _changed(index, rows, lambda i, d, n, ids: i.add(d, n, ids))


def delete(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with ``rows`` taken away; the largest id of a digest that stays live is that of all rows it ever had."""
    return _changed(index, rows, lambda i, d, n, ids: i.remove(d, n))


def lookup(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The digests of ``rows`` that are live."""
    def run(key: tuple[pa.Scalar, ...], state: pa.Table, asked: pa.Table) -> pa.Table:
        names = asked.group_by("digest").aggregate([]).column("digest").to_pylist()
        return pa.table({"digest": pa.array([d for d, live in zip(names, _load(state).found(names)) if live], pa.binary())})

    return index.groupBy("shard").cogroup(_partial(rows, index.count()).groupBy("shard")).applyInArrow(run, "digest binary")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 per row; of rows with identical texts one stays, that with the largest id.

    A null text counts as empty, a null id as smaller than any other; of rows that share text and id one stays. Extra columns are ignored.
    Texts are told apart by SHA-256; the index decides which digests are shared, and only those rows are joined to their group.
    """
    rows = numbered(digests(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), "text"), "digests")
    return _grouped(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _grouped(rows: DataFrame) -> DataFrame:
    """keep_id, group_size and kept beside ``rows`` (_row, doc_id, digest)."""
    index = insert(empty_index(rows.sparkSession, shards_for(rows.count())), rows)
    groups = stored(index.select(F.explode("keys").alias("k")).select("k.digest", F.col("k.live").alias("group_size"), F.col("k.largest").alias("keep_id")).where("group_size > 1"), "groups")
    heads = rows.join(groups, "digest").where("doc_id <=> keep_id").groupBy("digest").agg(F.min("_row").alias("head"))
    groups = stored(groups.join(heads, "digest"), "groups")
    return (rows.join(groups, "digest", "left")
            .select("_row", "doc_id", "digest", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("head") == F.col("_row"), F.lit(True)).alias("kept")))


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns, whatever their names."""
    row = free_name(docs, "_row")
    with passing() as keep:
        table = keep(numbered(docs, "documents", row, "zstd"))
        rows = stored(digests(table.select(F.col(row).alias("_row"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), "text"), "digests")
        gone = keep(stored(_grouped(rows).where("NOT kept").select(F.col("_row").alias(row)), "gone"))
    return table.join(gone, row, "left_anti").drop(row)
