"""Token ids in Parquet: list columns with delta or dictionary encoding, sized row groups, page indexes, selective reads."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import slices
from foliant.llm.encoding import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Text bytes behind one file.
FILE_BYTES = 64 << 20
#: Texts that a worker is given at a time at most; a task holds them several times over.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SCHEMA = "doc_id long, file_start long, n_tokens long, ids array<int>"


def _lists(data: list[bytes], tail: bytes) -> tuple[pa.ListArray, np.ndarray]:
    lengths = np.array([len(d) + len(tail) for d in data], np.int64) // 4
    values = np.frombuffer(b"".join([x for d in data for x in (d, tail)]), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values)), lengths


def _encode(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        own, before = encoder(path), 0
        for batch in batches:
            for part in slices(batch, 1):
                lists, lengths = _lists(own.ids(part.column(1).cast(pa.binary()).to_pylist()), tail)
                ends = np.cumsum(lengths) + before
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends - lengths), pa.array(lengths), lists], ["doc_id", "file_start", "n_tokens", "ids"])
                before = int(ends[-1])

    return docs.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int | None, id_column: str = "doc_id", text_column: str = "text",
                 file_bytes: int = FILE_BYTES, encoding: str = "delta") -> None:
    """Write every whole text of ``docs`` as ids, with ``end_id`` after each unless that is None, in ascending id order.

    Null ids come first, rows that share an id go in order of their text; null and empty texts have no ids of their own.
    ``folder/tokens`` holds one file per range of ids, their names ascending with it: doc_id, n_tokens, ids, and file_start, the
    ids of all rows before in that file. ``folder/files`` has one row per file: its name, its ids, and the ids of all files before.
    ``encoding``: "delta" stores ids as bit-packed differences per block, "dictionary" as indexes into each column chunk's own
    vocabulary. Texts, not ids, are dealt over the files, so each text is encoded once.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    spark = docs.sparkSession
    before = spark.conf.get(_BATCH)
    try:
        spark.conf.set(_BATCH, BATCH_ROWS)
        (_encode(dealt, path, end_id).write
         .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.writer.version", "PARQUET_2_0")
         .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
         .option("parquet.page.write-checksum.enabled", "true").option("compression", "zstd").parquet(f"{folder}/tokens"))
    finally:
        spark.conf.set(_BATCH, before)
    sizes = spark.read.schema(SCHEMA).parquet(f"{folder}/tokens").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/files")


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, ids. ``start``: the ids of all rows before, in all files.

    Filters on doc_id and n_tokens reach row groups and pages through their statistics; without ``ids`` the lists are not read.
    """
    tokens = spark.read.schema(SCHEMA).parquet(f"{folder}/tokens")
    files = spark.read.schema("file string, n_tokens long, offset long").parquet(f"{folder}/files").select("file", "offset")
    columns = ["n_tokens", *(["ids"] if ids else [])]
    return (tokens.select("doc_id", "file_start", *columns, F.col("_metadata.file_name").alias("file")).join(files, "file")
            .select("doc_id", (F.col("offset") + F.col("file_start")).alias("start"), *columns))


def with_crc32(tokens: DataFrame) -> DataFrame:
    """ids replaced by ``ids_crc32``: the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            # The ids where they are: a copy of a batch is tens of MB.
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).view(np.uint8))
            edges = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            sums = pa.array([zlib.crc32(data[a:b]) for a, b in zip(edges, edges[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), sums], [*kept, "ids_crc32"])

    kept = [c for c in tokens.columns if c != "ids"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids")
    return tokens.mapInArrow(run, f"{schema}, ids_crc32 long")
