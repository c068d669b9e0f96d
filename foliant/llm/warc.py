"""WARC archives written and read by Spark: an index first, then coalesced byte ranges of the selected records.

The archives are plain WARC/1.1 files. Spark's text writer puts them down, with the record end as line separator, so they are
committed like any other output and reach any store that Spark writes to.
"""

from __future__ import annotations

import hashlib
import io
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import stored

END = "\r\n\r\n"
#: The most that one read fetches; a longer record is one read.
READ_BYTES = 4 << 20
#: Gaps between wanted records up to this many bytes are read over.
GAP_BYTES = 64 << 10
REVISIT_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*lines: Column) -> Column:
    """Header lines, those that are null left out, with the empty line that ends them."""
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END))


def _headers() -> Column:
    """The WARC and HTTP headers of a record, from page_id, url, digest, payload_bytes, record_type and refers_to."""
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")))
    revisit = F.col("record_type") == "revisit"
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:no-address")), "[\\x00-\\x20\\x7f]", "%20")
    warc = _lines(F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
                  F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
                  F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
                  F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), F.lit("Content-Type: application/http; msgtype=response"),
                  F.concat(F.lit("Content-Length: "), block.cast("string")))
    return F.concat(warc, http)


INDEX = "path string, offset long, length long, page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long"


def write_warc(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", archives: int | None = None) -> DataFrame:
    """Write one record per row under ``folder`` and return the index (``INDEX``), of what the committed archives hold.

    A null payload counts as empty, a null url is written as ``urn:no-address``. Of equal payloads of ``REVISIT_FROM`` bytes or more the rows
    with the largest id are responses (null ids count as smallest) and all others revisits of it; equality goes by SHA-1 and length.
    Each task's rows become one archive, so payloads are not shuffled; ``archives`` deals them over so many instead.
    """
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.sha1(payload).alias("digest"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"))
    groups = (rows.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("digest", "payload_bytes")
              .agg(F.max("page_id").alias("kept_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    groups = stored(groups.withColumn("grouped", F.lit(True)), "copies")
    again = F.col("grouped").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    typed = (rows.join(groups, ["digest", "payload_bytes"], "left").withColumn("record_type", F.when(again, "revisit").otherwise("response"))
             .withColumn("refers_to", F.when(again, F.col("kept_id"))))
    text = typed.select(F.concat(_headers(), F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))).alias("value"))
    (text if archives is None else text.repartition(archives)).write.option("lineSep", END).text(f"{folder}/archives")
    return index_archives(pages.sparkSession, f"{folder}/archives")


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all archives under ``folder``, stored. Each is read once in order, from header to header; payloads are passed over."""
    files = stored(spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "length"), "archives")

    def run(groups):
        for part in groups:
            for path in part.path:
                for some in _batched(_records(path), 2000):
                    yield pd.DataFrame(some, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return stored(files.repartition(max(1, files.count()), "path").mapInPandas(run, INDEX), "index")


def _batched(rows, n: int):
    rows = iter(rows)
    while some := list(islice(rows, n)):
        yield some


def _records(path: str):
    """Index rows of one archive."""
    mark = END.encode()
    with _open(path) as raw:
        size, at, f = raw.size(), 0, io.BufferedReader(raw, 1 << 20)
        while at < size:
            f.seek(at)
            head = b""
            while head.count(mark) < 2 and (line := f.readline()):
                head += line
            fields, length = _fields(head.split(mark)[0]), len(head.split(mark)[0]) + len(mark)
            length += int(fields["Content-Length"]) + len(mark)
            yield (path, at, length, _number(fields, "WARC-Record-ID"), fields["WARC-Target-URI"], fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                   _payload_bytes(head.split(mark)[1]), fields["WARC-Type"], _number(fields, "WARC-Refers-To"))
            at += length


def plan_reads(index: DataFrame, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """Coalesce the byte ranges of the ``index`` rows, in order of place: path, start, stop and the (offset, length) of each record in it."""
    order = Window.partitionBy("path").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order)
    cell = F.floor(F.col("offset") / read_bytes)
    fresh = F.when(gap.isNull() | (gap > gap_bytes) | (cell != F.lag(cell).over(order)), 1).otherwise(0)
    reads = index.select("path", "offset", "length", fresh.alias("fresh")).withColumn("read", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return reads.groupBy("path", "read").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
                                             F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name, "<urn:page:none>")[len("<urn:page:"):-1]
    return None if value == "none" else int(value)


def _payload_bytes(http: bytes) -> int:
    return next(int(line.split(":")[1]) for line in http.decode().split("\r\n") if line.lower().startswith("content-length:"))


def parse(record: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    warc, _, rest = record.partition(END.encode())
    fields = _fields(warc)
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != END.encode():
        raise ValueError(f"record {fields['WARC-Record-ID']} does not end where its length says")
    http, _, payload = block.partition(END.encode())
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return {"page_id": _number(fields, "WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": _payload_bytes(http), "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": _number(fields, "WARC-Refers-To"), "payload": None if revisit else payload}


def read_warc(index: DataFrame, payload: bool = True, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records of the ``index`` rows, from the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
    types = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}

    def run(groups):
        for reads in groups:
            for read in reads.sort_values(["path", "start"]).itertuples():
                with _open(read.path) as f:
                    f.seek(read.start)
                    data = f.read(read.stop - read.start)
                found = pd.DataFrame([parse(data[r["offset"] - read.start:r["offset"] - read.start + r["length"]]) for r in read.records])[names]
                yield found.astype({"page_id": "Int64", "refers_to": "Int64"})

    wanted = index.agg(F.sum("length")).first()[0] or 0
    reads = plan_reads(index, read_bytes, gap_bytes).repartition(max(1, -(-wanted // (8 * read_bytes))), "path", "read")
    return reads.mapInPandas(run, ", ".join(f"{n} {types.get(n, 'string')}" for n in names))
