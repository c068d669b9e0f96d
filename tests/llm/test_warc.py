import glob
import hashlib

from foliant.llm.warc import plan_reads, read_warc, write_warc
from foliant.session import scratch
from tests.llm.oracle import compare


def test_whole_table(spark, sf):
    assert compare(spark, sf, "op3_warc_archives") == spark.read.parquet(f"{sf}/pages.parquet").count()


def brute(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        kept = max((p for p, _, h in rows if (h or "").encode() == data), key=lambda p: (p is not None, p or 0))
        again = len(data) >= 1000 and page_id != kept
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=str)


def test_odd_rows_and_selected_ranges(spark):
    same, tricky = "é" * 800, "a\r\n\r\nWARC/1.1\r\n\r\n" * 100
    rows = [(1, "http://a/1", same), (2, "http://a/2", same), (3, None, same), (3, None, same), (4, "http://x y\r\nInjected: 1", tricky), (5, "u", None), (6, "u", ""), (7, "u", ""),
            (8, "u", "z" * 999), (9, "u", "z" * 999), (10, "u", "L" * 9_000_000), (None, "u", same), (None, "u", "n" * 2000), (None, "u", "n" * 2000)]
    rows += [(100 + i, f"http://b/{i}", f"<p>{i}</p>" * (i % 90)) for i in range(200)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, archive int")
    folder = scratch(spark, "warc")
    index = write_warc(pages, folder, archives=5)
    back = read_warc(index, read_bytes=1 << 16)
    named = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()], key=str)
    assert named == brute(rows)
    texts = {r.page_id: r.payload for r in back.where("record_type = 'response'").collect()}
    assert all(texts[p] == (h or "").encode() for p, _, h in rows if p in texts and p is not None)
    some = read_warc(index.where("page_id between 120 and 130"), gap_bytes=0)
    assert sorted(r.page_id for r in some.collect()) == list(range(120, 131))
    assert plan_reads(index).count() < index.count() / 3
    data = b"".join(open(f, "rb").read() for f in glob.glob(folder.removeprefix("file://") + "/archives/*.txt"))
    assert data.count(b"\r\nWARC-Record-ID: ") == len(rows) and b"\r\nInjected" not in data


def test_empty_table(spark):
    assert read_warc(write_warc(spark.createDataFrame([], "page_id long, url string, html string"), scratch(spark, "warc"))).collect() == []
