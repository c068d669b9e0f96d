import zlib

import numpy as np
import pytest

from foliant.llm.queries import op4_token_files, tokenizer_path
from foliant.llm.token_files import read_tokens, with_crc32, write_tokens
from foliant.session import scratch


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(rows, tokenizer, end):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_token_files(spark, sf).collect())) == expected(rows, tokenizer, 2)


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_odd_rows_over_many_files(spark, tokenizer, encoding):
    rows = [(5, None), (5, ""), (5, "again"), (5, "again"), (None, "no id"), (1, "İstanbul's <|endoftext|>x <|startoftext|> don't '''s 12ab"),
            (2, "ΣΑΣ ß×÷ªº \x1c \x85x\x1dy é 한국어 漢字 اَلْعَرَبِيَّةُ 😀👍🏽 ﬁ"), (3, "word " * 60_000), (4, "x" * 5000), *[(i, f"row {i} of many") for i in range(10, 400)]]
    folder = scratch(spark, "tokens")
    docs = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, ids array<int>")
    write_tokens(docs, folder, tokenizer_path(), 2, file_bytes=20_000, encoding=encoding)
    assert sorted(map(str, map(tuple, with_crc32(read_tokens(spark, folder)).collect()))) == sorted(map(str, expected(rows, tokenizer, 2)))
    lengths = read_tokens(spark, folder, ids=False).where("doc_id between 20 and 30")
    assert lengths.count() == 11 and "ids" not in lengths.columns


def test_file_format(spark, tokenizer):
    import glob

    import pyarrow.parquet as pq

    folder = scratch(spark, "tokens")
    write_tokens(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), folder, tokenizer_path(), None)
    chunk = pq.ParquetFile(glob.glob(f"{folder.removeprefix('file://')}/tokens/*.parquet")[0]).metadata.row_group(0).column(3)
    assert "DELTA_BINARY_PACKED" in chunk.encodings and chunk.has_offset_index


def test_empty_table(spark):
    folder = scratch(spark, "tokens")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, tokenizer_path(), 2)
    assert read_tokens(spark, folder).collect() == []
