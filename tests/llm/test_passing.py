import glob
import os

import pytest

from foliant.llm.common import passing, stored
from foliant.llm.cuckoo import without_duplicates
from foliant.llm.minhash import without_near_duplicates
from foliant.llm.mixing import mixed


def there(table):
    return os.path.exists(table.stored_at.removeprefix("file://"))


def test_only_kept_tables_stay(spark):
    with passing() as keep:
        with passing() as keep_inner:
            gone, handed = stored(spark.range(3), "gone"), keep_inner(stored(spark.range(4), "handed"))
        assert handed.count() == 4 and not there(gone)
        kept = keep(stored(handed, "kept"))
    assert kept.count() == 4 and not there(handed)
    assert there(stored(spark.range(1), "outside"))


@pytest.mark.parametrize("stage", [without_duplicates, without_near_duplicates, mixed])
def test_stages_leave_what_their_rows_need(spark, sf, tmp_path, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("foliant.scratch", str(tmp_path))
    try:
        got = stage(docs)
    finally:
        spark.conf.unset("foliant.scratch")
    assert len(glob.glob(f"{tmp_path}/*")) <= 2 and got.count() == got.count() > 0
