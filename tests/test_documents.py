"""Many documents in few files."""

import json
import os

from foliant.sources import readers
from tests.test_sources import document

FOLDER = "/root/testdata/sf0.001"


def data_files(path):
    return [n for _, _, names in os.walk(path.removeprefix("file:")) for n in names if n.startswith("part-")]


def test_indented_documents_share_a_file(spark, tmp_path):
    texts = [json.dumps(document(n, 3 + n), indent=2) for n in range(3)] + ['{"pdf_path": "b",\n "pages": [']
    (tmp_path / "several.json").write_text(readers.DOCUMENT_END.join(texts) + readers.DOCUMENT_END)
    (tmp_path / "one.json").write_text(json.dumps(document(9, 1), indent=2) + "\n")
    reports = readers.read_run_json(spark, str(tmp_path), sequence=True)
    assert sorted((r.pdf_path, len(r.pages)) for r in reports.collect()) == [(f"a/scan_{n}.pdf", 3 + n) for n in range(3)] + [("a/scan_9.pdf", 1)]
    bad = readers.unreadable_reports(spark, str(tmp_path), sequence=True).collect()
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in bad] == [("several.json", texts[3])]


def test_report_documents_leave_no_file_for_each(spark):
    from catalog.files import report_documents

    path = report_documents(spark, FOLDER, True)
    assert readers.read_run_json(spark, path, sequence=True).count() > 100 > len(data_files(path))


def test_index_documents_share_a_file(spark, tmp_path):
    part = [{"version": 2, "partes": [{"pdf": f"p-{n}.pdf", "revisar": n == 2, "paginas": [{"separador": "S"}, {"archivo": "a.pdf", "pagina": n}]}]} for n in (1, 2)]
    (tmp_path / "index.json").write_text("".join(json.dumps(p, indent=1) + readers.DOCUMENT_END for p in part))
    (tmp_path / "alone.json").write_text(json.dumps({"pdf": "p-3.pdf", "paginas": [{"archivo": "a.pdf", "pagina": "3"}]}))
    got = readers.read_delivery_index(spark, str(tmp_path)).collect()
    assert sorted((r.pdf, r.seq, r.separator, r.page, r.is_review) for r in got) == [
        ("p-1.pdf", 1, "S", 0, False), ("p-1.pdf", 2, "", 1, False), ("p-2.pdf", 1, "S", 0, True), ("p-2.pdf", 2, "", 2, True), ("p-3.pdf", 1, "", 3, False)]
