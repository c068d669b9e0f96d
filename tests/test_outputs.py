"""What the outputs of a run share is made once."""

from foliant.plans import derived, outputs

FOLDER = "/root/testdata/sf0.001"


def test_discrepancies_are_found_once(spark, tmp_path, monkeypatch):
    seen, plain = [], outputs.sort_discrepancies
    for name in ("write_complete_csv", "write_minimal_csv", "write_run_json", "write_stats"):
        monkeypatch.setattr(outputs.writers, name, lambda *rest, **options: None)
    monkeypatch.setattr(outputs, "sort_discrepancies", lambda df: seen.append(df) or plain(df))
    pages = derived.pages(spark, FOLDER)
    outputs.run_outputs(pages, derived.PAGE_FIELDS, str(tmp_path), data_only=True)
    assert "orders.parquet" not in seen[0]._jdf.queryExecution().executedPlan().toString() and seen[0].count() > 0
