import __spark_entry__ as entry


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns


def test_other_queries_stay_without_the_optional_parts(monkeypatch):
    for gone in ("kinetiq.llm", "corpus_pipeline"):
        monkeypatch.setattr(entry, "_there", lambda name, gone=gone: name != gone)
        names = set(entry.queries())
        assert "d13_risk_status" in names and "pipeline" not in names
        assert not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_an_empty_folder_is_no_package(tmp_path, monkeypatch):
    (tmp_path / "hollow" / "__pycache__").mkdir(parents=True)
    monkeypatch.syspath_prepend(str(tmp_path))
    assert not entry._there("hollow") and not entry._there("no_such_module") and entry._there("kinetiq.plans")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
