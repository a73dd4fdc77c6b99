"""Work is shared by tasks and done once, whatever the layout of the given tables."""

import pytest

from gatewarden import corpus
from gatewarden.operators.scan import scan
from gatewarden.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    """Orders in one file with one row group, and some documents."""
    orders = [(i, i * 3) for i in range(60)] + [(7, 21)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    documents = [(i, f"echo {i}\nmake", "web") for i in range(20)] + [(20, None, "web")]
    spark.createDataFrame(documents, "doc_id long, text string, source string").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    return str(tmp_path)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_files_of_one_row_group_are_derived_by_many_tasks(spark, tables, monkeypatch):
    whole = _rows(corpus.workflow_files(spark, tables))
    monkeypatch.setattr(corpus, "ROWS_PER_TASK", 10)
    files = corpus.workflow_files(spark, tables)
    sizes = files.where("repo_ord >= 0").rdd.glom().map(len).collect()
    assert max(sizes) < 30
    assert _rows(files) == whole


def test_own_rules_scan_once(spark, tables):
    found = catalog.QUERIES["scan_own_rules"](spark, tables)
    # What is returned reads the findings as written, not the tables.
    assert not [f for f in found.inputFiles() if "/orders.parquet" in f]
    assert found.where("part = 'result'").count() > 0


def test_an_arrival_is_many_files(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "ROWS_PER_TASK", 5)
    monkeypatch.setattr(catalog, "shared_folder", lambda _, name: f"{tmp_path}/{name}")
    found = catalog.QUERIES["scan_incremental"](spark, tables)
    files = list((tmp_path / "arrivals" / "orders.parquet").glob("part-*.parquet"))
    assert len(files) == catalog.ARRIVALS * 5
    assert len(list((tmp_path / "incremental" / "findings").glob("batch=*"))) == catalog.ARRIVALS
    assert _rows(found) == _rows(scan(corpus.workflow_files(spark, tables)).select(*found.columns))
