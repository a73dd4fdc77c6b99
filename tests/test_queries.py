"""Every registered query beside its SQL check, on given and on skewed tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare, connect
from gatewarden.plans.catalog import QUERIES
from oracle.queries import ORACLE as CHECKS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given():
    return connect(SF)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Tables in which one key holds a third of the rows, partly as exact copies."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    hot = {
        "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey",), "events": ("user_id",),
        "documents": ("source",), "customer": (),
    }
    for name in TABLES:
        source = f"'{SF}/{name}.parquet'"
        sql = f"SELECT * FROM {source}"
        if name in hot and hot[name]:
            keys = ", ".join(f"(SELECT max({k}) FROM {source}) AS {k}" for k in hot[name])
            sql += f" UNION ALL SELECT * REPLACE ({keys}) FROM {source} WHERE hash(rowid_) % 2 = 0".replace(
                f"FROM {source} WHERE", f"FROM (SELECT *, row_number() OVER () AS rowid_ FROM {source}) WHERE"
            ).replace("SELECT * REPLACE", "SELECT * EXCLUDE (rowid_) REPLACE")
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder, connect(folder)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, given, name):
    ok, note = compare(spark, given, SF, QUERIES[name], CHECKS[name])
    assert ok, note


# Order inside groups of equal keys is open in these checks.
OPEN_ORDER = {"report_occurrences", "report_sections", "sarif_document"}
SKEWED = [
    n for n in QUERIES
    if n not in OPEN_ORDER and not n.startswith("rule_") and n not in {"scan_incremental"}
]


@pytest.mark.parametrize("name", SKEWED)
def test_query_on_skewed_tables(spark, skewed, name):
    folder, con = skewed
    ok, note = compare(spark, con, folder, QUERIES[name], CHECKS[name])
    assert ok, note


@pytest.mark.parametrize("name", ["report_occurrences", "sarif_document"])
def test_numbering_on_skewed_tables(spark, skewed, name):
    """Numbers are complete and without repeats whatever the order of equal rows."""
    folder, con = skewed
    df = QUERIES[name](spark, folder)
    if name == "report_occurrences":
        want = con.execute(CHECKS["summary_type"]).fetchall()
        got = df.selectExpr("type", "occurrence").groupBy("type").agg(
            {"*": "count", "occurrence": "max"}).collect()
        assert {(r["type"], r["count(1)"]) for r in got} == {tuple(w) for w in want}
        assert all(r["max(occurrence)"] == r["count(1)"] for r in got)
        assert df.select("type", "occurrence").distinct().count() == df.count()
    else:
        total = con.execute(CHECKS["summary_total"]).fetchall()[0][0]
        rows = df.select("results").collect()
        assert sum(r.results for r in rows) == total and max(r.results for r in rows) <= 1000
