"""Contents in buckets: listed scans that move no content."""

import re

import pytest

from gatewarden import corpus
from gatewarden.operators.collect import parse_manifest
from gatewarden.plans import audit
from gatewarden.sources import contents

SF = "/root/testdata/sf0.001"
BUCKETS = 6


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store") / "it's files")
    table = contents.write_store(corpus.workflow_files(spark, SF), folder, "workflow_store", BUCKETS)
    yield folder, table
    spark.sql("DROP TABLE IF EXISTS workflow_store")


def bag(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.fixture
def no_broadcast(spark):
    """A list too long to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moved(df):
    """What each exchange of the plan moves: the attributes of the node below."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


@pytest.mark.parametrize("limit", [12, None])
def test_a_list_meets_the_store_without_moving_contents(spark, store, no_broadcast, limit):
    repos = parse_manifest(corpus.manifest_lines(spark, SF))
    files = corpus.workflow_files(spark, SF)
    plain = audit.scan_listed(repos, files, limit)
    assert any("content" in m for m in moved(plain))
    found = audit.scan_listed(repos, store[1], limit, stored=True)
    assert moved(found) and not any("content" in m for m in moved(found))
    assert bag(found) == bag(plain) != []


def test_one_repository_is_a_pushed_filter(spark, store):
    repos = parse_manifest(corpus.manifest_lines(spark, SF))
    name = repos.orderBy("repo_ord").first().full_name
    found = audit.scan_listed(repos, store[1], only=name, stored=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(full_name,{name})" in plan
    assert bag(found) == bag(audit.scan_listed(repos, corpus.workflow_files(spark, SF), only=name))


def test_a_later_session_opens_the_store(spark, store, no_broadcast):
    folder, table = store
    rows = bag(table)
    again = contents.open_store(spark, folder, "workflow_store_again", BUCKETS)
    try:
        assert bag(again) == rows
        repos = parse_manifest(corpus.manifest_lines(spark, SF))
        found = audit.scan_listed(repos, again, None, stored=True)
        assert not any("content" in m for m in moved(found))
        assert found.count() > 0
    finally:
        spark.sql("DROP TABLE workflow_store_again")


def test_a_hot_repository_is_spread_and_edges(spark, tmp_path):
    rows = [("o/hot", f"w{i}.yml", "on: push") for i in range(600)] + [(None, "w.yml", "on: push"), ("o/x", None, None), ("o/x", "a.yml", ""), ("o/x", "a.yml", "")]
    files = spark.createDataFrame(rows, "full_name string, path string, content string")
    table = contents.write_store(files, str(tmp_path / "hot"), "hot_store", BUCKETS)
    try:
        per_file = table.where("full_name = 'o/hot'").selectExpr("_metadata.file_path f").groupBy("f").count().collect()
        assert len(per_file) == BUCKETS and max(r["count"] for r in per_file) < 300
        listed = spark.createDataFrame([("o/x", "a.yml"), ("o/x", "a.yml"), (None, "w.yml"), ("o/hot", "w7.yml")], "full_name string, path string")
        got = contents.listed_contents(listed, table, stored=True).collect()
        # Listed twice gives a row once; null names or paths are never listed.
        assert sorted((r.full_name, r.path) for r in got) == [("o/hot", "w7.yml"), ("o/x", "a.yml"), ("o/x", "a.yml")]
        assert contents.listed_contents(listed.limit(0), table, stored=True).count() == 0
        contents.write_store(files.limit(0), str(tmp_path / "hot"), "hot_store", BUCKETS)
        assert contents.listed_contents(listed, spark.table("hot_store"), stored=True).count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS hot_store")
