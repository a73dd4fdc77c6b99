"""The three flows end to end, and the plans behind them."""

import json

from gatewarden import corpus
from gatewarden.operators.scan import scan, workflow_lines
from gatewarden.plans import audit
from gatewarden.plans.catalog import QUERIES
from gatewarden.sources import contents
from gatewarden.sources.text_lists import read_manifest

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_collect_then_analyze(spark, tmp_path):
    audit.collect_flow(corpus.repo_meta(spark, SF), corpus.listings(spark, SF), str(tmp_path / "list"), 10)
    repos = read_manifest(spark, str(tmp_path / "list"))
    assert repos.select("full_name").distinct().count() == 10
    files = corpus.workflow_files(spark, SF)
    listed = corpus.manifest_lines(spark, SF)
    from gatewarden.operators.collect import parse_manifest

    repos = parse_manifest(listed)
    audit.analyze_flow(repos, files, str(tmp_path / "md"), "t", "s", "e", "md", 20)
    assert any(p.read_text() for p in (tmp_path / "md").glob("part-*"))
    audit.analyze_flow(repos, files, str(tmp_path / "sarif"), "t", "s", "e", "sarif", 20)
    results = 0
    names = set()
    for part in (tmp_path / "sarif").glob("file=*/part-*"):
        for line in part.read_text().splitlines():
            run = json.loads(line)["runs"][0]
            results += len(run["results"])
            names.add(run["automationDetails"]["id"])
    found = audit.scan_listed(repos, files, 20)
    assert results == found.count() > 0
    assert names == {r.full_name for r in found.select("full_name").distinct().collect()}


def test_long_list_gives_the_same_findings(spark):
    from gatewarden.operators.collect import parse_manifest

    repos = parse_manifest(corpus.manifest_lines(spark, SF))
    files = corpus.workflow_files(spark, SF)

    def bag(df):
        return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())

    assert bag(audit.scan_listed(repos, files, None)) == bag(audit.scan_listed(repos, files, 10_000))


def test_a_list_beyond_a_broadcast_moves_no_content(spark, monkeypatch):
    """The list goes to the files as marks; what passes beside it is left out when the findings meet the list."""
    text = "on: push\njobs:\n  build:\n    steps:\n      - uses: acme/tool@main"
    files = [(f"o/r{i % 50}" if i % 97 else None, i, 0, f"w{i}.yml", text) for i in range(400)] * 2
    files = spark.createDataFrame(files, "full_name string, repo_ord long, wf_ord int, path string, content string")
    listed = [(i, "o", f"r{i}", f"o/r{i}", [f"w{i}.yml", f"w{i + 50}.yml", f"w{i}.yml"]) for i in range(20)]
    listed += [(30, "o", None, None, ["w97.yml"]), *listed[:3]]
    repos = spark.createDataFrame(listed, "repo_ord long, owner string, name string, full_name string, workflows array<string>")

    def bag(df):
        return sorted(map(str, df.collect()))

    short = bag(audit.scan_listed(repos, files, None))
    assert len(short) > 100
    monkeypatch.setattr(audit, "MAX_BROADCAST_ROWS", 10, raising=False)
    found = audit.scan_listed(repos, files, None)
    assert "LeftSemi" not in plan_of(found) and bag(found) == short
    paths = spark.createDataFrame([("o/r1", f"w{i}.yml") for i in range(1, 100)], "full_name string, path string")
    marked = contents.marked_contents(paths, files, 99).select("full_name", "path")
    exact = files.join(paths, ["full_name", "path"], "left_semi").select("full_name", "path")
    assert marked.exceptAll(exact).count() < 40 and exact.exceptAll(marked).count() == 0
    monkeypatch.setattr(contents, "PAGE_BITS", 128)
    monkeypatch.setattr(contents, "MOST_BITS", 128)
    assert bag(audit.scan_listed(repos, files, None)) == short
    monkeypatch.setattr(contents, "MOST_BITS", 1 << 12)
    assert bag(audit.scan_listed(repos, files, None)) == short


def test_one_repository_and_own_rules_reach_the_outputs(spark, tmp_path):
    from gatewarden.operators.collect import parse_manifest
    from gatewarden.plans.catalog import OWN_RULE

    repos = parse_manifest(corpus.manifest_lines(spark, SF))
    files = corpus.workflow_files(spark, SF)
    hits = audit.scan_listed(repos, files, None, (OWN_RULE,)).where("rule_id = 'X01'")
    name = hits.orderBy("repo_ord").first().full_name
    audit.analyze_flow(repos, files, str(tmp_path / "s"), "t", "s", "e", "sarif", None, (OWN_RULE,), name, "https://example.org/rules")
    runs = [json.loads(x)["runs"][0] for p in (tmp_path / "s").glob("file=*/part-*") for x in p.read_text().splitlines()]
    assert {r["automationDetails"]["id"] for r in runs} == {name}
    assert all(r["tool"]["driver"]["informationUri"] == "https://example.org/rules" for r in runs)
    assert "Multi-LineScript" in {x["ruleId"] for r in runs for x in r["results"]}
    audit.analyze_flow(repos, files, str(tmp_path / "m"), "t", "s", "e", "md", None, (OWN_RULE,), name)
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert "## Multi-Line Script (" in text and "**Exploit**: Hide a command among many." in text


def test_building_the_collection_starts_no_job(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    listed, candidates = corpus.listings(spark, SF), corpus.repo_meta(spark, SF)
    seen = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    from gatewarden.operators.collect import collect_repos

    collect_repos(candidates, listed, 100)
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == seen >= set(before)


def test_a_listed_scan_takes_only_listed_files_first(spark):
    from gatewarden.operators.collect import parse_manifest

    repos = parse_manifest(corpus.manifest_lines(spark, SF))
    for limit in (5, None):
        plan = audit.scan_listed(repos, corpus.workflow_files(spark, SF), limit)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("LeftSemi") > plan.index("explode_outer") if "explode_outer" in plan else "LeftSemi" in plan


def test_every_registered_repository_has_configurations(spark):
    schema = "full_name string, repo_ord long"
    repos = spark.createDataFrame([("a/with", 1), ("a/without", 2), ("a/tree", 3)], schema)
    known = spark.createDataFrame([], "full_name string, processed_at timestamp, success boolean, message string")
    meta = spark.createDataFrame([("a/with", "Python")], "full_name string, language string")
    tree = spark.createDataFrame([("a/tree", "x.go"), ("a/tree", "y.go")], "full_name string, path string")
    done = audit.rollout_flow(repos, known, meta, tree, "2025-01-01 00:00:00", 10)
    assert [(r.full_name, r.position, r.total) for r in done.batch.orderBy("position").collect()] == [
        ("a/with", 1, 3), ("a/without", 2, 3), ("a/tree", 3, 3)]
    configured = {r.full_name for r in done.configurations.collect()}
    assert configured == {r.full_name for r in done.registry.where("success").collect()} == {"a/with", "a/without", "a/tree"}
    code = {r.full_name: r.content for r in done.configurations.where("tool = 'codeql'").collect()}
    assert "'python'" in code["a/with"] and "'javascript'" in code["a/without"] and "'go'" in code["a/tree"]


def test_rollout(spark):
    from gatewarden.operators.collect import parse_manifest
    from gatewarden.operators.registry import latest

    repos = parse_manifest(corpus.manifest_lines(spark, SF))
    known = latest(corpus.registry_log(spark, SF))
    done = audit.rollout_flow(
        repos, known, corpus.repo_meta(spark, SF), corpus.repo_tree(spark, SF), "2025-01-01 00:00:00", 15)
    assert done.registry.count() == known.count() + 15
    assert done.counters.first().processed == 15
    assert {r.tool for r in done.configurations.collect()} == {"codeql", "dependabot"}


def test_scan_of_a_table_moves_nothing(spark, tmp_path):
    path = str(tmp_path / "files")
    corpus.workflow_files(spark, SF).selectExpr("*", "'x' as unused").write.parquet(path)
    files = spark.read.parquet(path)
    for df in (scan(files), workflow_lines(files)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "unused" not in plan and "EvalPython" not in plan


def test_no_query_uses_a_nested_loop_or_python(spark):
    skip = {"scan_incremental", "report_sections", "analyze_written"}
    for name, query in QUERIES.items():
        if name not in skip:
            plan = plan_of(query(spark, SF))
            for word in ("NestedLoop", "CartesianProduct", "EvalPython", "InPandas"):
                assert word not in plan, (name, word)
