import gzip
import json

import pytest
from pyspark.sql import functions as F

from gatewarden.operators import report, sarif
from gatewarden.operators.rules import CATALOG, ENTRY

SCHEMA = (
    "full_name string, repo_ord long, wf_ord int, path string, rule_id string, detector_ord int, "
    "rule_ord int, emit_pos int, type string, severity string, line int, details string"
)


def finding(i, rule_id, repo="o/r", severity=None):
    e = ENTRY[rule_id]
    return (repo, 1, i, f"w{i}.yml", rule_id, e.detector_ord, e.rule_ord, i, e.type,
            severity or e.severity, i, f"line {i}")


def golden(spark):
    """The counts of a recorded run: 41, 31, 30, 15 and 1 findings of five types."""
    counts = {"R08": 41, "R09": 31, "R06": 30, "R02": 14, "R03": 1, "R12": 1}
    rows = [r for r, n in counts.items() for _ in range(n)]
    return spark.createDataFrame([finding(i, r) for i, r in enumerate(rows)], SCHEMA)


def test_recorded_counts(spark):
    found = golden(spark)
    assert report.total(found).first().findings == 118
    bars = {r.severity: (r.findings, len(r.bar)) for r in report.severity_bars(found).collect()}
    assert bars == {"HIGH": (1, 0), "MEDIUM": (45, 12), "LOW": (72, 20)}
    assert [r.findings for r in report.by_type(found).collect()] == [41, 31, 30, 15, 1]


def test_no_findings(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert {r.severity: r.findings for r in report.by_severity(none).collect()} == {
        "HIGH": 0, "MEDIUM": 0, "LOW": 0}
    assert report.severity_bars(none).count() == 0
    text = json.loads(sarif.empty_document(spark, "a", "b").first().document)
    assert text["runs"][0]["results"] is None and text["runs"][0]["tool"]["driver"]["rules"] is None


def test_unknown_severity_counts_and_raises_the_maximum(spark):
    rows = [finding(1, "R01")] + [finding(i, "R01", severity="ODD") for i in range(2, 6)]
    bars = {r.severity: (r.findings, len(r.bar))
            for r in report.severity_bars(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert bars == {"HIGH": (0, 0), "MEDIUM": (1, 5), "LOW": (0, 0), "ODD": (4, 20)}


def test_first_finding_stands_for_the_type(spark):
    rows = [finding(5, "R02"), finding(2, "R03"), finding(9, "R03")]
    first = report.first_of_type(spark.createDataFrame(rows, SCHEMA)).first()
    assert (first.severity, first.findings, first.line) == ("HIGH", 3, 2)


def test_written_report_is_in_order(spark, tmp_path):
    path = str(tmp_path / "report")
    report.write_report(golden(spark), "2025-01-01", path)
    parts = sorted((tmp_path / "report").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.startswith("# CI workflow findings")
    assert text.index("## By type") < text.index("## Undefined Permissions (41)") < text.index(
        "## Undefined Token Permissions (31)") < text.index("## Script Injection (1)")
    numbers = [int(x.split(" ")[2]) for x in text.split("\n") if x.startswith("### Occurrence")]
    assert numbers == [n for c in (41, 31, 30, 15, 1) for n in range(1, c + 1)]


def test_documents_are_sharded_and_complete(spark):
    rows = [finding(i, "R04" if i % 2 else "R08", "o/hot") for i in range(25)] + [finding(1, "R12", "o/x", "ODD")]
    docs = sarif.documents(spark.createDataFrame(rows, SCHEMA), "s", "e", per_document=10).collect()
    assert sorted((d.full_name, d.shard, d.results) for d in docs) == [
        ("o/hot", 0, 10), ("o/hot", 1, 10), ("o/hot", 2, 5), ("o/x", 0, 1)]
    first = json.loads(next(d for d in docs if d.full_name == "o/hot" and d.shard == 0).document)
    run = first["runs"][0]
    assert first["version"] == "2.1.0"
    assert [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]] == list(range(10))
    assert {r["id"]: r["properties"]["security-severity"] for r in run["tool"]["driver"]["rules"]} == {
        "UndefinedPermissions": "3.0", "SecretExposure": "8.9"}
    assert {r["level"] for r in run["results"]} == {"note", "error"}
    odd = json.loads(next(d for d in docs if d.full_name == "o/x").document)["runs"][0]
    assert odd["results"][0]["level"] == "warning"
    assert odd["tool"]["driver"]["rules"][0]["properties"]["security-severity"] == "1.0"


def test_rules_are_the_same_in_all_documents(spark):
    rows = [finding(i, "R02" if i < 10 else "R03", "o/hot") for i in range(25)] + [finding(30, "R03", "o/x")]
    found = spark.createDataFrame(rows, SCHEMA)
    docs = [json.loads(d.document)["runs"][0] for d in sarif.documents(found, "s", "e", per_document=10).collect()]
    texts = {json.dumps(r["tool"]["driver"]["rules"], sort_keys=True) for r in docs}
    assert len(docs) == 4 and len(texts) == 1
    first = sarif.rules(found).first()
    assert json.loads(texts.pop())[0]["properties"]["security-severity"] == first.security_severity == "5.5"
    assert {r["automationDetails"]["id"] for r in docs} == {"o/hot", "o/x"}


def test_a_finding_of_an_unknown_rule_is_an_error(spark):
    row = list(finding(1, "R01"))
    row[4] = "X99"
    found = spark.createDataFrame([tuple(row)], SCHEMA)
    for output in (sarif.results(found), sarif.rules(found), sarif.documents(found, "s", "e"), report.report(found, "t")):
        with pytest.raises(Exception, match="no texts for rule X99"):
            output.collect()


def test_every_rule_has_texts(spark):
    found = spark.createDataFrame([finding(i, e.rule_id) for i, e in enumerate(CATALOG)], SCHEMA)
    assert sarif.results(found).where(F.col("message").isNotNull()).count() == len(CATALOG)


def test_written_documents_are_cut_into_files_by_bytes(spark, tmp_path):
    """A third of the results are of one repository; files are bounded and the index finds every document."""
    rows = [finding(i, "R04", "o/hot" if i % 3 == 0 else f"o{i % 7}/r{i % 20}") for i in range(4500)]
    path, bound = str(tmp_path / "s"), 200_000
    for _ in range(2):
        sarif.write_sarif(spark.createDataFrame(rows, SCHEMA), "s", "e", path, file_bytes=bound)
        files = {int(f.parent.name.removeprefix("file=")): f.read_bytes() for f in (tmp_path / "s").glob("file=*/part-*")}
        index = sarif.read_index(spark, path).collect()
        total = sum(r.bytes for r in index)
        assert total == sum(map(len, files.values())) and len(files) <= total // bound + 1
        assert len(files) > 3 and all(len(b) < bound + max(r.bytes for r in index) for b in files.values())
        shards = {}
        for r in index:
            text = files[r.file][r.offset:r.offset + r.bytes]
            run = json.loads(text)["runs"][0]
            assert text.endswith(b"\n") and run["automationDetails"]["id"] == r.full_name
            shards.setdefault(r.full_name, []).append((r.shard, len(run["results"])))
        assert sorted(shards["o/hot"]) == [(0, 1000), (1, 500)]
        assert sum(n for s in shards.values() for _, n in s) == 4500
    hot = sarif.read_documents(spark, path, "o/hot").collect()
    assert sorted(len(json.loads(r.document)["runs"][0]["results"]) for r in hot) == [500, 1000]
    assert sarif.read_documents(spark, path, "o/none").count() == 0


def test_compressed_files_hold_the_same_documents(spark, tmp_path):
    """The same texts in the same files at the same places, in less than a tenth of the bytes; one file holds one document."""
    rows = [finding(i, "R04", "o/hot" if i % 3 == 0 else f"o{i % 7}/r{i % 20}") for i in range(4500)]
    found, texts, places, sizes = spark.createDataFrame(rows, SCHEMA), {}, {}, {}
    for form in (None, "gzip"):
        path = str(tmp_path / str(form))
        sarif.write_sarif(found, "s", "e", path, file_bytes=100_000, compression=form)
        parts = list((tmp_path / str(form)).glob("file=*/part-*"))
        sizes[form] = sum(p.stat().st_size for p in parts)
        assert {p.suffix for p in parts} == {".gz" if form else ".txt"}
        texts[form] = {p.parent.name: gzip.decompress(p.read_bytes()) if form else p.read_bytes() for p in parts}
        places[form] = sorted(map(tuple, sarif.read_index(spark, path).collect()))
        assert sarif.read_documents(spark, path, "o/hot").count() == 2
    assert texts[None] == texts["gzip"] and places[None] == places["gzip"] and len(texts[None]) > 8
    assert sizes["gzip"] * 10 < sizes[None]


def test_a_run_without_findings_writes_one_document(spark, tmp_path):
    path = str(tmp_path / "none")
    sarif.write_sarif(spark.createDataFrame([], SCHEMA), "s", "e", path)
    (line,) = spark.read.text(path).collect()
    assert json.loads(line.value)["runs"][0]["results"] is None
    (place,) = sarif.read_index(spark, path).collect()
    assert (place.full_name, place.file, place.offset, place.bytes) == (None, 0, 0, len(line.value) + 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_results_are_made_from_their_rows(spark):
    """No function runs over the results of a document; its text is JSON whatever the strings hold."""
    odd = 'a "b" \\ \t\x01/\u2028\u00e9\nnext'
    rows = [finding(i, "R04", 'o/"q"\\') for i in range(3)] + [finding(3, "R08", "o/r")]
    rows = [(*r[:3], odd, *r[4:11], None if r[2] == 1 else odd) for r in rows]
    docs = sarif.documents(spark.createDataFrame(rows, SCHEMA), "s\"", "e", per_document=2, information_uri="u/\"")
    assert "lambdafunction(struct" not in plan_of(docs) and "lambdafunction(named_struct" not in plan_of(docs)
    got = {(d.full_name, d.shard): d.document for d in docs.collect()}
    assert sorted(got) == [('o/"q"\\', 0), ('o/"q"\\', 1), ("o/r", 0)]
    for (name, _), text in got.items():
        top = json.loads(text)
        (run,) = top["runs"]
        assert text == json.dumps(top, separators=(",", ":"), ensure_ascii=False)
        assert list(top) == ["$schema", "version", "runs"] and list(run) == ["tool", "automationDetails", "results", "invocations"]
        assert run["automationDetails"] == {"id": name} and run["invocations"][0]["startTimeUtc"] == 's"'
        driver = run["tool"]["driver"]
        assert list(driver) == ["name", "version", "informationUri", "rules"] and driver["informationUri"] == 'u/"'
    first = json.loads(got['o/"q"\\', 0])["runs"][0]["results"]
    places = [r["locations"][0]["physicalLocation"] for r in first]
    assert [p["region"]["snippet"]["text"] for p in places] == [odd, None] and places[0]["artifactLocation"]["uri"] == odd
    assert [r["message"]["text"] for r in first] == [ENTRY["R04"].description + " - " + odd.split("\n")[0], None]


def test_first_findings_of_a_written_table(spark):
    """Null comes first, ties of the first column are told apart by the others, types may be null; few rows are compared."""
    rows = [finding(i, r) for i, r in enumerate(["R02", "R03", "R08", "R08", "R12"])]
    rows = [(r[0], k, *r[2:8], t or r[8], *r[9:]) for r, k, t in zip(rows, [4, 4, None, 1, 7], [None] * 5)]
    rows += [(*rows[0][:8], None, *rows[0][9:])]
    found = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, report.first_of_type(found).collect()))
    once = report.first_of_type(found, written=True)
    assert sorted(map(str, once.collect())) == want and len(want) == 4
    assert "Join" in plan_of(once)
    blocks = report.report(golden(spark), "t")
    assert plan_of(blocks).count("_least") > 0
