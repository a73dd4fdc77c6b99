"""A scan computes what its rules and columns need, and no more; results on odd lines stay as they are."""

import pytest
from pyspark.sql import functions as F

from gatewarden.functions.header import HEADER, with_fields
from gatewarden.operators.scan import scan

TOP = "on: pull_request_target\npermissions: read-all\n"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def found(df):
    return sorted((r.repo_ord, r.rule_id, r.line) for r in df.collect())


@pytest.fixture
def stored(files_of, tmp_path, spark):
    """Files that are read from a table, so that a plan shows what is done with a content."""

    def build(texts, name="files"):
        files_of(texts).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return build


def test_triggers_leave_permissions_alone(stored):
    files = stored(["on: push\npermissions: read-all"])
    triggers = with_fields(files).select("path", F.col(HEADER + "triggers"))
    assert "_perm" not in plan_of(triggers)
    assert [r[1] for r in triggers.collect()] == [["push"]]


def test_top_lines_end_at_line_feeds_only(files_of):
    texts = ["on: push\npermissions: {}\n\u2028", "on: push\npermissions: {}\n\u0085x", "on: push\npermissions: {}\n \r\n\r\n# c\r\n\t# d"]
    header = with_fields(files_of(texts)).orderBy("repo_ord")
    assert [r[0] for r in header.select(HEADER + "parse_ok").collect()] == [False, False, True]


def test_rules_on_files_unnest_no_lines(stored):
    files = stored(["on: push", "on: push\npermissions: {}", "- no mapping"])
    alone = scan(files, ["R08"])
    assert "posexplode" not in plan_of(alone)
    assert found(alone) == [(0, "R08", 0)]


@pytest.mark.parametrize("line, rules", [
    ("\u00a0 \trun: |", {"R12"}), ("\u2028run:|", {"R12"}), ("   run: | ", {"R12"}), ("run: x", set()), ("\r", set()), ("\x7frun: |", set()),
])
def test_script_opens_behind_any_blank(files_of, line, rules):
    text = f"on: push\npermissions: {{}}\nx:\n {line}\n  echo ${{{{ github.event.issue.title }}}}"
    assert {r.rule_id for r in scan(files_of([text])).collect()} == rules


def test_files_without_needles_are_not_parsed(stored):
    texts = [
        TOP + "s:\n - uses: actions/checkout@v4\n   ref: ${{ github.event.pull_request.head.sha }}",
        TOP + "s:\n - uses: actions/checkout@v4",
        TOP + "s:\n   ref: ${{ github.event.pull_request.head.sha }}",
        "",
    ]
    only = scan(stored(texts), ["R10"])
    assert "Contains(content" in plan_of(only).split("_raw")[-1]
    assert found(only) == [(0, "R10", 5)]


def test_header_looks_for_marks_and_keys_in_lines_without_indent(stored):
    """The content is not measured, and is searched for an opening bracket only where its first letter allows one."""
    plan = plan_of(with_fields(stored(["on: push"])).select("path", HEADER + "parse_ok"))
    assert "length(content" not in plan and "ascii(_raw" in plan
    texts = [
        "on: push\n  --- x\n  ...\n  %y\npermissions: {}", "--- {on: push,\n permissions: {contents: admin}}", " \n---\non: push\n...\nx y",
        "k:\t'a\nb: c'\non: push", "k: 'a\nb: c'\non: push\nb: d", "\ufeff on: push", "on: push\nx: 'it\n  goes on'\n", "\n  {on: push}", "on-x: a\non_x : b\n",
    ]
    header = with_fields(stored(texts, "tops")).orderBy("repo_ord")
    got = [tuple(r) for r in header.select(HEADER + "parse_ok", HEADER + "permissions_form", HEADER + "triggers").collect()]
    pushed = (True, "absent", ["push"])
    assert got == [(True, "flow map", ["push"])] * 2 + [pushed] * 3 + [(True, "absent", [])] + [pushed] * 2 + [(True, "absent", [])]


def test_tokens_are_lines_like_others(stored):
    """No function runs over all lines of a file for them; the lines around are looked at for token lines alone."""
    token = " token: ${{ secrets.GITHUB_TOKEN }}"
    texts = ["\n".join(["on: push", "x:", " permissions:", *[" a"] * n, token, *[" b"] * m, " permissions:"]) for n, m in [(9, 9), (10, 9), (10, 8), (9, 8)]]
    tokens = scan(stored(texts), ["R09"])
    assert "exists(" not in plan_of(tokens) and "posexplode" in plan_of(tokens)
    assert found(tokens) == [(1, "R09", 14)]


@pytest.mark.parametrize("between, rules", [
    (["", " \u00a0", "  echo"], {"R12"}), (["", "  # x", ""], set()), ([" \u3000- x"], set()), (["  x # y - run: |"], {"R12"}), ([" run: y"], set()), (["  echo run: | run: |", "  x"], {"R12"}),
])
def test_scripts_are_taken_apart_only_where_event_data_is_in_one(stored, between, rules):
    text = "\n".join(["on: push", "permissions: {}", "x:", " run: |", *between, "  echo ${{ github.event.issue.title }}"])
    scripts = scan(stored([text]), ["R12"])
    assert "run: ?" in plan_of(scripts)
    assert {r.rule_id for r in scripts.collect()} == rules


@pytest.mark.parametrize("line, shown", [
    ("  uses: a/b\u00a0", "uses: a/b"), ("  uses: a/b\t \x0b", "uses: a/b"), (" \tuses: a/b\r", "uses: a/b"), (" uses: \u00e9 ", "uses: \u00e9"), (" \u2003uses: a", "uses: a"),
])
def test_lines_lose_all_blanks_at_their_ends(files_of, line, shown):
    assert [r.details for r in scan(files_of(["on: push\nx:\n" + line]), ["R02"]).collect()] == [shown]


@pytest.mark.parametrize("line, hit", [
    ("ECHO ${{ \u017fECRET\u017f.X }}", True), ("con\u017fole.LOG ${{ Secrets.X }}", True), ("PrINT \u0130 ${{ SECRETS.x", True), ("pr\u0131nt ${{ secrets.X }}", False),
    ("\u00c9 cAt ${{\tsecretS.", True), ("echo ${{ secret.X }}", False), ("print ${{ env.X }} secrets.", False), ("dump ${{ secrets.X }}", False),
])
def test_patterns_in_any_case_are_tried_only_where_their_letters_are(stored, line, hit):
    found = scan(stored(["on: push\nx:\n - " + line]), ["R04"])
    assert "lower(line" in plan_of(found)
    assert [r.line for r in found.collect()] == [3] * hit
