"""One document per branch and quirk of each rule."""

import pytest

from gatewarden.operators.rules import CatalogEntry, LineRule
from gatewarden.operators.scan import scan

TOP = "on: push\npermissions: read-all\n"
PRT = "on: pull_request_target\npermissions: read-all\n"
HASH = "0123456789abcdef0123456789abcdef01234567"


def lines(*items, top=TOP):
    return top + "jobs:\n" + "\n".join(items)


# name -> (document, expected (rule, line) pairs). Lines of ``lines`` start at 4.
CASES = {
    "event in run": (lines("  - run: echo ${{ github.event.issue.title }}"), {("R01", 4)}),
    "event without blanks": (lines("  - run: x ${{github.event.pull_request.title}}"), {("R01", 4)}),
    "event with tab": (lines("  - run: x ${{\tgithub.event.review.body }}"), {("R01", 4)}),
    "VT is no blank here": (lines("  - run: x ${{\x0bgithub.event.review.body }}"), set()),
    "CR inside": (lines("  - run: a\rb ${{ github.event.issue.title }}"), {("R01", 4)}),
    "event before run": (lines("  x: ${{ github.event.issue.title }} run: x"), set()),
    "event not closed": (lines("  - run: x ${{ github.event.issue.title"), set()),
    "second event closes": (
        lines("  - run: ${{ github.event.sender.x }} ${{ github.event.issue.y }}"), {("R01", 4)}),
    "quoted": (lines('  - run: echo "${{ github.event.issue.title }}"'), set()),
    "single quoted": (lines("  - run: echo '${{ github.event.issue.title }}'"), set()),
    "or": (lines("  - run: a || b ${{ github.event.issue.title }}"), set()),
    "and": (lines("  - run: a && b ${{ github.event.issue.title }}"), set()),
    "repository is safe": (
        lines("  - run: ${{ github.event.repository.name }} ${{ github.event.issue.title }}"), set()),
    "other event": (lines("  - run: ${{ github.event.sender.login }}"), set()),
    "local action": (lines("    uses: ./x"), {("R02", 4)}),
    "no version but blank end": (lines("    uses:   \u00a0"), set()),
    "tag": (lines("    uses: a/b@v1"), set()),
    "hash": (lines(f"    uses: a/b@{HASH}"), set()),
    "short hash": (lines(f"    uses: a/b@{HASH[:39]}"), set()),
    "branch": (lines("    uses: a/b@main"), {("R03", 4)}),
    "branch prefix": (lines("    uses: a/b@device-1"), {("R03", 4)}),
    "hash beside branch": (lines(f"    uses: a/b@{HASH} # uses: a/b@main"), set()),
    "dash hides uses": (lines("  - uses: a/b@main"), set()),
    "both": (lines("    uses: a/b@main # uses: c"), {("R02", 4), ("R03", 4)}),
    "trimmed by wide blank": (lines("  \u3000uses: a/b@master"), {("R03", 4)}),
    "secret printed": (lines("    run: ECHO ${{ Secrets.A }}"), {("R04", 4)}),
    "secret long s": (lines("    x: cat ${{ \u017fecrets.A }}"), {("R04", 4)}),
    "cat in a word": (lines("    authentication: ${{ secrets.A }}"), {("R04", 4)}),
    "secret alone": (lines("    key: ${{ secrets.A }}"), set()),
    "print with other letters": (lines("    run: pr\u0131nt ${{ secrets.A }}", "    run: PR\u0130NT ${{ secrets.A }}"), set()),
    "print in capitals": (lines("    run: PrInT ${{ secrets.A }}"), {("R04", 4)}),
    "secret before print": (lines("    key: ${{ secrets.A }} echo"), set()),
    "env secret": (lines("    env: { A: ${{ secrets.A }} }"), {("R05", 4)}),
    "env masked": (lines("    env: { A: ${{ secrets.A }} } # mask: true"), set()),
    "env and print": (lines("    env: echo ${{ secrets.A }}"), {("R04", 4), ("R05", 4)}),
    "write": ("on: push\npermissions:\n  contents: write\n", {("R06", 0)}),
    "write in flow": ("on: push\npermissions: {a: b, 'contents': \"write\"}\n", {("R06", 0)}),
    "admin": ("on: push\npermissions:\n  contents: admin # all\n", {("R07", 0)}),
    "read": ("on: push\npermissions:\n  contents: read\n", set()),
    "write-all": ("on: push\npermissions: write-all\n", set()),
    "null permissions": ("on: push\npermissions:\njobs:\n", set()),
    "list permissions": ("on: push\npermissions:\n- contents: write\n", set()),
    "absent": ("on: push\njobs:\n  permissions:\n    contents: write\n", {("R08", 0)}),
    "only a comment": ("# nothing", {("R08", 0)}),
    "token": (lines(*["    x: y"] * 9, "    token: ${{ secrets.GITHUB_TOKEN }}"), {("R09", 13)}),
    "permissions 10 above": (
        lines("    permissions:", *["    x: y"] * 9, "    token: ${{ secrets.GITHUB_TOKEN }}"), set()),
    "permissions 11 above": (
        lines("    permissions:", *["    x: y"] * 10, "    token: ${{ secrets.GITHUB_TOKEN }}"),
        {("R09", 15)}),
    "permissions 9 below": (
        lines(*["    x: y"] * 9, "    token: ${{ secrets.GITHUB_TOKEN }}", *["    x: y"] * 8,
              "    permissions:"), set()),
    "permissions 10 below": (
        lines(*["    x: y"] * 9, "    token: ${{ secrets.GITHUB_TOKEN }}", *["    x: y"] * 9,
              "    permissions:"), {("R09", 13)}),
    "not privileged": (
        lines("  - uses: actions/checkout@v4", "    ref: ${{ github.event.pull_request.head.sha }}"),
        set()),
    "unsafe ref": (
        lines("  - uses: actions/checkout@v4", "    ref: ${{ github.event.pull_request.head.sha }}",
              top=PRT), {("R10", 5)}),
    "unsafe ref and run": (
        lines("  - uses: actions/checkout@v4", "    ref: ${{ github.event.pull_request.head.sha }}",
              "  - run: x", top=PRT), {("R10", 5), ("R11", 0)}),
    "safe ref": (
        lines("  - uses: actions/checkout@v4", "    ref: ${{ github.event.pull_request.base.sha }}",
              "  - run: x", top=PRT), set()),
    "ref 4 below": (
        lines("  - uses: actions/checkout@v4", *["    x: y"] * 3,
              "    ref: ${{ github.event.pull_request.head.sha }}", top=PRT), {("R10", 8)}),
    "ref 5 below": (
        lines("  - uses: actions/checkout@v4", *["    x: y"] * 4,
              "    ref: ${{ github.event.pull_request.head.sha }}", "  - run: x", top=PRT),
        {("R11", 0)}),
    "ref 5 above": (
        lines("    ref: ${{ github.event.pull_request.head.sha }}", *["    x: y"] * 4,
              "  - uses: actions/checkout@v4", top=PRT), {("R10", 4)}),
    "ref 6 above": (
        lines("    ref: ${{ github.event.pull_request.head.sha }}", *["    x: y"] * 5,
              "  - uses: actions/checkout@v4", top=PRT), set()),
    "last decisive checkout is safe": (
        lines("  - uses: actions/checkout@v4", "    ref: ${{ github.event.pull_request.head.sha }}",
              *["    x: y"] * 6, "  - uses: actions/checkout@v4",
              "    ref: ${{ github.event.pull_request.base.sha }}",
              *["    x: y"] * 6, "  - uses: actions/checkout@v4", "  - run: x", top=PRT),
        {("R10", 5)}),
    "script": (
        lines("    run: |", "      x ${{ github.event.sender.login }}"), {("R12", 5)}),
    "script without blank": (
        lines("    run:|", "      x ${{ github.event.sender.login }}"), {("R12", 5)}),
    "dash opens no script": (
        lines("  - run: |", "      x ${{ github.event.sender.login }}"), set()),
    "script goes on after dedent and blank lines": (
        lines("    run: |", "      a", "", "  key: ${{ github.event_name }}"), {("R12", 7)}),
    "comment ends script": (
        lines("    run: |", "      # c", "      x ${{ github.event.sender.login }}"), set()),
    "step ends script": (
        lines("    run: |", "  - x", "      x ${{ github.event.sender.login }}"), set()),
    "run ends script": (
        lines("    run: |", "    run: x", "      x ${{ github.event.sender.login }}"), set()),
    "marker after wide blank": (
        lines("    run: |", "  \u2003- x", "      x ${{ github.event.sender.login }}"), set()),
    "number is safe": (
        lines("    run: |", "      x ${{ github.event.number }} ${{ github.event.sender.login }}"), set()),
    "empty": ("", set()),
    "plain text": ("Hello world", set()),
    "list": ("- a\n- b", set()),
    "key twice": ("permissions:\n  contents: write\non: push\npermissions: x", set()),
    "tab first": ("on: push\n\tx: y", set()),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"org/r{i}", i, 0, "w.yml", doc) for i, (doc, _) in enumerate(CASES.values())]
    rows += [(n, i + 1000, 0, "w.yml", d.replace("\n", "\r\n")) for n, i, _, _, d in rows]
    files = spark.createDataFrame(
        rows, "full_name string, repo_ord long, wf_ord int, path string, content string"
    )
    result = {}
    for r in scan(files).collect():
        result.setdefault(r.repo_ord, []).append((r.rule_id, r.line))
    return result


@pytest.mark.parametrize("i,name", list(enumerate(CASES)), ids=list(CASES))
def test_case(found, i, name):
    expected = sorted(CASES[name][1])
    assert sorted(found.get(i, [])) == expected


@pytest.mark.parametrize("i,name", list(enumerate(CASES)), ids=list(CASES))
def test_case_with_crlf(found, i, name):
    assert sorted(found.get(i + 1000, [])) == sorted(CASES[name][1])


def test_severity_and_details(files_of):
    doc = lines("  - run: x ${{ github.event.inputs.a }}", "    uses: a/b@main  ")
    got = {r.rule_id: (r.severity, r.details) for r in scan(files_of([doc])).collect()}
    assert got["R01"] == ("HIGH", "  - run: x ${{ github.event.inputs.a }}")
    assert got["R03"] == ("HIGH", "uses: a/b@main")


def test_two_checkouts_near_one_ref_give_two_findings(files_of):
    doc = lines("  - uses: actions/checkout@v4", "    ref: ${{ github.event.pull_request.head.sha }}",
                "  - uses: actions/checkout@v4", top=PRT)
    hits = scan(files_of([doc]), ["R10"]).collect()
    assert sorted((r.line, r.emit_pos) for r in hits) == [(5, 4), (5, 6)]


def test_own_rule(files_of):
    entry = CatalogEntry("X01", 100, 7, "Sudo", "LOW", "d", "i", "e", "m", ())
    rule = LineRule(entry, r"\bsudo\b", excluded=("nosudo",))
    doc = lines("  - run: sudo x", "  - run: sudo nosudo")
    hits = scan(files_of([doc]), ["X01"], extra_rules=(rule,)).collect()
    assert [(r.rule_id, r.line, r.type) for r in hits] == [("X01", 4, "Sudo")]


def test_very_long_line(files_of):
    tail = "run: " * 20_000 + "${{ github.event.issue.x " * 20_000
    assert scan(files_of([lines("  - run: " + tail)]), ["R01"]).count() == 0
    assert scan(files_of([lines("  - run: " + tail + "}}")]), ["R01"]).count() == 1


def test_very_long_file(files_of):
    """Many markers, hits and tokens in one file."""
    block = ["    run: |", "      x ${{ github.event.sender.login }}", "  - y",
             "    token: ${{ secrets.GITHUB_TOKEN }}"]
    hits = scan(files_of([lines(*block * 20_000)])).groupBy("rule_id").count().collect()
    # The first two token lines have the permissions of the head nearby.
    assert {r.rule_id: r["count"] for r in hits} == {"R12": 20_000, "R09": 19_998}
