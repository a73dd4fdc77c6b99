import pytest

from gatewarden.functions.header import with_header

# document -> (parse_ok, permissions_form, contents, triggers)
CASES = [
    ("on: push", (True, "absent", "", ["push"])),
    ("on: 'push' # x", (True, "absent", "", ["push"])),
    ('"on": [push, "pull_request_target"]', (True, "absent", "", ["push", "pull_request_target"])),
    ("on:\n  - push\n  - x", (True, "absent", "", ["push", "x"])),
    ("on:\n- push\n- x\njobs:\n  a: b", (True, "absent", "", ["push", "x"])),
    ("on:\n  push:\n    branches: [a]\n  x:\n", (True, "absent", "", ["push", "x"])),
    ("on: {push: {branches: [a, b]}, 'x': }", (True, "absent", "", ["push", "x"])),
    ("on: [push,\n  x]", (True, "absent", "", ["push", "x"])),
    ("on:\n# c\n\n  push:\n", (True, "absent", "", ["push"])),
    ("'on':\r\n  push:\r\n  x:\r\n", (True, "absent", "", ["push", "x"])),
    ("name: a", (True, "absent", "", [])),
    ("permissions:\n  contents: write", (True, "block map", "write", [])),
    ("permissions:\n  \"contents\": 'admin'\n  a: b", (True, "block map", "admin", [])),
    ("permissions:\n  a:\n    contents: write", (True, "block map", "", [])),
    ("permissions: {contents: read}", (True, "flow map", "read", [])),
    ("permissions: {}", (True, "flow map", "", [])),
    ("permissions: [contents]", (True, "flow list", "", [])),
    ("permissions:\n- contents: write", (True, "block list", "", [])),
    ("permissions: read-all", (True, "scalar", "", [])),
    ("permissions:", (True, "empty", "", [])),
    ("---\non: push\n", (True, "absent", "", ["push"])),
    ("# a\n\n  \non: push", (True, "absent", "", ["push"])),
    ("", (False, "absent", "", [])),
    ("# a", (True, "absent", "", [])),
    ("text", (False, "absent", "", [])),
    ("on: push\ntext", (False, "absent", "", ["push"])),
    ("on:push", (False, "absent", "", [])),
    ("- a\non: push", (False, "absent", "", ["push"])),
    ("a: 1\nb: 2\na: 3", (False, "absent", "", [])),
    ("a:\n\tb: 1", (False, "absent", "", [])),
    ("a:\n  \tb", (True, "absent", "", [])),
    ("a: [\n  1\n]\nb: {\n  c: 1\n}", (True, "absent", "", [])),
    ("\ufeffon: push", (True, "absent", "", ["push"])),
    ("on: push\n...\n", (True, "absent", "", ["push"])),
    ("on: push\n...\nstray : text\nwhatever", (True, "absent", "", ["push"])),
    ("%YAML 1.2\n---\non: push", (True, "absent", "", ["push"])),
    ("# c\n%YAML 1.2\n%TAG ! x\n# d\n--- # e\non: push", (True, "absent", "", ["push"])),
    ("{on: push, permissions: {contents: write}}", (True, "flow map", "write", ["push"])),
    ("---\n{\n  'on': [push, x],\n  jobs: {a: {steps: [{run: 'a, b'}]}}\n}\n", (True, "absent", "", ["push", "x"])),
    ("a.b: 1\non: push", (True, "absent", "", ["push"])),
    ("a b: 1\n42: x\non: push", (True, "absent", "", ["push"])),
    ("'a b': 1\n\"c d\": 2\non: push", (True, "absent", "", ["push"])),
    ("name: \"two\nlines: here\"\non: push", (True, "absent", "", ["push"])),
    ("name: 'two\n\n  it''s'\non: push", (True, "absent", "", ["push"])),
    ("on: push\n---\non: pull_request\non: x", (True, "absent", "", ["push"])),
    ("x: &a\n  b: 1\n<<: *a\non: push", (True, "absent", "", ["push"])),
    ("on: push\n42: y\npermissions:\n  contents: write\n1.5: x", (True, "block map", "write", ["push"])),
    ("a b: 1\na b: 2", (False, "absent", "", [])),
    ("{a: 1, a: 2}", (False, "absent", "", [])),
    ("on: push\na : b\n\tc: d", (False, "absent", "", ["push"])),
]
# Flow collections of any depth, compact JSON, long comments before directives, and what is certainly invalid.
CASES += [
    ('{"on":"push","jobs":{"a":{"steps":[{"run":"echo ${{ secrets.X }}"}]}}}',
     (True, 'absent', '', ['push'])),
    ('{"on":{"push":{"a":{"b":{"c":{"d":{"e":{"k":1,"l":[1,2]}}}}},"z":{"b":{"c":{"d":{"k":1}}}}},"pull_request_target":null},"permissions":{"contents":"write"},"jobs":{"a":{"steps":[{"run":"echo ${{ secrets.X }}"}]}}}',
     (True, 'flow map', 'write', ['push', 'pull_request_target'])),
    ('{"on": "push", "jobs": {"a": {"b": {"c": {"d": {"k": 1}, "e": {"k": 2}}}}, "z": {"b": {"c": {"d": {"k": 1}}}}}, "permissions":"read-all"}',
     (True, 'scalar', '', ['push'])),
    ("# c\n\n {on: [push, {x: 1}, 'a, b'], # c }\n permissions: } # end",
     (True, 'empty', '', ['push', 'a, b'])),
    ('{on: [push}',
     (False, 'absent', '', ['push'])),
    ('{on: push',
     (False, 'absent', '', [])),
    ('{on: "push}',
     (False, 'absent', '', ['push'])),
    ('{on: push} stray',
     (False, 'absent', '', ['push'])),
    ('{on: push}\n# c\n',
     (True, 'absent', '', ['push'])),
    ('{a, on, b: {c, d}}',
     (True, 'absent', '', [])),
    ('{"a":1,"a":2}',
     (False, 'absent', '', [])),
    ('{}',
     (True, 'absent', '', [])),
    ('{on: {push: {paths: {a: 1, b: {c: 2, d: [3, 4]}}}, "x":{}, y}, \'permissions\':{\'contents\':\'admin\',issues: read}}',
     (True, 'flow map', 'admin', ['push', 'x', 'y'])),
    ('on: {push: {paths: {a: 1, b: {c: 2, d: [3, 4]}}}, "x":{}, y}\npermissions: {issues: {a: b, contents: c}, "contents":"write"}',
     (True, 'flow map', 'write', ['push', 'x', 'y'])),
    ("on: ['a, b', c]",
     (True, 'absent', '', ['a, b', 'c'])),
    ('{url: http://x:80/y#z, on: a b c}',
     (True, 'absent', '', ['a b c'])),
    ('{on: &x push, j: !!str y, k: *x}',
     (True, 'absent', '', ['push'])),
    ('{a: \'it\'\'s\', on: "p\\"q"}',
     (True, 'absent', '', ['p\\"q'])),
    ('{a: [[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]]], on: push}',
     (True, 'absent', '', ['push'])),
    ('{on: push, permissions: {contents: write}} }',
     (False, 'flow map', 'write', ['push'])),
    ("# " + "x" * 3000 + "\n%YAML 1.2\n---\non: push", (True, "absent", "", ["push"])),
]


@pytest.fixture(scope="module")
def headers(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    df = with_header(spark.createDataFrame(rows, "i int, content string"))
    return {r.i: r.header for r in df.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_header(headers, i):
    h = headers[i]
    assert (h.parse_ok, h.permissions_form, h.contents, list(h.triggers)) == CASES[i][1], CASES[i][0]


def test_very_long_documents(spark):
    body = "".join(f"  - e{i} # c\n\n" for i in range(100_000))
    docs = ["on:\n" + body + "  - last\npermissions:\n" + "  a: b\n" * 100_000 + "  contents: write\n",
            "x: 1\n" * 2 + "on: " + "y" * 1_000_000]
    rows = [(i, d) for i, d in enumerate(docs)]
    got = {r.i: r.header for r in with_header(spark.createDataFrame(rows, "i int, content string")).collect()}
    assert got[0].parse_ok and got[0].contents == "write"
    assert len(got[0].triggers) == 100_001 and got[0].triggers[-1] == "last"
    assert not got[1].parse_ok


def test_very_long_flow_documents(spark):
    """Many entries, many tokens and deep nesting in one document, over the seams of chunks."""
    docs = ["{on: push, " + ", ".join(f"k{i}: {{a: [1, 2], b: 'x'}}" for i in range(3_000)) + ", permissions: {contents: write}}",
            "{on: push, a: " + "[" * 5_000 + "]" * 5_000 + "}", "{on: push, a: " + "[" * 5_000 + "]" * 4_999 + "}",
            "{on: {" + ", ".join(f"e{i}: {{x: [y]}}" for i in range(2_500)) + "}}", "{a: 1, " + ", ".join(f"k{i}: 1" for i in range(2_500)) + ", a: 2}"]
    got = {r.i: r.header for r in with_header(spark.createDataFrame(list(enumerate(docs)), "i int, content string")).collect()}
    assert [got[i].parse_ok for i in range(5)] == [True, True, False, True, False]
    assert got[0].contents == "write" and got[0].triggers == ["push"] and got[3].triggers == [f"e{i}" for i in range(2_500)]
