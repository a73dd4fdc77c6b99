"""Audit tables derived from the given tables.

The given tables hold no workflow text, so each row of ``orders`` and each row of
``documents`` is turned into one workflow file, and the other audit tables come
from ``customer``, ``events`` and ``lineitem`` in the same way. All derivations
work on single rows: no grouping, and the size of every derived table follows that
of its source. Only the narrow rows of ``orders`` move, to be dealt out to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.functions.sql import array, literal, pick, struct
from gatewarden.operators.languages import EXTENSION_LANGUAGE

# Rows of ``orders`` whose workflow files one task derives, about 30 MB of text.
ROWS_PER_TASK = 25_000
# Step lines, chosen by number.
STEP_LINES = (
    "      - run: echo ${{ github.event.issue.title }}",
    "      - run: deploy ${{ github.event.inputs.env }}",
    '      - run: echo "${{ github.event.inputs.env }}"',
    "      - run: a && echo ${{ github.event.comment.body }}",
    "        uses: ./local-action",
    "        uses: acme/tool@main",
    "        uses: acme/tool@device-1",
    "        uses: acme/tool@0123456789abcdef0123456789abcdef01234567",
    "      - uses: acme/tool@main",
    "        uses: acme/tool@main # uses: other",
    "        run: echo ${{ secrets.API }}",
    "        authentication: ${{ secrets.API }}",
    "        env: { K: ${{ secrets.API }} }",
    "        env: { K: ${{ secrets.API }} } # mask: true",
    "          repo-token: ${{ secrets.GITHUB_TOKEN }}",
    "        run: |",
    "          notify ${{ github.event.sender.login }}",
    '          notify "${{ github.event.sender.login }}"',
    "          id ${{ github.event.repository.id }}",
    "          kind ${{ github.event_name }}",
    "",
    "          # remark",
    "      - uses: actions/checkout@v4",
    "          ref: ${{ github.event.pull_request.head.sha }}",
    "          ref: ${{ github.event.pull_request.base.sha }}",
    "    permissions:",
    "          n ${{ github.event.number }}",
)
# Forms of the trigger and permission blocks, chosen by number.
TRIGGERS = (
    "on: push",
    "on: pull_request_target  # privileged",
    "on: [push, 'pull_request_target']",
    '"on":\n  - push\n  - pull_request_target',
    "on:\n  pull_request_target:\n  push:\n    branches: [main]",
    None,
    "on: [pull_request]",
    "on: { pull_request_target: { branches: [main] }, push: {} }",
)
TRIGGERS_AT_COLUMN_0 = '"on":\n- push\n- pull_request_target'
PERMISSIONS = (
    None,
    "permissions: read-all",
    "permissions:\n  contents: write",
    "permissions:\n  issues: read\n  contents: 'admin'",
    "permissions: {}",
    "permissions:\n  contents: read\n  issues: write",
    "permissions: { issues: read, contents: write }",
    "permissions:",
)
# Frames around a document and documents in flow form, chosen by number.
BEFORE = (
    "\ufeff", "# " + "a long remark " * 200 + "\n%YAML 1.2\n---\n", "%YAML 1.2\n---\n", "", "", '"quoted key": x\n', 'label: "two\nlines: here"\n', "",
)
AFTER = (
    "", "\n...\nstray text", "", "", "\n1.2 key: x\na.b: y\n42: z", "", "", "\n---\nname: again\nname: twice",
)
FLOW_DOCUMENTS = (
    "{name: flow, on: [push, pull_request_target], permissions: {contents: write},\n"
    " jobs: {build: {steps: [{uses: actions/checkout@v4}, {run: make}]}}}",
    '{"on":"push","jobs":{"build":{"steps":[{"run":"echo ${{ secrets.X }}"},{"run":"a, {b"}]}}}',
    '{"on":{"push":{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"k":1,"l":[1,[2,3]]}}}}}},"k":2},"z":{"a":{"k":3}}},\n'
    '"pull_request_target":{}},"permissions":{"issues":"read","contents":"admin"},\n'
    '"jobs":{"build":{"steps":[{"uses":"actions/checkout@v4"},{"env":"ref: ${{ github.event.pull_request.head.sha }}"}]}}}',
    '{"on": "push", "jobs": {"a": {"b": {"c": {"d": {"k": 1}, "e": {"k": 2}}}}, "z": {"b": {"c": {"d": {"k": 1}}}}}}',
    '{"on":"push","jobs":{"build":[{"run":"echo ${{ secrets.X }}"}}}',
    '{"on":"push","jobs":{},"jobs":{"a":1}}',
)
JOBS = "jobs:\n  build:\n    steps:"
SCRIPT_HEAD = "      - name: note\n        run: |\n          "
SCRIPT_BREAK = "\n          "
SCRIPT_TAIL = "echo ${{ github.event.issue.title }}"
TREE_DIRECTORIES = (
    "src/", "lib/core/", "vendor/x/", "node_modules/y/", ".git/", ".github/workflows/",
    "dist/", "docs/vendored/", "",
)
TREE_NAMES = tuple(f"f{{}}{ext}" for ext, _ in EXTENSION_LANGUAGE) + (
    "f{}.PY", "f{}.txt", "dist", ".go",
)
META_LANGUAGES = (
    "Go", "golang", "JavaScript", "TypeScript", "jsx", "Python", "Kotlin", "C#", "C++",
    "Ruby", "PHP", "Haskell", "",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str, files: int = 1000) -> DataFrame:
    """The same table as a stream, ``files`` of its files at a time."""
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    # A pattern, because a plain path would have to be a folder.
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def tasks_for(rows: int) -> int:
    """Tasks that share the derived files of so many rows."""
    return max(1, -(-rows // ROWS_PER_TASK))


def dealt_out(rows: DataFrame) -> DataFrame:
    """Deal rows out to tasks by their number: what is derived from a row is far larger than the row.

    Splits of the input follow its bytes and row groups, of which a table of narrow rows has few.
    """
    tasks = tasks_for(rows.count())
    return rows.repartition(tasks) if tasks > 1 else rows


def _pick(values: tuple[str | None, ...], number: str) -> Column:
    return F.expr(pick(values, number))


def repo_name(repo_id: Column) -> Column:
    return F.concat(
        F.lit("org"), (repo_id % 7).cast("string"), F.lit("/repo"), repo_id.cast("string")
    )


def workflow_path(file_id: Column) -> Column:
    return F.concat(F.lit(".github/workflows/wf"), file_id.cast("string"), F.lit(".yml"))


def _shift_indent(line: str) -> str:
    body = line.lstrip(" ")
    return line[: len(line) - len(body)] + (" " if body else "") + body


def _content(fid: str, body: str) -> str:
    """Header, body and, for some file numbers, an irregularity."""
    triggers = (
        f"if({fid} % 8 = 3 and {fid} div 64 % 2 = 1, {literal(TRIGGERS_AT_COLUMN_0)}, "
        f"{pick(TRIGGERS, f'{fid} % 8')})"
    )
    twice = literal("permissions: read-all\npermissions: read-all")
    text = (
        f"concat_ws('\\n', concat('name: wf', {fid}), {triggers}, "
        f"{pick(PERMISSIONS, f'{fid} div 8 % 8')}, if({fid} % 31 = 13, {twice}, null), "
        f"{literal(JOBS)}, if({fid} % 29 = 11, '\\tbad: tab', null), {body}, "
        f"if({fid} % 17 = 7, '', null))"
    )
    odd, form = f"{fid} % 53 = 29", f"{fid} div 53 % 8"
    text = f"concat(if({odd}, {pick(BEFORE, form)}, ''), {text}, if({odd}, {pick(AFTER, form)}, ''))"
    return (
        f"case when {fid} % 37 = 17 then '' when {fid} % 41 = 19 then '# nothing here' "
        f"when {odd} and {form} = 3 then {pick(FLOW_DOCUMENTS, f'{fid} div 424 % {len(FLOW_DOCUMENTS)}')} "
        f"when {fid} % 43 = 23 then '- item\\n- other' "
        f"when {fid} % 11 = 3 then replace({text}, '\\n', '\\r\\n') else {text} end"
    )


def workflow_files(spark: SparkSession, sf_dir: str, stream: bool = False, files: int = 1000) -> DataFrame:
    """``full_name, repo_ord, wf_ord, path, content``: one file per order and document."""

    def source(name: str, *columns: str) -> DataFrame:
        if stream:
            return stream_table(spark, sf_dir, name, files).select(*columns)
        rows = table(spark, sf_dir, name).select(*columns)
        # Documents hold most of their file already: their splits by bytes are as good.
        return dealt_out(rows) if name == "orders" else rows

    shifted = [_shift_indent(s) for s in STEP_LINES]
    # What is the same for all steps of a file is bound once (``f``), apart from the function of a step.
    same = struct(
        first="o_custkey * 7 + o_orderkey * 5", pace="o_custkey % 13 + 1", last="o_custkey % 45 + 3",
        lines=f"if(o_orderkey % 13 = 5, {array(shifted)}, {array(STEP_LINES)})",
    )
    line = "get(f.lines, cast((f.first + i * (i * 2 + f.pace)) % 27 as int))"
    steps = f"get(transform(array({same}), f -> array_join(transform(sequence(0, f.last), i -> {line}), '\\n')), 0)"
    from_orders = source("orders", "o_orderkey", "o_custkey").selectExpr(
        "concat('org', o_orderkey div 6 % 7, '/repo', o_orderkey div 6) as full_name",
        "o_orderkey div 6 as repo_ord",
        "cast(o_orderkey % 6 as int) as wf_ord",
        "concat('.github/workflows/wf', o_orderkey, '.yml') as path",
        f"{_content('o_orderkey', steps)} as content",
    )
    script = (
        f"concat({literal(SCRIPT_HEAD)}, replace(text, '\\n', {literal(SCRIPT_BREAK)}), "
        f"if(doc_id % 3 = 0, {literal(SCRIPT_BREAK + SCRIPT_TAIL)}, ''))"
    )
    from_documents = source("documents", "doc_id", "text", "source").selectExpr(
        "concat('docs/', source, '-', doc_id div 4) as full_name",
        "-1 - doc_id div 4 as repo_ord",
        "cast(doc_id % 4 as int) as wf_ord",
        "concat('.github/workflows/doc', doc_id, '.yaml') as path",
        f"{_content('doc_id', script)} as content",
    )
    return from_orders.unionByName(from_documents)


def workflow_files_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as base64; some of them are cut so that they do not decode."""
    files = workflow_files(spark, sf_dir)
    text = F.base64(F.col("content").cast("binary"))
    broken = (F.length("content") > 0) & (F.col("repo_ord") % 47 == 5)
    return files.select(
        "full_name", "repo_ord", "wf_ord", "path",
        F.when(broken, F.concat(F.lit("*"), text)).otherwise(text).alias("content_b64"),
    )


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, value``: a repository list with all irregular kinds of line."""
    key = F.col("c_custkey")
    kind = key % 23

    def paths(repo: Column) -> Column:
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")),
                lambda i: workflow_path(repo * 6 + i),
            ),
            ",",
        )

    regular = F.concat(repo_name(key), F.lit(": "), paths(key))
    value = (
        F.when(kind == 3, F.lit(""))
        .when(kind == 4, F.lit("   "))
        .when(kind == 5, F.concat(repo_name(key), F.lit(" "), paths(key)))
        .when(kind == 6, F.concat(F.lit("repo"), key.cast("string"), F.lit(": "), paths(key)))
        .when(kind == 7, F.concat(repo_name(key), F.lit("/sub: "), paths(key)))
        .when(kind == 8, F.concat(repo_name(key), F.lit(": ")))
        .when(
            kind == 9,
            F.concat(
                repo_name(key), F.lit(": "), workflow_path(key * 6), F.lit(", "),
                workflow_path(key * 6 + 1),
            ),
        )
        .when(kind == 10, F.concat(repo_name(key - 1), F.lit(": "), paths(key - 1)))
        .when(kind == 11, F.concat(regular, F.lit(": x")))
        .when(kind == 12, F.concat(regular, F.lit("\r")))
        .otherwise(regular)
    )
    return table(spark, sf_dir, "customer").select(key.alias("line_no"), value.alias("value"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``full_name, item_ord, item_type, name, path``: directory entries."""
    key = F.col("o_orderkey")
    name = (
        F.when(key % 6 == 0, F.concat(F.lit("ci"), key.cast("string"), F.lit(".yml")))
        .when(key % 6 == 1, F.concat(F.lit("ci"), key.cast("string"), F.lit(".yaml")))
        .when(key % 6 == 2, F.concat(F.lit("ci"), key.cast("string"), F.lit(".YML")))
        .when(key % 6 == 3, F.concat(F.lit("ci"), key.cast("string"), F.lit(".md")))
        .when(key % 6 == 4, F.concat(F.lit("ci"), key.cast("string"), F.lit(".yml")))
        .otherwise(F.lit("yml"))
    )
    return table(spark, sf_dir, "orders").select(
        repo_name(F.col("o_custkey")).alias("full_name"),
        key.alias("item_ord"),
        F.when(key % 6 == 4, "dir").otherwise("file").alias("item_type"),
        name.alias("name"),
        F.concat(F.lit(".github/workflows/"), name).alias("path"),
    )


def repo_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository metadata; one row per customer."""
    key = F.col("c_custkey")
    seconds = key * 7919 % 100003
    full = F.when(key % 29 == 7, F.concat(repo_name(key), F.lit("/extra"))).otherwise(
        repo_name(key)
    )
    return table(spark, sf_dir, "customer").select(
        full.alias("full_name"),
        _pick(META_LANGUAGES, "c_custkey % 13").alias("language"),
        (key % 3 == 0).alias("is_fork"),
        F.timestamp_seconds(F.lit(1600000000) + key * 3600).alias("created_at"),
        F.timestamp_seconds(F.lit(1700000000) + seconds).alias("updated_at"),
        F.timestamp_seconds(F.lit(1710000000) + key * 104729 % 1000003).alias("indexed_at"),
    )


def registry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``full_name, processed_at, success, message``: every outcome ever recorded."""
    return table(spark, sf_dir, "events").select(
        repo_name(F.col("user_id")).alias("full_name"),
        F.col("ts").cast("timestamp").alias("processed_at"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("message"),
    )


def repo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``full_name, path``: files of repositories; one row per line item."""
    choice = (
        "case l_orderkey div 48 % 5 when 0 then 5 when 1 then 20 "
        "when 2 then l_partkey % 2 * 6 + l_linenumber % 2 * 8 else l_partkey % 23 end"
    )
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(*columns).select(
        repo_name(F.expr("l_orderkey div 48")).alias("full_name"),
        F.concat(
            _pick(TREE_DIRECTORIES, "l_suppkey % 9"),
            F.replace(_pick(TREE_NAMES, choice), F.lit("{}"), F.col("l_partkey").cast("string")),
        ).alias("path"),
    )
