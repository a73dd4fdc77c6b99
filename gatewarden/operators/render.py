"""Scanner configurations per repository, rendered from templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.operators.languages import ecosystem, scanner_language
from gatewarden.operators.ranking import number_rows
from gatewarden.session import cut_lineage


@dataclass(frozen=True)
class Template:
    tool: str
    target_path: str
    body: str
    optional: bool = False


_CODE = """name: code-analysis
on: [push, pull_request]
permissions:
  contents: read
  security-events: write
jobs:
  analyze:
    runs-on: ubuntu-latest
    strategy:
      matrix:
        language: [ 'language' ]
    steps:
      - uses: actions/checkout@v4
      - uses: github/codeql-action/init@v3
        with:
          languages: ${{ matrix.language }}
      - uses: github/codeql-action/analyze@v3
"""
_UPDATES = """version: 2
updates:
  - package-ecosystem: "gomod"
    directory: "/"
    schedule:
      interval: "weekly"
"""
_SECRETS = """name: secret-scan
on: [push, pull_request]
permissions: read-all
jobs:
  secrets:
    runs-on: ubuntu-latest
    steps:
      - uses: actions/checkout@v4
      - uses: gitleaks/gitleaks-action@v2
"""
_CONTAINER = """name: container-scan
on: [push]
permissions: read-all
jobs:
  image:
    runs-on: ubuntu-latest
    steps:
      - uses: actions/checkout@v4
      - uses: aquasecurity/trivy-action@0.24.0
"""
TEMPLATES = (
    Template("codeql", ".github/workflows/codeql.yml", _CODE),
    Template("dependabot", ".github/dependabot.yml", _UPDATES),
    Template("gitleaks", ".github/workflows/gitleaks.yml", _SECRETS, optional=True),
    Template("container-scan", ".github/workflows/container-scan.yml", _CONTAINER, optional=True),
)


def read_templates(spark: SparkSession, folder: str) -> tuple[Template, ...]:
    """Templates from text files; those of known tools keep their target path.

    More than 100 files are refused here; ``template_files`` reads any number as a table.
    """
    rows = (
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.yml")
        .select(F.regexp_extract("_metadata.file_name", r"^(.*)\.yml$", 1).alias("tool"), "value")
        .limit(101)
        .collect()
    )
    if len(rows) > 100:
        raise ValueError("a folder of at most 100 templates is expected")
    known = {t.tool: t for t in TEMPLATES}
    found = []
    for tool, body in sorted(map(tuple, rows)):
        base = known.get(tool, Template(tool, f".github/workflows/{tool}.yml", "", True))
        found.append(Template(tool, base.target_path, body, base.optional))
    return tuple(found)


def template_files(spark: SparkSession, folder: str) -> DataFrame:
    """``tool, path, body, optional`` of the text files of a folder, however many.

    Templates of known tools keep their target path; others are optional.
    """
    known = {t.tool: t for t in TEMPLATES}
    tool = F.col("tool")

    def of_known(field: str, other: Column) -> Column:
        pairs = [F.lit(x) for t in known.values() for x in (t.tool, getattr(t, field))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), tool), other)

    return (
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.yml")
        .select(F.regexp_extract("_metadata.file_name", r"^(.*)\.yml$", 1).alias("tool"), "value")
        .select(
            "tool",
            of_known("target_path", F.concat(F.lit(".github/workflows/"), tool, F.lit(".yml"))).alias("path"),
            F.col("value").alias("body"),
            of_known("optional", F.lit(True)).alias("optional"),
        )
    )


BLOCK = 100
MAX_TEMPLATE_BYTES = 32 << 20


def _each_template(repos: DataFrame, templates: DataFrame) -> DataFrame:
    """Every repository with every template of a table.

    Templates are numbered and put together in blocks of ``BLOCK``; a repository meets
    the blocks by their number. The blocks are broadcast if they are few.
    """
    numbered = number_rows(templates, [], ["tool"], "number")
    blocks = cut_lineage(
        numbered.groupBy(F.expr(f"(number - 1) div {BLOCK}").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("tool", "path", "body"))).alias("rows"))
    )
    count = blocks.count()
    if not count:
        nothing = [F.lit("").alias(name) for name in ("tool", "path", "body")]
        return repos.limit(0).select("full_name", "language", *nothing)
    size = blocks.select(F.sum(F.octet_length(F.to_json("rows")))).first()[0]
    wanted = repos.select("full_name", "language", F.explode(F.expr(f"sequence(0L, {count - 1}L)")).alias("block"))
    side = F.broadcast(blocks) if size <= MAX_TEMPLATE_BYTES else blocks
    return wanted.join(side, "block").select("full_name", "language", F.inline("rows"))


def _fill(body: Column, language: Column, as_list: bool) -> Column:
    """Put the language, or a block list of several, into the template."""
    items = F.transform(
        F.split(language, ",", -1),
        lambda x: F.concat(F.lit("\n        - '"), F.trim(x), F.lit("'")),
    )
    listed = F.replace(body, F.lit("[ 'language' ]"), F.array_join(items, ""))
    single = F.replace(body, F.lit("'language'"), F.concat(F.lit("'"), language, F.lit("'")))
    return F.when(language.contains(","), listed).otherwise(single) if as_list else single


def repo_languages(meta: DataFrame, detected: DataFrame) -> DataFrame:
    """``full_name, language, ecosystem``: from the tree, else from metadata."""
    from_tree = detected.where(F.col("detected") != "").select(
        "full_name", F.col("language").alias("tree_language")
    )
    language = F.coalesce("tree_language", scanner_language(F.col("language")))
    return (
        meta.select("full_name", "language")
        .join(from_tree, "full_name", "left")
        .select("full_name", language.alias("language"))
        .withColumn("ecosystem", ecosystem(F.col("language")))
    )


def render(
    repos: DataFrame,
    templates: tuple[Template, ...] | DataFrame = TEMPLATES,
    enabled: tuple[str, ...] = ("gitleaks", "container-scan"),
    as_list: bool = True,
) -> DataFrame:
    """``full_name, tool, path, content``: one row per repository and template.

    Optional templates are used when they are named in ``enabled``. Several
    languages become a block list unless ``as_list`` is off. ``templates`` may be a
    table (``template_files``) of any size.
    """
    filled = _fill(F.col("body"), F.col("language"), as_list).alias("content")
    if isinstance(templates, DataFrame):
        chosen = templates.where(~F.col("optional") | F.col("tool").isin(list(enabled)))
        return _each_template(repos, chosen).select("full_name", "tool", "path", filled)
    used = [t for t in templates if not t.optional or t.tool in enabled]
    rows = F.array(
        *[
            F.struct(
                F.lit(t.tool).alias("tool"),
                F.lit(t.target_path).alias("path"),
                F.lit(t.body).alias("body"),
            )
            for t in used
        ]
    )
    return repos.select("full_name", "language", F.inline(rows)).select(
        "full_name", "tool", "path", filled
    )
