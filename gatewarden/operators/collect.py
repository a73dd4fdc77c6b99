"""Collecting repositories that have workflow files, and repository lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.functions.text import is_workflow_name
from gatewarden.operators.ranking import bounded_by, number_rows


def workflow_items(listings: DataFrame, files_only: bool = True) -> DataFrame:
    """Directory entries that are workflow files; optionally of any type."""
    items = listings.where(is_workflow_name(F.col("name")))
    return items.where(F.col("item_type") == "file") if files_only else items


def collect_repos(candidates: DataFrame, listings: DataFrame, limit: int) -> DataFrame:
    """``full_name, indexed_at, item_ord, path`` of the first repositories with workflows.

    Repositories are taken by index time, newest first, until ``limit`` of them
    have at least one workflow file. Paths stay one row each.
    """
    items = workflow_items(listings)
    having = items.groupBy("full_name").agg(F.count(F.lit(1)).alias("workflows"))
    chosen = (
        candidates.groupBy("full_name")
        .agg(F.max("indexed_at").alias("indexed_at"))
        .join(having, "full_name")
        .orderBy(F.desc("indexed_at"), "full_name")
        .limit(limit)
    )
    return items.join(
        # the limit of the caller bounds this side
        bounded_by(chosen.select("full_name", "indexed_at"), limit), "full_name"
    ).select("full_name", "indexed_at", "item_ord", "path")


def select_repo(repos: DataFrame, full_name: str | None = None) -> DataFrame:
    """The named repository (``owner/name``), or the first one in list order."""
    if full_name is None:
        return repos.orderBy("repo_ord").limit(1)
    if full_name.count("/") != 1:
        raise ValueError(f"expected owner/name, got {full_name!r}")
    return repos.where(F.col("full_name") == full_name)


def parse_manifest(lines: DataFrame) -> DataFrame:
    """``repo_ord, owner, name, full_name, workflows`` from ``line_no, value``.

    Lines without ``": "`` and names without ``/`` are dropped; paths are not
    trimmed, and an empty list of paths gives one empty path.
    """
    value = F.regexp_replace("value", r"(?d)\r\z", "")
    parts = F.split(value, ": ", 2)
    split = lines.select(F.col("line_no").alias("repo_ord"), parts.alias("parts"))
    named = split.where(F.size("parts") == 2).select(
        "repo_ord",
        F.get("parts", F.lit(0)).alias("full_name"),
        F.get("parts", F.lit(1)).alias("paths"),
    )
    owner = F.substring_index("full_name", "/", 1)
    return named.where(F.col("full_name").contains("/")).select(
        "repo_ord",
        owner.alias("owner"),
        F.expr("substr(full_name, instr(full_name, '/') + 1)").alias("name"),
        "full_name",
        F.split("paths", ",", -1).alias("workflows"),
    )


def manifest_paths(repos: DataFrame) -> DataFrame:
    """One row per path with its place in the list."""
    return repos.select(
        "repo_ord", "full_name", F.posexplode("workflows").alias("wf_ord", "path")
    )


def join_parts(repos: DataFrame) -> DataFrame:
    """Put lines of one name together: for lists that were written with ``per_line``.

    The paths follow the order of the lines and the entry takes the place of the first
    one. Lists from elsewhere may name a repository twice on purpose; leave those as
    they are.
    """
    return (
        repos.groupBy("owner", "name", "full_name")
        .agg(
            F.min("repo_ord").alias("repo_ord"),
            F.array_sort(F.collect_list(F.struct("repo_ord", "workflows"))).alias("parts"),
        )
        .select(
            "repo_ord", "owner", "name", "full_name",
            F.flatten(F.transform("parts", lambda p: p["workflows"])).alias("workflows"),
        )
    )


def format_manifest(items: DataFrame, per_line: int | None = None) -> DataFrame:
    """``full_name, value``: one list line per repository from one row per path.

    ``items`` needs ``full_name, item_ord, path``. With ``per_line`` a repository takes
    several lines of at most so many paths (``full_name, part, value``), which
    ``join_parts`` puts together again; without it a line holds all paths.
    """

    def line(paths: Column) -> Column:
        return F.concat(
            F.col("full_name"), F.lit(": "),
            F.array_join(F.transform(paths, lambda x: x["path"]), ","),
        ).alias("value")

    columns = items.select("full_name", "item_ord", "path")
    if per_line is None:
        paths = F.array_sort(F.collect_list(F.struct("item_ord", "path")))
        return columns.groupBy("full_name").agg(paths.alias("paths")).select("full_name", line(F.col("paths")))
    numbered = number_rows(columns, ["full_name"], ["item_ord"], "number").withColumn(
        "part", F.expr(f"(number - 1) div {per_line}").cast("long")
    )
    paths = F.array_sort(F.collect_list(F.struct("number", "path")))
    return numbered.groupBy("full_name", "part").agg(paths.alias("paths")).select(
        "full_name", "part", line(F.col("paths"))
    )
