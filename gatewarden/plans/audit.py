"""The three batch flows: collect repositories, analyze them, roll configurations out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewarden.operators import collect, languages, registry, render, report, sarif
from gatewarden.operators.ranking import MAX_BROADCAST_ROWS, bounded_by
from gatewarden.operators.rules import LineRule
from gatewarden.operators.scan import scan
from gatewarden.sources.contents import listed_contents, marked_contents
from gatewarden.sources.text_lists import write_manifest

DEFAULT_ANALYZED = 50
DEFAULT_COLLECTED = 5_000


def collect_flow(candidates: DataFrame, listings: DataFrame, path: str,
                 limit: int = DEFAULT_COLLECTED) -> None:
    """Find the first repositories with workflows and write them as a list."""
    write_manifest(collect.collect_repos(candidates, listings, limit), path)


def scan_listed(repos: DataFrame, contents: DataFrame, limit: int | None = DEFAULT_ANALYZED,
                extra_rules: tuple[LineRule, ...] = (), only: str | None = None,
                stored: bool = False) -> DataFrame:
    """Findings of the first ``limit`` listed repositories, in list order.

    The distinct listed paths go to the files first, so that only listed files are
    scanned; the findings, which are smaller than the contents, then meet the list. A
    list too long to be broadcast goes there as marks: a few other files are scanned
    too, but no content moves, and the findings still meet the list. ``only`` names one repository in place of the limit.
    ``stored`` says that ``contents`` is a store (``contents.write_store``): no content is
    moved then, and of one repository only its row groups are read.
    """
    if only is not None:
        repos = collect.select_repo(repos, only)
        contents = contents.where(F.col("full_name") == only)
    elif limit is not None:
        repos = repos.orderBy("repo_ord").limit(limit)
    paths = collect.manifest_paths(repos)
    count = paths.count() if only is None and limit is None and not stored else 0
    if count <= MAX_BROADCAST_ROWS:
        listed = listed_contents(paths, contents, stored)
    else:
        listed = marked_contents(paths, contents, count)
        paths = paths.hint("shuffle_hash")
    found = scan(
        listed.selectExpr("full_name", "0L as repo_ord", "0 as wf_ord", "path", "content"),
        extra_rules=extra_rules,
    )
    columns = found.columns
    return found.drop("repo_ord", "wf_ord").join(paths, ["full_name", "path"]).select(*columns)


def analyze_flow(repos: DataFrame, contents: DataFrame, path: str, run_time: str,
                 run_start: str, run_end: str, form: str = "md",
                 limit: int | None = DEFAULT_ANALYZED, extra_rules: tuple[LineRule, ...] = (),
                 only: str | None = None, information_uri: str | None = None,
                 stored: bool = False, compression: str | None = None) -> None:
    """Scan and report; ``sarif`` gives exchange documents (in files of a ``compression``), anything else Markdown."""
    findings = scan_listed(repos, contents, limit, extra_rules, only, stored)
    if form == "sarif":
        sarif.write_sarif(
            findings, run_start, run_end, path, extra_rules, information_uri, compression=compression
        )
    else:
        report.write_report(findings, run_time, path, extra_rules)


@dataclass(frozen=True)
class Rollout:
    """Tables that a roll-out produces."""

    batch: DataFrame
    configurations: DataFrame
    registry: DataFrame
    counters: DataFrame


def rollout_flow(repos: DataFrame, known: DataFrame, meta: DataFrame, tree: DataFrame,
                 run_time: str, limit: int, enabled: tuple[str, ...] = (),
                 only: str | None = None) -> Rollout:
    """Configurations for the next pending repositories and the updated registry.

    Every repository of the batch gets configurations: its language comes from its
    tree, else from its metadata, else it is the default. Outcomes follow from what was
    rendered. ``batch`` numbers the repositories (``position`` of ``total``).
    """
    if only is not None:
        repos = collect.select_repo(repos, only)
    # At most ``limit`` rows: the positions need no distributed numbering.
    every = Window.partitionBy(F.lit(0))
    batch = registry.batch(repos, known, limit).select(
        "full_name", "repo_ord",
        F.row_number().over(every.orderBy("repo_ord")).alias("position"),
        F.count(F.lit(1)).over(every).cast("int").alias("total"),
    )
    names = bounded_by(batch.select("full_name"), limit)
    detected = languages.detect_languages(tree.join(names, "full_name", "left_semi"))
    described = meta.join(names, "full_name", "left_semi").groupBy("full_name").agg(F.first("language").alias("language"))
    chosen = render.repo_languages(batch.select("full_name").join(described, "full_name", "left"), detected)
    configurations = render.render(chosen, enabled=enabled)
    outcomes = configurations.groupBy("full_name").agg(F.count(F.lit(1)).alias("n")).select(
        "full_name",
        F.lit(run_time).cast("timestamp").alias("processed_at"),
        (F.col("n") > 0).alias("success"),
        F.lit("processed").alias("message"),
    )
    return Rollout(
        batch,
        configurations,
        registry.upsert(known, outcomes),
        registry.counters(repos, known, limit),
    )
