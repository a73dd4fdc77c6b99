"""Roll-ups of findings and the Markdown report.

Counts are combined before they are shuffled. The report is a table of text
blocks in order; it is written by many tasks and never put together in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewarden.functions.text import unicode_trim
from gatewarden.operators.ranking import number_in_units, write_ordered_text
from gatewarden.operators.rules import SEVERITIES, LineRule
from gatewarden.operators.scan import FINDING_ORDER, with_catalog
from gatewarden.session import cut_lineage, temporary_tables

BAR_WIDTH = 20
#: General advice, the last block of a report.
ADVICE = """
## What to do in general

1. State `permissions` in every workflow, read-only at the top, and widen them for single jobs.
2. Pin actions of others to a full commit hash; a tag or a branch can be moved.
3. Pass values from events to scripts through environment variables, and check their form first.
4. Keep jobs that hold secrets apart from jobs that run code of a pull request.
5. Never print a secret, and hand it only to the step that needs it.
6. Let a code scanner, a secret scanner and a dependency updater run on every repository.
"""


def total(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("findings"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Count per severity; the three known ones always appear."""
    counted = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    known = findings.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(s) for s in SEVERITIES])).alias("rank", "severity")
    )
    return known.join(counted, "severity", "full_outer").select(
        "severity",
        F.coalesce("rank", F.lit(len(SEVERITIES))).alias("severity_rank"),
        F.coalesce("n", F.lit(0).cast("long")).alias("findings"),
    )


def severity_bars(findings: DataFrame) -> DataFrame:
    """A bar of up to 20 blocks per severity, relative to the largest count."""
    # One row per severity.
    largest = F.max("findings").over(Window.partitionBy(F.lit(0)))
    counted = by_severity(findings).withColumn("largest", largest)
    blocks = F.expr(f"findings * {BAR_WIDTH} div largest").cast("int")
    return counted.where("largest > 0").select(
        "severity", "severity_rank", "findings", F.repeat(F.lit("█"), blocks).alias("bar")
    )


def by_type(findings: DataFrame) -> DataFrame:
    """Count per type, largest first, equal counts by name."""
    return (
        findings.groupBy("type")
        .agg(F.count(F.lit(1)).alias("findings"))
        .orderBy(F.desc("findings"), "type")
    )


def per_repo(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Count per repository; ``repos`` names those that appear with zero too."""
    # One aggregate, combined before the shuffle, in place of distinct, count and join.
    named = repos.select("full_name", F.lit(0).cast("long").alias("n"))
    hits = findings.select("full_name", F.lit(1).cast("long").alias("n"))
    known = F.max(F.col("n") == 0)
    counted = named.unionByName(hits).groupBy("full_name").agg(F.sum("n").alias("findings"), known.alias("known"))
    return counted.where("known").drop("known")


def occurrences(findings: DataFrame, written: bool = False) -> DataFrame:
    """Number the findings of each type in reporting order (``written``: they are a written table already).

    Counts are kept per repository and type, so what is added up is far smaller than the findings.
    """
    repository, rest = FINDING_ORDER[:1], FINDING_ORDER[1:]
    return number_in_units(findings, ["type"], repository, rest, "occurrence", written=written)


def first_of_type(findings: DataFrame, written: bool = False) -> DataFrame:
    """The finding of each type that comes first; it stands for the type.

    The least of a struct makes Spark sort all rows by type. Where the findings are a
    written table, which can be read twice (``written``), the least repository of each
    type is found first, and only findings in those are compared.
    """
    value = F.struct("rule_id", "severity", "full_name", "path", "line")
    first, rows = F.min_by(value, F.struct(*FINDING_ORDER)).alias("first"), F.count(F.lit(1)).alias("findings")
    if not written:
        return findings.groupBy("type").agg(first, rows).select("type", "findings", "first.*")
    lead = F.col(FINDING_ORDER[0])
    # Null comes before any number.
    least = findings.groupBy(F.col("type").alias("_type")).agg(
        rows, F.when(~F.max(lead.isNull()), F.min(lead)).alias("_least")
    )
    # One row per type of the catalogue.
    meet = F.col("type").eqNullSafe(F.col("_type")) & lead.eqNullSafe(F.col("_least"))
    return (
        findings.join(F.broadcast(least), meet)
        .groupBy("type", "findings")
        .agg(first)
        .select("type", "findings", "first.*")
    )


def _block(section: int, type_rank: Column, occurrence: Column, text: Column) -> list[Column]:
    return [
        F.lit(section).alias("section"),
        type_rank.cast("long").alias("type_rank"),
        occurrence.cast("long").alias("occurrence"),
        text.alias("text"),
    ]


def report(
    findings: DataFrame, run_time: str, extra_rules: tuple[LineRule, ...] = ()
) -> DataFrame:
    """Blocks ``section, type_rank, occurrence, text`` of the Markdown report.

    The findings are written once to the shared folder; all parts read them there.
    """
    findings = cut_lineage(findings)
    zero = F.lit(0)
    head = total(findings).select(
        *_block(
            0, zero, zero,
            F.concat(
                F.lit(f"# CI workflow findings\n\n**Date**: {run_time}\n\n**Findings**: "),
                F.col("findings").cast("string"),
                F.lit("\n\n## By severity\n"),
            ),
        )
    )
    bars = severity_bars(findings).select(
        *_block(
            1, zero, F.col("severity_rank"),
            F.concat(
                F.lit("    "), F.rpad("severity", 8, " "), F.col("bar"), F.lit(" ("),
                F.col("findings").cast("string"), F.lit(")"),
            ),
        )
    )
    # One row per type.
    ranked = first_of_type(findings, written=True).withColumn(
        "type_rank",
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("findings"), "type")),
    )
    types = ranked.select(
        *_block(
            2, F.col("type_rank"), zero,
            F.concat(
                F.when(F.col("type_rank") == 1, F.lit("\n## By type\n\n")).otherwise(F.lit("")),
                F.lit("- **"), F.col("type"), F.lit("**: "), F.col("findings").cast("string"),
            ),
        )
    )
    details = with_catalog(ranked, extra_rules).select(
        *_block(
            3, F.col("type_rank"), zero,
            F.concat(
                F.lit("\n## "), F.col("type"), F.lit(" ("), F.col("findings").cast("string"),
                F.lit(")\n\n**Description**: "), F.col("description"),
                F.lit("\n\n**Severity**: "), F.col("severity"),
                F.lit("\n\n**Impact**: "), F.col("impact"),
                F.lit("\n\n**Exploit**: "), F.col("exploit"),
                F.lit("\n\n**Mitigation**: "), F.col("mitigation"),
                F.lit("\n\n**References**: "), F.array_join("refs", ", "), F.lit("\n"),
            ),
        )
    )
    numbered = occurrences(findings, written=True).join(
        # one row per type of the catalogue
        F.broadcast(ranked.select("type", "type_rank")), "type"
    )
    listed = numbered.select(
        *_block(
            3, F.col("type_rank"), F.col("occurrence"),
            F.concat(
                F.lit("### Occurrence "), F.col("occurrence").cast("string"), F.lit(" - "),
                F.col("full_name"), F.lit(" "), F.col("path"), F.lit(", line "),
                F.col("line").cast("string"), F.lit("\n\n    "), unicode_trim(F.col("details")),
                F.lit("\n"),
            ),
        )
    )
    advice = findings.sparkSession.range(1).select(*_block(4, zero, zero, F.lit(ADVICE)))
    return head.unionByName(bars).unionByName(types).unionByName(details).unionByName(listed).unionByName(advice)


def write_report(
    findings: DataFrame, run_time: str, path: str, extra_rules: tuple[LineRule, ...] = ()
) -> None:
    with temporary_tables(findings.sparkSession):
        blocks = report(findings, run_time, extra_rules)
        write_ordered_text(blocks, ["section", "type_rank", "occurrence"], path)
