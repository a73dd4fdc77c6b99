"""Reading and writing repository lists, one repository per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.operators.collect import format_manifest, join_parts, parse_manifest
from gatewarden.operators.ranking import number_rows, write_ordered_text


def read_manifest(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Repositories of a list file or folder, in the order of the lines.

    Lines are numbered over (file, split, place in the split), so a long file is
    read by many tasks. ``parts`` joins the lines of a name (see ``join_parts``).
    """
    # Only LF ends a line; the parser drops a CR before it.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    numbered = number_rows(lines, [], ["file", "block", "place"], "line_no")
    repos = parse_manifest(numbered.select("line_no", "value"))
    return join_parts(repos) if parts else repos


def write_manifest(items: DataFrame, path: str, per_line: int | None = None) -> None:
    """Write ``full_name: path,path`` lines from one row per path."""
    lines = format_manifest(items, per_line)
    write_ordered_text(lines, [c for c in lines.columns if c != "value"], path, "value")
