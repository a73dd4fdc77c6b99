"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.session import cut_lineage

#: Most rows and bytes of a table that is broadcast after its size was read.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as a string, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def broadcast_if_bounded(table: DataFrame, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """``table``, written once, with a broadcast hint only if it is proven small.

    Larger tables come back without a hint, so that Spark shuffles both sides and
    may split skewed partitions.
    """
    table = cut_lineage(table)
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text_columns), F.lit(32))
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table


def text_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, list]]:
    """Values of a string column in slices of about ``most`` characters (one text at least)."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, values.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, values.slice(start).to_pylist()
