"""Numbering of rows that does not bring a group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewarden.session import cut_lineage


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str,
    descending: Sequence[str] = (),
    written: bool = False,
) -> DataFrame:
    """``row_number`` inside ``group`` by ``order`` for groups of any size.

    The rows are written once, placed in ranges by (group, order) and written again, so
    that the ranges stay as they are when executors are lost. The place of a row in its
    range is the lower part of its id; the rows of the group in earlier ranges are
    added. Columns of ``group`` must not be null. Rows that agree in all of them may
    take any order; their place in the first table keeps them apart. A caller that has
    written ``df`` already says so (``written``) and saves the first copy.
    """
    names = df.columns
    unique = F.monotonically_increasing_id().alias("_id")

    def direction(name: str) -> Column:
        return F.desc(name) if name in descending else F.asc(name)

    by = [F.asc(c) for c in group] + [direction(c) for c in order] + [F.asc("_id")]
    # Finding the ranges reads the written rows, not what they are computed from.
    rows = df.select("*", unique) if written else cut_lineage(df.select("*", unique))
    # The lower 33 bits of the id are the place of a row in its sorted range.
    placed = cut_lineage(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_id")
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    # One row per range and group that meets it.
    earlier = (
        Window.partitionBy(*(group or [F.lit(0)]))
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        placed.groupBy("_range", *group)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
        .select(
            "_range", *group,
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_offset"),
        )
    )
    number = (F.col("_offset") + F.col("_place")).cast("long")
    return placed.join(offsets, ["_range", *group]).select(*names, number.alias(out))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The sum of ``value`` over the rows of ``group`` that come earlier by ``order``.

    Sums are taken in two levels: inside ranges by (group, order), and over the ranges
    before. A group of any size is spread over many ranges; ``group`` must not be null
    and (group, order) must name a row. Meant for counts and sizes, not for wide rows.
    """
    by = [*group, *order]
    placed = cut_lineage(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = (Window.unboundedPreceding, -1)
    # One row per range and group that meets it.
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(*before)
    bases = placed.groupBy("_range", *group).agg(F.sum(value).alias("_sum")).select(
        "_range", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(*before)
    within = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    total = (F.col("_base") + F.col("_inside")).cast("long")
    return within.join(bases, ["_range", *group]).select(*df.columns, total.alias(out))


UNIT_ROWS = 1_000_000


def number_in_units(
    df: DataFrame,
    group: Sequence[str],
    unit: Sequence[str],
    within: Sequence[str],
    out: str,
    written: bool = False,
    max_rows: int = UNIT_ROWS,
) -> DataFrame:
    """``row_number`` inside ``group`` by (unit, within), from counts per unit.

    A unit is a piece that a task can hold, such as the findings of a repository. The rows
    move once, to their unit, and are numbered there; what is added are sums of counts
    over the earlier units of the group, one row per unit and group. The groups of one
    unit must be few, such as the types of findings. Where ``unit`` is the group itself
    nothing is added. Units of more than ``max_rows`` rows are numbered by ranges, and so
    is everything if a column of a unit is null. ``group`` must not be null. The result
    is partitioned by ``unit`` if no unit is that large.
    """
    names = df.columns
    df = df if written else cut_lineage(df)
    unit, group, both = list(unit), list(group), list(dict.fromkeys([*unit, *group]))
    counts = cut_lineage(df.groupBy(*both).agg(F.count(F.lit(1)).alias("_rows")))
    sizes = counts.groupBy(*unit).agg(F.sum("_rows").alias("_rows"))
    blank = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in unit])
    most, nulls = sizes.agg(F.max("_rows"), F.max(blank)).first()
    if nulls:
        return number_rows(df, group, [*unit, *within], out)

    def numbered(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*both).orderBy(*within))
        return rows.repartition(*unit).withColumn(out, place.cast("long"))

    if (most or 0) <= max_rows:
        local = numbered(df)
    else:
        # There is at most one such unit in ``max_rows`` rows.
        heavy = broadcast_if_small(sizes.where(F.col("_rows") > max_rows).select(*unit))
        local = numbered(df.join(heavy, unit, "left_anti")).unionByName(
            number_rows(df.join(heavy, unit, "left_semi").select(*names), both, within, out)
        )
    if set(group) == set(unit):
        return local.select(*names, out)
    key = F.struct(*group)
    offsets = (
        running_total(counts, group, [c for c in unit if c not in group], "_rows", "_before")
        .groupBy(*unit)
        .agg(F.map_from_entries(F.collect_list(F.struct(key, "_before"))).alias("_offsets"))
    )
    number = F.col(out) + F.try_element_at("_offsets", key)
    return local.join(offsets, unit).select(*names, number.alias(out))


MAX_BROADCAST_ROWS = 100_000


def bounded_by(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df``, which a limit of ``rows`` bounds, for broadcast if that is small."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; looks at one row more at most."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when it has at most ``max_rows`` rows.

    A larger side is returned as it is and the join is left to the optimizer.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def write_ordered_text(df: DataFrame, order: Sequence[str], path: str, text: str = "text") -> None:
    """Write ``text`` so that the part files in name order give the whole document."""
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(text)
        .write.mode("overwrite")
        .text(path)
    )
