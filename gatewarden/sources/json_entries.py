"""Entries of a JSON object of any size and layout, cut out by many tasks.

The text is read in pieces that end at a closing brace, so even one long line is
split. Whether a brace closes an entry depends on all text before it: on the quotes (is the
brace inside a string?) and on the depth. Each block of a file (what Spark reads as a
split) states what it does to both, for either state at its start; these statements, one row a
block, are put together in order, and every piece then knows its depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewarden.operators.ranking import running_total
from gatewarden.session import cut_lineage

_BLOCK = ["file", "block"]
_KEYS = [*_BLOCK, "place"]
_BEFORE = (Window.unboundedPreceding, -1)


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, place, value, ended``: the text between closing braces, in order.

    The reader drops the brace; only the sizes tell whether the last piece of a file had one.
    """
    read = cut_lineage(
        spark.read.option("lineSep", "}").text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            F.col("_metadata.file_size").alias("size"),
            "value",
        )
    )
    files = read.groupBy("file").agg(
        F.max(F.struct("block", "place")).alias("last"),
        (F.sum(F.octet_length("value") + 1) <= F.max("size")).alias("closed"),
    )
    is_last = (F.col("block") == F.col("last.block")) & (F.col("place") == F.col("last.place"))
    return read.join(files, "file").select(*_KEYS, "value", (F.col("closed") | ~is_last).alias("ended"))


def _effects(pieces: DataFrame) -> DataFrame:
    """What a piece does: the parity of its quotes, and the braces it opens when it starts outside (0) or inside (1) a string."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # backslashes occur in strings only

    def opens(text: Column) -> Column:
        return _count(F.regexp_replace(text, r'"[^"]*+(?:"|\z)', ""), "{").cast("long")

    return pieces.select(
        *_KEYS, "ended", (_count(bare, '"') % 2).alias("odd"),
        opens(bare).alias("opens0"), opens(F.concat(F.lit('"'), bare)).alias("opens1"),
    )


def _with_ends(effects: DataFrame) -> DataFrame:
    """``file, block, place, depth, end``: depth behind each piece, and 1 where an entry or a document ends."""
    inside = Window.partitionBy(*_BLOCK).orderBy("place")
    quotes = F.coalesce(F.sum("odd").over(inside.rowsBetween(*_BEFORE)), F.lit(0))

    def change(start: int) -> Column:
        quoted = (F.col("quotes") + start) % 2 == 1
        closes = F.col("ended") & ((F.col("quotes") + start + F.col("odd")) % 2 == 0)
        return F.when(quoted, F.col("opens1")).otherwise(F.col("opens0")) - closes.cast("long")

    placed = cut_lineage(
        effects.withColumn("quotes", quotes)
        .select("*", change(0).alias("change0"), change(1).alias("change1"))
        .withColumn("depth0", F.sum("change0").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("depth1", F.sum("change1").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*_KEYS, "ended", "odd", "quotes", "change0", "change1", "depth0", "depth1")
    )
    # One row per block: the order of the blocks is the order of the text.
    earlier = Window.partitionBy(F.lit(0)).orderBy(*_BLOCK).rowsBetween(*_BEFORE)
    blocks = (
        placed.groupBy(*_BLOCK)
        .agg(F.sum("odd").alias("odd"), F.sum("change0").alias("change0"), F.sum("change1").alias("change1"))
        .withColumn("start", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
        .withColumn("change", F.when(F.col("start") == 0, F.col("change0")).otherwise(F.col("change1")))
        .select(*_BLOCK, "start", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("base"))
    )
    depth = F.col("base") + F.when(F.col("start") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    outside = (F.col("start") + F.col("quotes") + F.col("odd")) % 2 == 0
    end = F.col("ended") & outside & (depth <= 1)
    return placed.join(blocks, _BLOCK).select(*_KEYS, depth.alias("depth"), end.cast("long").alias("end"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """``value``: one small JSON object per entry of the object in ``path``.

    The files of a folder are one text in the order of their names: parts of one
    document (cut anywhere but inside an escape), or documents one after the other. Only the text of one entry meets in a
    task. Members that are no objects come with the entry behind them. Text that is cut off in a string
    gives no entry; compressed files are read by one task each.
    """
    pieces = cut_lineage(_pieces(spark, path))
    ends = running_total(_with_ends(_effects(pieces)), [], _KEYS, "end", "entry")
    brace = F.when(F.col("ended"), F.lit("}")).otherwise(F.lit(""))
    part = F.struct(*_KEYS, F.concat("value", brace).alias("text"))
    entries = (
        pieces.join(ends, _KEYS)
        .groupBy("entry")
        .agg(
            F.array_sort(F.collect_list(part)).alias("parts"),
            F.max("end").alias("whole"),
            F.min(F.when(F.col("end") == 1, F.col("depth"))).alias("depth"),
        )
        .where("whole = 1")
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    text = F.regexp_replace(text, r"^[\s,{}]++", "")
    # Behind the last member the brace of the document itself ends the piece.
    closed = F.when(F.col("depth") < 1, F.regexp_replace(text, r"\}\z", "")).otherwise(text)
    return entries.select(closed.alias("text")).where("text != ''").select(
        F.concat(F.lit("{"), F.col("text"), F.lit("}")).alias("value")
    )
