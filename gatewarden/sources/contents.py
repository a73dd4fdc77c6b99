"""Workflow file contents from tables or folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.functions.sql import keep_where
from gatewarden.functions.text import decode_base64


def read_workflow_folder(spark: SparkSession, root: str) -> DataFrame:
    """``full_name, path, content`` from ``root/owner/name/.github/workflows/*``."""
    files = spark.read.text(
        f"{root}/*/*/.github/workflows", wholetext=True, pathGlobFilter="*.y*ml"
    )
    where = r"([^/]+/[^/]+)/(\.github/workflows/[^/]+)$"
    location = F.url_decode(F.col("_metadata.file_path"))
    return files.select(
        F.regexp_extract(location, where, 1).alias("full_name"),
        F.regexp_extract(location, where, 2).alias("path"),
        F.col("value").alias("content"),
    ).where(F.col("path").rlike(r"\.ya?ml$"))


def decode_contents(files: DataFrame) -> DataFrame:
    """Replace ``content_b64`` by ``content``; drop files that fail or are empty."""
    kept = [c for c in files.columns if c != "content_b64"]
    decoded = files.select(*kept, decode_base64(F.col("content_b64")).alias("content"))
    return keep_where(decoded, "length(content) > 0", "content")


def files_of_repos(repo_paths: DataFrame, contents: DataFrame) -> DataFrame:
    """Attach contents to listed paths; listed twice means scanned twice.

    ``repo_paths``: ``repo_ord, full_name, wf_ord, path``. Paths without content
    are left out. Which side is moved is up to the optimizer.
    """
    return repo_paths.join(
        contents.select("full_name", "path", "content"), ["full_name", "path"]
    ).select("full_name", "repo_ord", "wf_ord", "path", "content")


#: A file is found by both, so the files of a hot repository are spread over all buckets.
STORE_KEYS = ("full_name", "path")


def write_store(files: DataFrame, folder: str, table: str, buckets: int) -> DataFrame:
    """Write ``full_name, path, content`` in buckets by file, sorted, as ``table`` in ``folder``.

    Lists of any length are joined to such a store without moving a content: only the
    listed paths go to the buckets. Sorted names let Parquet skip the row groups that a
    filter on ``full_name`` does not meet. Choose ``buckets`` so that one holds 0.5 to
    1 GB; each is one file. An earlier store of that name is replaced.
    """
    kept = files.select(*STORE_KEYS, "content")
    (
        kept.repartition(buckets, *STORE_KEYS)
        .write.mode("overwrite")
        .bucketBy(buckets, *STORE_KEYS)
        .sortBy(*STORE_KEYS)
        .option("path", folder)
        .saveAsTable(table)
    )
    return files.sparkSession.table(table)


def open_store(spark: SparkSession, folder: str, table: str, buckets: int) -> DataFrame:
    """The store in ``folder``, written with ``buckets`` by an earlier session."""
    keys = ", ".join(STORE_KEYS)
    quoted = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"""CREATE TABLE IF NOT EXISTS {table} (full_name STRING, path STRING, content STRING) USING parquet
        CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {int(buckets)} BUCKETS LOCATION '{quoted}'"""
    )
    return spark.table(table)


#: Bits for each path that marks a list, most bits of all marks, and bits of a page of marks.
PATH_BITS, MOST_BITS, PAGE_BITS = 8, 1 << 28, 1 << 15


def marked_contents(paths: DataFrame, contents: DataFrame, count: int) -> DataFrame:
    """The rows of ``contents`` whose file may be one of the ``count`` listed ones; no listed one is missed.

    For lists that are too long to be broadcast. Each path sets the bit that its hash names; the
    bits are broadcast (32 MB at most), so no content moves. Of the files that are not listed few
    pass, more if the list is so long that the bits get scarce.
    """
    bits = PAGE_BITS
    while bits < min(PATH_BITS * count, MOST_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64(*STORE_KEYS), F.lit(bits)).alias("_place")
    none = paths.sparkSession.range(bits // 64).selectExpr("id as word", "0L as bit")
    words = (
        paths.select(place)
        .selectExpr("_place div 64 as word", "shiftleft(1L, cast(_place % 64 as int)) as bit")
        .unionByName(none)
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    page = F.collect_list(F.struct("word", "bits"))
    pages = words.groupBy(F.expr(f"word div {PAGE_BITS // 64}").alias("_page")).agg(F.sort_array(page)["bits"].alias("_marks"))
    word = f"get(_marks, cast(_place div 64 % {PAGE_BITS // 64} as int))"
    return (
        contents.select("*", place)
        .join(F.broadcast(pages), F.expr(f"_place div {PAGE_BITS}") == F.col("_page"))
        .where(f"shiftrightunsigned({word}, cast(_place % 64 as int)) % 2 <> 0")
        .select(*contents.columns)
    )


def listed_contents(paths: DataFrame, contents: DataFrame, stored: bool = False) -> DataFrame:
    """The rows of ``contents`` that are listed in ``paths``, each once.

    With ``stored`` (``contents`` is a store) a task holds the listed paths of its bucket
    in a hash table and streams the contents past it; otherwise sides and sorts are up
    to the optimizer.
    """
    wanted = paths.select(*STORE_KEYS).distinct()
    if stored:
        wanted = wanted.hint("shuffle_hash")
    return contents.join(wanted, list(STORE_KEYS), "left_semi")
