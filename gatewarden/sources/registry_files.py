"""The registry as JSON: one flat object keyed by repository name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.operators.ranking import write_ordered_text
from gatewarden.sources.json_entries import read_entries

_ENTRY = "struct<full_name:string,processed_at:string,success:boolean,message:string>"
_SCHEMA = "full_name string, processed_at timestamp, success boolean, message string"
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def parse_registry(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows from JSON objects; every text may hold any number of entries."""
    entries = F.from_json(column, f"map<string,{_ENTRY}>")
    rows = texts.select(F.explode(entries).alias("key", "entry"))
    return rows.select(
        F.col("key").alias("full_name"),
        F.col("entry.processed_at").cast("timestamp").alias("processed_at"),
        F.col("entry.success").alias("success"),
        F.col("entry.message").alias("message"),
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry file or folder; a missing path gives an empty registry.

    A document is cut at the end of each entry, so a large file is parsed by many tasks:
    at the indented brace if the first entry ends with one, else (one line, another indent) by matching
    brackets (``json_entries``). Only the first entry is looked at to tell.
    """
    try:
        start = spark.read.option("lineSep", "}").text(path).where(F.col("value").contains('"')).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)
    if start is not None and not start.value.endswith("\n  "):
        return parse_registry(read_entries(spark, path))
    pieces = spark.read.option("lineSep", "\n  }").text(path)
    whole = F.rtrim(F.col("value")).endswith("}")
    body = F.regexp_replace("value", r"^[\s{,]+", "")
    piece = F.when(whole, F.col("value")).otherwise(F.concat(F.lit("{"), body, F.lit("}}")))
    cut = pieces.where(F.col("value").contains('"')).select(piece.alias("value"))
    return parse_registry(cut)


def entry_json(indented: bool = False) -> Column:
    """``"name": {...}`` of a registry row; a missing message is left out."""
    value = F.struct(
        F.col("full_name"),
        F.date_format("processed_at", _TIME).alias("processed_at"),
        F.col("success"),
        F.when(F.col("message") != "", F.col("message")).alias("message"),
    )
    name = F.regexp_extract(F.to_json(F.struct(F.col("full_name").alias("k"))), r'^\{"k":(.*)\}$', 1)
    if not indented:
        return F.concat(name, F.lit(":"), F.to_json(value))
    body = F.regexp_extract(F.to_json(value, {"pretty": "true"}), r"(?s)^\{\s*\n(.*)\n\}$", 1)
    body = F.regexp_replace(F.regexp_replace(body, " : ", ": "), "(?m)^ +", "    ")
    return F.concat(F.lit("  "), name, F.lit(": {\n"), body, F.lit("\n  }"))


def export_lines(registry: DataFrame) -> DataFrame:
    """``full_name, value``: one JSON object with one entry per row."""
    return registry.select(
        "full_name", F.concat(F.lit("{"), entry_json(), F.lit("}")).alias("value")
    )


def write_registry_document(registry: DataFrame, path: str) -> None:
    """Write one flat, indented JSON object over part files in name order.

    ``registry`` has one row per name, as ``latest`` and ``upsert`` give it.
    """
    last = registry.agg(F.max("full_name")).first()[0]
    comma = F.when(F.col("full_name") == last, F.lit("")).otherwise(F.lit(","))
    body = registry.select(
        F.lit(1).alias("part"), "full_name", F.concat(entry_json(indented=True), comma).alias("text")
    )
    ends = registry.sparkSession.createDataFrame(
        [(0, "", "{"), (2, "", "}")], "part int, full_name string, text string"
    )
    write_ordered_text(body.unionByName(ends), ["part", "full_name"], path)
