"""Findings in the SARIF 2.1.0 exchange format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewarden.operators.ranking import number_in_units, running_total
from gatewarden.operators.report import first_of_type
from gatewarden.operators.rules import (
    LEVEL, OTHER_LEVEL, OTHER_SCORE, SCORE, LineRule, catalog_map,
)
from gatewarden.operators.scan import FINDING_ORDER, with_catalog
from gatewarden.session import cut_lineage, temporary_tables

# Fixed values of the format.
SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"
VERSION = "2.1.0"
TAGS = ("security", "github-actions", "ci-cd")
TOOL_NAME, TOOL_VERSION = "gatewarden", "1.0.0"
RESULTS_PER_DOCUMENT = 1_000


def _lookup(severity: Column, values: dict[str, str], other: str) -> Column:
    column = F.lit(other)
    for key, value in values.items():
        column = F.when(severity == key, F.lit(value)).otherwise(column)
    return column


def rule_name(type_: Column) -> Column:
    return F.replace(type_, F.lit(" "), F.lit(""))


def _message(description: Column, details: Column) -> Column:
    return F.concat(description, F.lit(" - "), F.substring_index(details, "\n", 1))


def rules(findings: DataFrame, extra_rules: tuple[LineRule, ...] = ()) -> DataFrame:
    """One row per type with the texts and score of its first finding."""
    return with_catalog(first_of_type(findings), extra_rules).select(
        rule_name(F.col("type")).alias("id"),
        F.col("type").alias("name"),
        F.col("description").alias("short_description"),
        F.col("impact").alias("full_description"),
        F.col("mitigation").alias("help"),
        _lookup(F.col("severity"), SCORE, OTHER_SCORE).alias("security_severity"),
        F.lit(",".join(TAGS)).alias("tags"),
    )


def results(findings: DataFrame, extra_rules: tuple[LineRule, ...] = ()) -> DataFrame:
    """One row per finding."""
    return with_catalog(findings, extra_rules).select(
        "full_name",
        rule_name(F.col("type")).alias("rule_id"),
        _lookup(F.col("severity"), LEVEL, OTHER_LEVEL).alias("level"),
        _message(F.col("description"), F.col("details")).alias("message"),
        F.col("path").alias("uri"),
        F.col("line").alias("start_line"),
        F.col("details").alias("snippet"),
    )


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _list(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _object(**members: Column) -> Column:
    """The text of an object from the texts of its members, in this order."""
    parts = [F.concat(F.lit(f'"{name}":'), text) for name, text in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _string(value: Column) -> Column:
    """The text of a string, without the brackets of a list of it."""
    text = _json(F.array(value))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def _document(
    rule_list: Column, result_list: Column, start: str, end: str,
    repository: Column | None = None, information_uri: str | None = None,
) -> Column:
    """A document from the texts of its rules and results: what a text holds is written once, where it is made."""
    more = {} if information_uri is None else {"informationUri": _string(F.lit(information_uri))}
    driver = _object(
        name=_string(F.lit(TOOL_NAME)), version=_string(F.lit(TOOL_VERSION)), **more, rules=rule_list
    )
    invocation = F.struct(
        F.lit(True).alias("executionSuccessful"),
        F.lit(start).alias("startTimeUtc"),
        F.lit(end).alias("endTimeUtc"),
    )
    # Paths are inside a repository; the run names it.
    details = {} if repository is None else {"automationDetails": _json(F.struct(repository.alias("id")))}
    run = _object(
        tool=_object(driver=driver), **details, results=result_list, invocations=_json(F.array(invocation))
    )
    members = {"$schema": _string(F.lit(SCHEMA_URI)), "version": _string(F.lit(VERSION)), "runs": _list(F.array(run))}
    return _object(**members)


def documents(
    findings: DataFrame, start: str, end: str, per_document: int = RESULTS_PER_DOCUMENT,
    extra_rules: tuple[LineRule, ...] = (), information_uri: str | None = None, written: bool = False,
) -> DataFrame:
    """``full_name, shard, results, document``: JSON texts of bounded size.

    The results of a repository are numbered and cut into documents of at most
    ``per_document`` results, so no row holds a repository as a whole. Every document
    names its repository, and a rule has the texts of its first finding of the run in
    all of them: how the results are cut changes nothing else. The findings are written
    once, unless the caller has done so (``written``), and move once: those of a
    repository are numbered and put together in one task, and a repository with more
    than ``ranking.UNIT_ROWS`` findings is spread over ranges. The text of a result is
    made from its row, in generated code, and that of a rule once for the run.
    """
    findings = findings if written else cut_lineage(findings)
    catalog = F.expr(catalog_map(extra_rules))

    def text(value: Column) -> Column:
        return F.struct(value.alias("text"))

    def rule() -> Column:
        # A rule without texts is an error of its results.
        texts = F.try_element_at(catalog, F.col("rule_id"))
        return F.struct(
            rule_name(F.col("type")).alias("id"),
            F.col("type").alias("name"),
            text(texts["description"]).alias("shortDescription"),
            text(texts["impact"]).alias("fullDescription"),
            text(texts["mitigation"]).alias("help"),
            F.struct(
                _lookup(F.col("severity"), SCORE, OTHER_SCORE).alias("security-severity"),
                F.array(*[F.lit(t) for t in TAGS]).alias("tags"),
            ).alias("properties"),
        )

    def result() -> Column:
        unknown = F.raise_error(F.concat(F.lit("no texts for rule "), F.col("rule_id")))
        description = F.coalesce(F.try_element_at(catalog, F.col("rule_id"))["description"], unknown)
        region = F.struct(F.col("line").alias("startLine"), text(F.col("details")).alias("snippet"))
        location = F.struct(
            F.struct(
                F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")
            ).alias("physicalLocation")
        )
        return F.struct(
            rule_name(F.col("type")).alias("ruleId"),
            _lookup(F.col("severity"), LEVEL, OTHER_LEVEL).alias("level"),
            text(_message(description, F.col("details"))).alias("message"),
            F.array(location).alias("locations"),
        )

    # One row per type of the catalogue.
    firsts = first_of_type(findings, written=True).select("type", _json(rule()).alias("text")).collect()
    rule_texts = F.create_map(*[F.lit(x) for r in firsts for x in r]) if firsts else F.create_map(F.lit(""), F.lit(""))
    numbered = number_in_units(findings, ["full_name"], ["full_name"], FINDING_ORDER, "number", written=True)
    # Texts are made after the shuffle.
    entry = F.struct("number", "type", _json(result()).alias("text"))
    gathered = (
        numbered.select("full_name", F.expr(f"(number - 1) div {per_document}").alias("shard"), entry.alias("entry"))
        .groupBy("full_name", "shard")
        .agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    )
    entries = F.col("entries")
    used = F.transform(F.array_distinct(entries["type"]), lambda t: F.try_element_at(rule_texts, t))
    return gathered.select(
        "full_name",
        F.col("shard").cast("long").alias("shard"),
        F.size(entries).cast("long").alias("results"),
        _document(_list(used), _list(entries["text"]), start, end, F.col("full_name"), information_uri).alias("document"),
    )


def empty_document(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The document of a run without findings: rules and results are null."""
    null = F.lit("null")
    return spark.range(1).select(_document(null, null, start, end).alias("document"))


FILE_BYTES = 128 << 20
INDEX = "_index"
#: Documents in the order in which they are laid end to end.
ORDER = ("full_name", "shard", "id")


def write_sarif(
    findings: DataFrame, start: str, end: str, path: str,
    extra_rules: tuple[LineRule, ...] = (), information_uri: str | None = None,
    file_bytes: int = FILE_BYTES, compression: str | None = None,
) -> None:
    """One JSON text per line, in files of bounded size; the findings are computed once.

    Documents are laid end to end by repository and shard and cut into files where
    ``file_bytes`` are full, so a file holds less than that and one document more, and the
    number of files follows from the bytes alone. File ``k`` is the folder ``file=k``.
    ``read_index`` gives the place of every document. The index is written last: where it
    is, the output is complete. A repeated run gives the same files and replaces the old.

    Documents repeat most of their text: with a ``compression`` such as gzip they take a
    thirtieth of the disk. Sizes and places are those of the text then. The documents are
    kept once meanwhile, compressed, and move once: the starts of the files, one for each
    ``file_bytes``, tell the file of a document.
    """
    spark = findings.sparkSession
    with temporary_tables(spark):
        findings = cut_lineage(findings)
        if findings.isEmpty():
            nobody = F.lit(None).cast("string").alias("full_name")
            found = empty_document(spark, start, end).select(nobody, F.lit(0).cast("long").alias("shard"), "document")
        else:
            found = documents(
                findings, start, end, extra_rules=extra_rules, information_uri=information_uri, written=True
            )
        found = cut_lineage(
            found.select("full_name", "shard", "document", F.monotonically_increasing_id().alias("id")), "zstd"
        )
        # A line ends with one byte more.
        size = (F.octet_length("document") + 1).cast("long").alias("bytes")
        placed = running_total(found.select(*ORDER, size), [], ORDER, "bytes", "start")
        # The documents of a file are bounded by its bytes.
        first = F.min("start").over(Window.partitionBy("file"))
        index = cut_lineage(
            placed.withColumn("file", F.expr(f"start div {file_bytes}")).withColumn("offset", F.col("start") - first)
        )
        # One row: a join with all places would move the documents once more.
        starts = index.where("offset = 0").agg(
            F.sort_array(F.collect_list(F.struct(F.struct(*ORDER).alias("first"), "file"))).alias("starts")
        )
        (
            found.crossJoin(F.broadcast(starts))
            .select(*ORDER, "document", _last_not_after(F.col("starts"), F.struct(*ORDER))["file"].alias("file"))
            .repartition("file")
            .sortWithinPartitions("file", *ORDER)
            .select("file", "document")
            .write.mode("overwrite").partitionBy("file").text(path, compression=compression)
        )
        index.select("full_name", "shard", "file", "offset", "bytes").write.mode("overwrite").parquet(f"{path}/{INDEX}")


def _last_not_after(starts: Column, key: Column) -> Column:
    """The last of the sorted ``starts`` whose ``first`` is not after ``key``, by halving; the first one is not."""
    steps = F.sequence(F.ceil(F.log2(F.size(starts) + 1)).cast("int"), F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        further = at + F.pow(F.lit(2), k).cast("int")
        return F.when(F.get(starts, further)["first"] <= key, further).otherwise(at)

    return F.get(starts, F.aggregate(steps, F.lit(0), step))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``full_name, shard, file, offset, bytes`` of every document below ``path``."""
    return spark.read.parquet(f"{path}/{INDEX}")


def read_documents(spark: SparkSession, path: str, full_name: str) -> DataFrame:
    """The documents of one repository; only the files that hold them are read."""
    files = read_index(spark, path).where(F.col("full_name") == full_name).select("file").distinct()
    # The number of files is bounded by the bytes of one repository.
    lines = spark.read.schema("value string, file long").text(path).join(F.broadcast(files), "file")
    named = F.get_json_object("value", "$.runs[0].automationDetails.id") == full_name
    return lines.where(named).select(F.col("value").alias("document"))
