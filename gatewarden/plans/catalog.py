"""The registered queries: each one runs an operator over whole derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden import corpus
from gatewarden.functions.header import FIELDS, HEADER, with_fields
from gatewarden.functions.sql import keep_where
from gatewarden.functions.text import path_extension
from gatewarden.operators import collect, languages, registry, render, report, sarif
from gatewarden.operators.ranking import number_rows
from gatewarden.operators.rules import LOW, CatalogEntry, LineRule
from gatewarden.operators.scan import scan, with_catalog, workflow_lines
from gatewarden.plans.audit import analyze_flow, rollout_flow, scan_listed
from gatewarden.session import cut_lineage, shared_folder
from gatewarden.sources import contents as content_source
from gatewarden.sources import registry_files
from gatewarden.sources.registry_store import RegistryStore
from gatewarden.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_TIME = "2025-01-01 00:00:00"
RUN_START, RUN_END = "2024-12-31T23:00:00Z", "2025-01-01T00:00:00Z"
# Top-k parameters of the flows.
COLLECTED, ANALYZED, ROLLED_OUT = 100, 50, 40
# Buckets of a store of contents and of one of outcomes.
CONTENT_BUCKETS, REGISTRY_BUCKETS = 32, 8
# Parts of each table that arrive one at a time.
ARRIVALS = 3
# Registry rows before this time are the old state, the others arrive later.
REGISTRY_CUT = "2024-01-16 00:00:00"


def query(function: Query) -> Query:
    """Register under the name of the function; a final underscore is not part of it."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.workflow_files(spark, sf_dir)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_files(spark, sf_dir))


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.parse_manifest(corpus.manifest_lines(spark, sf_dir))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest(corpus.registry_log(spark, sf_dir))


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


# Sources.


@query
def manifest_parse(spark, sf_dir):
    return _repos(spark, sf_dir).select(
        "repo_ord", "owner", "name", "full_name",
        F.array_join("workflows", "|").alias("workflows"),
        F.size("workflows").cast("long").alias("n_workflows"),
    )


@query
def manifest_explode(spark, sf_dir):
    return collect.manifest_paths(_repos(spark, sf_dir))


@query
def workflow_load_base64(spark, sf_dir):
    return content_source.decode_contents(corpus.workflow_files_base64(spark, sf_dir))


@query
def workflow_lines_(spark, sf_dir):
    return workflow_lines(_files(spark, sf_dir))


@query
def workflow_file_filter(spark, sf_dir):
    return collect.workflow_items(corpus.listings(spark, sf_dir)).select("full_name", "item_ord", "path")


@query
def registry_load(spark, sf_dir):
    texts = registry_files.export_lines(corpus.registry_log(spark, sf_dir))
    return registry_files.parse_registry(texts).select(
        "full_name", _time("processed_at"), "success", "message"
    )


@query
def tree_prune(spark, sf_dir):
    return languages.pruned_tree(corpus.repo_tree(spark, sf_dir))


@query
def path_extension_(spark, sf_dir):
    tree = corpus.repo_tree(spark, sf_dir)
    return tree.select("full_name", "path", path_extension(F.col("path")).alias("ext"))


# Document structure.


def _headers(spark, sf_dir):
    return with_fields(_files(spark, sf_dir)).select(
        "full_name", "path", F.length("content").alias("size"), *[F.col(HEADER + f).alias(f) for f in FIELDS]
    )


@query
def workflow_header(spark, sf_dir):
    headers = _headers(spark, sf_dir).select(
        "full_name", "path", "parse_ok", "permissions_form", "contents"
    )
    return keep_where(headers, "parse_ok", "permissions_form", "contents").drop("parse_ok")


@query
def workflow_triggers(spark, sf_dir):
    events = F.explode_outer(F.when(F.col("parse_ok"), F.col("triggers"))).alias("event")
    return _headers(spark, sf_dir).select("full_name", "path", events).where("event is not null")


@query
def workflow_parse_ok(spark, sf_dir):
    headers = _headers(spark, sf_dir).select("full_name", "path", "size", "parse_ok")
    return keep_where(headers, "size > 0", "parse_ok").drop("size")


# Rules.


def _rule(name: str, rule_id: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan(_files(spark, sf_dir), [rule_id]).select(
            "full_name", "path", "severity", "line", "details"
        )

    QUERIES[name] = run


for _name, _id in {
    "rule_command_injection": "R01",
    "rule_action_unversioned": "R02",
    "rule_action_branch": "R03",
    "rule_secret_print": "R04",
    "rule_secret_env": "R05",
    "rule_perm_write": "R06",
    "rule_perm_admin": "R07",
    "rule_perm_undefined": "R08",
    "rule_token_context": "R09",
    "rule_prt_ref": "R10",
    "rule_prt_exec": "R11",
    "rule_script_injection": "R12",
}.items():
    _rule(_name, _id)


@query
def scan_all(spark, sf_dir):
    return _findings(spark, sf_dir)


@query
def scan_limited(spark, sf_dir):
    return scan_listed(_repos(spark, sf_dir), _files(spark, sf_dir), ANALYZED)


@query
def scan_stored(spark, sf_dir):
    """All listed repositories, from contents that were written in buckets by file."""
    folder, table = shared_folder(spark, "contents"), f"contents_{uuid.uuid4().hex}"
    store = content_source.write_store(_files(spark, sf_dir), folder, table, CONTENT_BUCKETS)
    return scan_listed(_repos(spark, sf_dir), store, limit=None, stored=True)


@query
def scan_incremental(spark, sf_dir):
    """The files arrive in several micro-batches; all findings are those of one scan."""
    folder, arrivals = shared_folder(spark, "incremental"), shared_folder(spark, "arrivals")
    tables = {name: corpus.table(spark, sf_dir, name) for name in ("orders", "documents")}
    # Each arrival is as many files of a table as tasks can share its work.
    files = max(corpus.tasks_for(-(-rows.count() // ARRIVALS)) for rows in tables.values())
    for name, rows in tables.items():
        rows.repartition(ARRIVALS * files).write.parquet(f"{arrivals}/{name}.parquet")
    incremental.scan_arrivals(corpus.workflow_files(spark, arrivals, stream=True, files=files), folder)
    return incremental.read_findings(spark, folder)


@query
def findings_enriched(spark, sf_dir):
    return with_catalog(_findings(spark, sf_dir)).select(
        "full_name", "path", "rule_id", "type", "severity", "line",
        "description", "impact", "exploit", "mitigation", F.array_join("refs", "; ").alias("refs"),
    )


# An own rule as a user would add it: a step that opens a multi-line script.
OWN_RULE = LineRule(
    CatalogEntry(
        "X01", 101, 7, "Multi-Line Script", LOW, "Step runs a multi-line script",
        "Long scripts in workflows are hard to review.", "Hide a command among many.",
        "Move the script into a file of the repository.", ("own rule book",),
    ),
    pattern=r"(?d)run: \|[ \t\r]*$",
    needles=("run: |",),
)


@query
def scan_own_rules(spark, sf_dir):
    """Results, rules and report sections when an own rule is added; they share one scan."""
    own = (OWN_RULE,)
    found = cut_lineage(scan(_files(spark, sf_dir), extra_rules=own))
    blank = F.lit("").alias
    results = sarif.results(found, own).where("rule_id = 'Multi-LineScript'").select(
        F.lit("result").alias("part"), F.col("full_name").alias("at"), F.col("uri").alias("name"),
        F.concat_ws("|", "rule_id", "level", "start_line", "message").alias("text"))
    rules_ = sarif.rules(found, own).select(
        F.lit("rule").alias("part"), blank("at"), F.col("id").alias("name"),
        F.concat_ws("|", "short_description", "full_description", "help", "security_severity").alias("text"))
    heads = with_catalog(report.first_of_type(found), own).select(
        F.lit("section").alias("part"), blank("at"), F.col("type").alias("name"),
        F.concat_ws("|", "findings", "severity", "description", "exploit", F.array_join("refs", "; ")).alias("text"))
    return results.unionByName(rules_).unionByName(heads)


@query
def analyze_written(spark, sf_dir):
    """What the scan of all listed repositories writes as SARIF, in compressed files, read back."""
    folder = shared_folder(spark, "sarif")
    repos, files = _repos(spark, sf_dir), _files(spark, sf_dir)
    analyze_flow(repos, files, folder, RUN_TIME, RUN_START, RUN_END, "sarif", limit=None, compression="gzip")
    place = "struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>"
    result = f"struct<ruleId:string,level:string,locations:array<struct<physicalLocation:{place}>>>"
    run = f"struct<automationDetails:struct<id:string>,results:array<{result}>>"
    runs = spark.read.text(folder).select(F.explode(F.from_json("value", f"runs array<{run}>")["runs"]).alias("run"))
    found = runs.select(F.col("run.automationDetails.id").alias("full_name"), F.explode("run.results").alias("r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    return found.select(
        "full_name", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"),
        at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"))


# Roll-ups and reports.


@query
def summary_total(spark, sf_dir):
    return report.total(_findings(spark, sf_dir))


@query
def summary_severity(spark, sf_dir):
    return report.by_severity(_findings(spark, sf_dir)).select("severity", "findings")


@query
def summary_severity_bar(spark, sf_dir):
    return report.severity_bars(_findings(spark, sf_dir)).select("severity", "findings", "bar")


@query
def summary_type(spark, sf_dir):
    return report.by_type(_findings(spark, sf_dir))


@query
def findings_per_repo(spark, sf_dir):
    return report.per_repo(_findings(spark, sf_dir), _files(spark, sf_dir).select("full_name"))


@query
def report_occurrences(spark, sf_dir):
    return report.occurrences(_findings(spark, sf_dir)).select(
        "type", "occurrence", "full_name", "path", "rule_id", "line", "details"
    )


@query
def report_representative(spark, sf_dir):
    return report.first_of_type(_findings(spark, sf_dir))


@query
def report_sections(spark, sf_dir):
    return report.report(_findings(spark, sf_dir), RUN_TIME)


@query
def sarif_rules(spark, sf_dir):
    return sarif.rules(_findings(spark, sf_dir))


@query
def sarif_results(spark, sf_dir):
    return sarif.results(_findings(spark, sf_dir))


@query
def sarif_document(spark, sf_dir):
    return sarif.documents(_findings(spark, sf_dir), RUN_START, RUN_END)


# Collecting.


@query
def collect_repos(spark, sf_dir):
    found = collect.collect_repos(
        corpus.repo_meta(spark, sf_dir), corpus.listings(spark, sf_dir), COLLECTED
    )
    return found.select("full_name", _time("indexed_at"), "item_ord", "path")


@query
def manifest_format(spark, sf_dir):
    return collect.format_manifest(collect.workflow_items(corpus.listings(spark, sf_dir)))


@query
def fork_listing(spark, sf_dir):
    forks = registry.forks(corpus.repo_meta(spark, sf_dir))
    return number_rows(forks, [], ["updated_at", "full_name"], "number", ["updated_at"]).select(
        "number", "full_name", _time("created_at")
    )


@query
def repo_name_strict(spark, sf_dir):
    return registry.strict_names(_repos(spark, sf_dir)).select("repo_ord", "full_name")


# Registry.


@query
def registry_upsert(spark, sf_dir):
    log = corpus.registry_log(spark, sf_dir)
    cut = F.lit(REGISTRY_CUT).cast("timestamp")
    old = registry.latest(log.where(F.col("processed_at") < cut))
    return registry.upsert(old, log.where(F.col("processed_at") >= cut)).select(
        "full_name", _time("processed_at"), "success", "message"
    )


@query
def registry_one_line(spark, sf_dir):
    """The registry written as one long line of JSON, cut by matching brackets and read back."""
    folder = shared_folder(spark, "registry")
    registry_files.export_lines(_registry(spark, sf_dir)).select("value").write.option("lineSep", " ").text(folder)
    return registry_files.read_registry(spark, folder).select("full_name", _time("processed_at"), "success", "message")


@query
def registry_store(spark, sf_dir):
    """All outcomes, applied as batches by time; one comes twice and runs are merged on the way."""
    log = corpus.registry_log(spark, sf_dir)
    cut = F.lit(REGISTRY_CUT).cast("timestamp")
    store = RegistryStore(spark, shared_folder(spark, "registry"), REGISTRY_BUCKETS)
    late = F.col("processed_at") >= cut
    for batch_id, part in ((0, late), (1, ~late), (0, late)):
        store.apply(log.where(part), "log", batch_id, max_runs=2)
    return store.read().select("full_name", _time("processed_at"), "success", "message")


@query
def registry_export(spark, sf_dir):
    return registry_files.export_lines(_registry(spark, sf_dir))


@query
def registry_pending(spark, sf_dir):
    repos = _repos(spark, sf_dir).select("repo_ord", "full_name")
    return registry.pending(repos, corpus.registry_log(spark, sf_dir))


@query
def registry_skipped(spark, sf_dir):
    repos = _repos(spark, sf_dir).select("repo_ord", "full_name")
    return registry.skipped(repos, corpus.registry_log(spark, sf_dir)).select(
        "repo_ord", "full_name", _time("processed_at"), "success"
    )


@query
def registry_stats(spark, sf_dir):
    return registry.stats(_registry(spark, sf_dir))


@query
def rollout_batch(spark, sf_dir):
    return registry.batch(_repos(spark, sf_dir), _registry(spark, sf_dir), ROLLED_OUT)


@query
def run_counters(spark, sf_dir):
    return registry.counters(_repos(spark, sf_dir), _registry(spark, sf_dir), ROLLED_OUT)


# Languages and configurations.


@query
def language_counts(spark, sf_dir):
    return languages.language_counts(corpus.repo_tree(spark, sf_dir))


@query
def language_detect(spark, sf_dir):
    return languages.detect_languages(corpus.repo_tree(spark, sf_dir))


@query
def language_ecosystem(spark, sf_dir):
    scanner = languages.scanner_language(F.col("language"))
    return corpus.repo_meta(spark, sf_dir).select(
        "full_name", scanner.alias("scanner_language"),
        languages.ecosystem(F.col("language")).alias("ecosystem"),
    )


@query
def scan_config_render(spark, sf_dir):
    detected = languages.detect_languages(corpus.repo_tree(spark, sf_dir))
    return render.render(render.repo_languages(corpus.repo_meta(spark, sf_dir), detected))


# The roll-out.


def _rollout(spark, sf_dir):
    return rollout_flow(
        _repos(spark, sf_dir), _registry(spark, sf_dir), corpus.repo_meta(spark, sf_dir),
        corpus.repo_tree(spark, sf_dir), RUN_TIME, ROLLED_OUT, ("gitleaks", "container-scan"),
    )


@query
def rollout_configs(spark, sf_dir):
    """Configurations of the batch with the position of each repository."""
    done = _rollout(spark, sf_dir)
    return done.batch.join(done.configurations, "full_name").select(
        "position", "total", "full_name", "tool", "path", "content"
    )


@query
def rollout_registry(spark, sf_dir):
    return _rollout(spark, sf_dir).registry.select(
        "full_name", _time("processed_at"), "success", "message"
    )
