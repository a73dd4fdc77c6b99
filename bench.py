"""Time the headline queries and print one JSON line.

Settings come from the environment: BENCH_SF_DIR, BENCH_CPUS, and BENCH_QUERIES
(names separated by commas; default: the headline queries).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gatewarden.plans.catalog import QUERIES  # noqa: E402
from gatewarden.session import local_session  # noqa: E402

HEADLINE = (
    "scan_all", "summary_severity", "summary_type", "findings_per_repo", "report_occurrences",
    "sarif_results", "sarif_document", "workflow_header", "workflow_lines", "scan_limited",
    "registry_pending", "registry_upsert", "language_detect", "scan_config_render",
    "collect_repos", "manifest_format",
)


def spread(spark, sf_dir: str, cores: int) -> str:
    """A copy of the tables in one file per core: small tables are a single file here."""
    folder = f"{tempfile.mkdtemp(prefix='gatewarden-bench-')}/{os.path.basename(sf_dir.rstrip('/'))}"
    for name in ("orders", "documents", "lineitem", "customer", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(cores).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, 16, **{"spark.ui.showConsoleProgress": "false"})

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    sf_dir = spread(spark, sf_dir, int(cpus))
    cold = run("scan_all")
    seconds = {name: run(name) for name in names}
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    files += spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "scan_all_cold": cold,
        "files_scanned": files,
        "files_per_sec": round(files / seconds["scan_all"]) if seconds.get("scan_all") else None,
    }))


if __name__ == "__main__":
    main()
