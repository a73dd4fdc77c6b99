"""Scanning files as they arrive.

The scan works on single rows, so the same function takes a streaming table. Each
micro-batch overwrites its own folder, and the registry takes its outcomes once, which makes a
repeated batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.operators.rules import LineRule
from gatewarden.operators.scan import scan
from gatewarden.sources.registry_store import RegistryStore


def scan_arrivals(files: DataFrame, folder: str, extra_rules: tuple[LineRule, ...] = ()) -> None:
    """Scan all files available now from the stream ``files``.

    Findings go to ``folder/findings`` and one outcome per repository and batch
    to the registry in ``folder/registry``. Calling it again with the same folder takes up only
    what has arrived since.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scan(batch, extra_rules=extra_rules).write.mode("overwrite").parquet(
            f"{folder}/findings/batch={batch_id}"
        )
        outcomes = batch.select("full_name").distinct().select(
            "full_name",
            F.current_timestamp().alias("processed_at"),
            F.lit(True).alias("success"),
            F.lit("scanned").alias("message"),
        )
        # The findings are there when the outcome says so.
        RegistryStore(batch.sparkSession, f"{folder}/registry").apply(outcomes, "scan", batch_id)

    query = (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_findings(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/findings").drop("batch")


def read_registry(spark, folder: str) -> DataFrame:
    """Last outcome of each repository over all batches."""
    return RegistryStore(spark, f"{folder}/registry").read()
