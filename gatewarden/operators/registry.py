"""The registry of processed repositories: upsert, look-ups and roll-out batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("full_name", "processed_at", "success", "message")


def latest(log: DataFrame) -> DataFrame:
    """The last outcome of each repository. Combined before the shuffle, any size of key."""
    return (
        log.groupBy("full_name")
        .agg(F.max(F.struct("processed_at", "success", "message")).alias("last"))
        .select("full_name", "last.*")
    )


def upsert(registry: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Registry after ``outcomes``: the last write of a key wins."""
    return latest(registry.select(*FIELDS).unionByName(outcomes.select(*FIELDS)))


def pending(repos: DataFrame, registry: DataFrame) -> DataFrame:
    """Repositories without any outcome; a failed one counts as processed too."""
    return repos.join(registry.select("full_name").distinct(), "full_name", "left_anti")


def skipped(repos: DataFrame, registry: DataFrame) -> DataFrame:
    """Repositories that were processed, with their last outcome."""
    return repos.join(latest(registry), "full_name")


def stats(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count(F.lit(1)).alias("registered"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def strict_names(repos: DataFrame) -> DataFrame:
    """Names of exactly two parts."""
    return repos.where(F.size(F.split("full_name", "/", -1)) == 2)


def first_pending(repos: DataFrame, registry: DataFrame) -> DataFrame:
    """The rows a roll-out would take up: valid, not processed, first of their name."""
    firsts = strict_names(repos).groupBy("full_name").agg(F.min("repo_ord").alias("repo_ord"))
    return pending(firsts, registry)


def batch(repos: DataFrame, registry: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` pending repositories; processed ones use up no quota."""
    return first_pending(repos, registry).orderBy("repo_ord").limit(limit)


def counters(repos: DataFrame, registry: DataFrame, limit: int) -> DataFrame:
    """``processed, skipped, total`` of a roll-out that stops at ``limit``.

    The run ends at the pending repository after the last one taken up; rows
    behind it are neither processed nor skipped.
    """
    ahead = first_pending(repos, registry).orderBy("repo_ord").limit(limit + 1)
    ahead = ahead.agg(
        F.least(F.count(F.lit(1)), F.lit(limit)).alias("processed"),
        F.when(F.count(F.lit(1)) > limit, F.max("repo_ord")).alias("stop"),
    )
    # Scalar subqueries: nothing runs while the plan is built.
    taken = ahead.select(F.struct("processed", "stop")).scalar()
    known = registry.agg(F.count_distinct("full_name")).scalar()
    seen = strict_names(repos).where(taken["stop"].isNull() | (F.col("repo_ord") < taken["stop"]))
    return seen.agg(F.count(F.lit(1)).alias("seen")).select(
        taken["processed"].cast("long").alias("processed"),
        (F.col("seen") - taken["processed"]).alias("skipped"),
        (known + taken["processed"]).cast("long").alias("total"),
    )


def forks(meta: DataFrame) -> DataFrame:
    """Forks only, last updated first; number them with ``number_rows``."""
    return meta.where("is_fork").select("full_name", "created_at", "updated_at")
