"""The registry as a log of small runs in keyed buckets, with versions that replace each other whole.

``runs/<run>/bucket=<b>`` holds outcomes, one row per repository; ``versions/<n>.json`` names the runs
of each bucket. A batch writes its run beside the others and then one new version file, so readers
see all of it or nothing. What a lost driver leaves behind is named by no version
and is written over by the next attempt. One writer at a time, as a stream has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.operators.registry import FIELDS, latest

SCHEMA = "full_name string, processed_at timestamp, success boolean, message string"
DEFAULT_BUCKETS = 64
#: Runs of a bucket that a read has to merge at most, before ``compact`` puts them together.
DEFAULT_RUNS = 8


class RegistryStore:
    """Last outcomes of repositories in ``folder``, which all executors share.

    ``buckets`` counts only when the store is new; choose it so that a bucket, which one
    task compacts, stays below some 100 MB. Names that are null are kept in bucket 0.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = DEFAULT_BUCKETS) -> None:
        self._spark, self._folder, self._new_buckets = spark, folder.rstrip("/"), buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Version files.

    def _path(self, below: str):
        return self._hadoop.Path(f"{self._folder}/{below}" if below else self._folder)

    def _names(self, below: str) -> list[str]:
        path = self._path(below)
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and n[0] != ".")

    def state(self, version: int | None = None) -> dict:
        """``buckets``, ``runs`` (bucket to names of runs) and ``applied`` (source to last batch)."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": self._new_buckets, "runs": {}, "applied": {}}
        version = known[-1] if version is None else version
        source = self._files.open(self._path(f"versions/{version:012}.json"))
        try:
            return json.loads(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _commit(self, state: dict) -> None:
        target = self._path(f"versions/{state['version']:012}.json")
        draft = self._path(f"versions/.{uuid.uuid4()}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if self._files.exists(target) or not self._files.rename(draft, target):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {state['version']} was written by someone else")

    # Rows.

    @staticmethod
    def _bucket(buckets: int) -> Column:
        hashed = F.pmod(F.xxhash64("full_name"), F.lit(buckets))
        return F.when(F.col("full_name").isNull(), F.lit(0)).otherwise(hashed).cast("int")

    def _write_run(self, rows: DataFrame, run: str, buckets: int) -> list[str]:
        """Write a run and name its buckets; written again, it replaces what is there."""
        keyed = rows.select(*FIELDS).withColumn("bucket", self._bucket(buckets))
        where = f"{self._folder}/runs/{run}"
        keyed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(where)
        return [n.split("=")[1] for n in self._names(f"runs/{run}") if n.startswith("bucket=")]

    def _rows(self, state: dict, buckets: Iterable[str]) -> DataFrame:
        """All rows of some buckets, not merged. There are at most buckets times runs folders."""
        paths = [f"{self._folder}/runs/{run}/bucket={b}" for b in sorted(buckets, key=int) for run in state["runs"].get(b, [])]
        if not paths:
            return self._spark.createDataFrame([], SCHEMA)
        return self._spark.read.schema(SCHEMA).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The last outcome of every repository."""
        state = self.state(version)
        return latest(self._rows(state, state["runs"]))

    def touched(self, names: DataFrame) -> list[str]:
        """The buckets that hold ``names``; as many values as there are buckets, at most."""
        buckets = self.state()["buckets"]
        return [str(r.bucket) for r in names.select(self._bucket(buckets).alias("bucket")).distinct().collect()]

    def lookup(self, names: DataFrame) -> DataFrame:
        """The last outcomes of ``names`` (``full_name``); reads only the buckets they are in."""
        rows = self._rows(self.state(), self.touched(names))
        return latest(rows.join(names.select("full_name").distinct(), "full_name", "left_semi"))

    def pending(self, repos: DataFrame) -> DataFrame:
        """Repositories of a batch without any outcome; reads only the buckets they are in."""
        known = self._rows(self.state(), self.touched(repos))
        return repos.join(known.select("full_name").distinct(), "full_name", "left_anti")

    def apply(self, outcomes: DataFrame, source: str, batch_id: int, max_runs: int = DEFAULT_RUNS) -> bool:
        """Add the outcomes of a batch; false if this or a later batch of ``source`` is in already.

        Nothing is read but the batch. Buckets that reach ``max_runs`` runs are compacted afterwards.
        """
        state = self.state()
        if batch_id <= state["applied"].get(source, -1):
            return False
        run = f"{source}-{batch_id:012}"
        runs = dict(state["runs"])
        for bucket in self._write_run(latest(outcomes), run, state["buckets"]):
            runs[bucket] = [*runs.get(bucket, []), run]
        applied = {**state["applied"], source: batch_id}
        self._commit({**state, "version": state["version"] + 1, "runs": runs, "applied": applied})
        if any(len(r) >= max_runs for r in runs.values()):
            self.compact(max_runs)
        return True

    def compact(self, max_runs: int = 2) -> None:
        """Merge the runs of each bucket that has ``max_runs`` or more; other buckets stay as they are."""
        state = self.state()
        long = [b for b, runs in state["runs"].items() if len(runs) >= max(max_runs, 2)]
        if not long:
            return
        run = f"merged-{state['version'] + 1:012}"
        self._write_run(latest(self._rows(state, long)), run, state["buckets"])
        self._commit({**state, "version": state["version"] + 1, "runs": {**state["runs"], **{b: [run] for b in long}}})

    def vacuum(self, keep: int = 10) -> None:
        """Remove versions but the last ``keep``, and buckets of runs that none of those name."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        named = {(run, b) for v in kept for b, runs in self.state(v)["runs"].items() for run in runs}
        for version in old:
            self._files.delete(self._path(f"versions/{version:012}.json"), False)
        for run in self._names("runs"):
            held = {n.split("=")[1] for n in self._names(f"runs/{run}") if n.startswith("bucket=")}
            used = {b for b in held if (run, b) in named}
            for bucket in held - used:
                self._files.delete(self._path(f"runs/{run}/bucket={bucket}"), True)
            if not used:
                self._files.delete(self._path(f"runs/{run}"), True)
