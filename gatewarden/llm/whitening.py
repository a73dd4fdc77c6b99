"""Whitening of embeddings by spectral divide and conquer with QDWH polar decompositions.

Every entry c becomes the whole number x = floor(256 c). The fit list holds each distinct
vector x once. Its sums are exact; its covariance is summed from centred vectors, in
blocks of rows by many tasks whose partial matrices meet by matrix row. What reaches the
driver is d x d numbers, d the dimension, however many rows there are.

The spectrum is found there by divide and conquer. The polar factor U of A - s I, by the
dynamically weighted Halley iteration with QR factorisations, is +1 on the eigenvectors
above the shift s and -1 below, so (U + I) / 2 projects on an invariant subspace. Its range
and the orthogonal complement split A in two symmetric blocks, which are split in turn
until they are a number times the identity. The components, scaled by 1 / sqrt(e), go out with
each task, and rows are whitened where they lie.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are
dropped, and so are vectors of another length than most distinct ones have (the longer one
if two lengths are as frequent). Repeated rows are whitened each, but fitted once; equal
eigenvalues give some orthonormal components of their space; the entry of largest size in a
component is positive. A component without variance whitens to 0, and its place on the
diagonal does not count as an error. Entries beyond 64 bits are cut to them;
a ``deviation`` beyond them is null. An empty table gives an empty one. Further columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm.common import read
from gatewarden.session import cut_lineage

SCALE = 256
COMPONENTS = 4
#: Rows of a matrix product, and groups in which the partial sums of tasks meet first.
BLOCK_ROWS, FIRST_GROUPS = 4096, 64
EPS = float(np.finfo(float).eps)
LOW_BITS = 32


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by QR-based dynamically weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # a lower bound of the least singular value; too low a bound costs a step or two
    least = min(1.0, max(EPS, 0.9 / (np.sqrt(n) * np.linalg.norm(np.linalg.pinv(x), 2))))
    for _ in range(40):
        d = np.cbrt(4 * (1 - least**2) / least**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - least**2) / (least**2 * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        least = min(1.0, least * (wa + wb * least**2) / (1 + wc * least**2))
        step = np.linalg.norm(new - x)
        x = new
        if step < n * 4 * EPS or (abs(1 - least) < 8 * EPS and step < np.cbrt(EPS)):
            break
    return x


def spectrum(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    n = len(a)
    a = (a + a.T) / 2
    scale = np.linalg.norm(a) if scale is None else scale
    middle = np.trace(a) / max(n, 1)
    if n <= 1 or np.linalg.norm(a - middle * np.eye(n)) <= 2 * n * EPS * scale:
        return np.diag(a).copy(), np.eye(n)
    low, high = np.diag(a).min(), np.diag(a).max()  # the spectrum reaches both
    radius = np.linalg.norm(a - middle * np.eye(n))
    for shift in [np.median(np.diag(a)), middle, (low + high) / 2, *(middle + radius * t for t in np.linspace(-0.97, 0.97, 41))]:
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        # the range of the projector and its complement: two steps of subspace iteration from its largest columns
        order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
        q, _ = np.linalg.qr(projector[:, order[:rank]] if rank < n else projector)
        q, _ = np.linalg.qr(np.concatenate([projector @ q, np.eye(n)[:, order[::-1]]], axis=1))
        upper, lower = q[:, :rank], q[:, rank:n]
        if np.linalg.norm(upper.T @ a @ lower) > 32 * n * EPS * scale:  # a shift on an eigenvalue
            continue
        (e1, v1), (e2, v2) = (spectrum(v.T @ a @ v, scale) for v in (upper, lower))
        values, vectors = np.concatenate([e1, e2]), np.concatenate([upper @ v1, lower @ v2], axis=1)
        order = np.argsort(-values, kind="stable")
        return values[order], vectors[:, order]
    raise ArithmeticError("no shift splits the spectrum")


@dataclass
class Whitening:
    """Sums of the fit list, its components (columns, unit length) and their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def scaled(self) -> np.ndarray:
        """Components over the root of their eigenvalues; a component without variance is zero."""
        some = self.values > self.dim * 4 * EPS * max(self.trace, 0.0)
        return self.vectors / np.sqrt(np.where(some, self.values, 1.0)) * some

    def explained(self) -> np.ndarray:
        return np.where(self.trace > 0, self.values / (self.trace or 1.0), 0.0)


def whole_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """``rows`` with ``x``, without those whose vector takes no part."""
    c = F.col(vector).cast("array<double>")
    good = F.coalesce(F.size(c) > 0, F.lit(False)) & F.forall(
        c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(good).withColumn("x", F.transform(c, lambda v: F.floor(v * F.lit(float(SCALE))).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _summed(fit: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, np.ndarray]:
    """Sums over the fit list of the rows of a small matrix that ``part`` makes of a block.

    A task emits one partial matrix by rows; those of all tasks meet by row, first in a
    bounded number of groups, each in the order of the tasks.
    """
    schema = f"row int, bucket int, task int, sums array<{kind}>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for a in range(0, len(x), BLOCK_ROWS):
                block = part(x[a : a + BLOCK_ROWS])
                total = block if total is None else total + block
        if total is not None:
            task = TaskContext.get().partitionId()
            rows = len(total)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({
                "row": np.arange(rows, dtype=np.int32), "bucket": np.full(rows, task % FIRST_GROUPS, np.int32),
                "task": np.full(rows, task, np.int32), "sums": list(total)}))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group, total = group.sort_values("task"), None
        for values in group["sums"]:
            total = np.array(values) if total is None else total + values
        first = group.iloc[:1][["row", "bucket", "task"]]
        return first.assign(sums=[total])

    rows = fit.select("x").mapInArrow(partial, schema)
    rows = rows.groupBy("row", "bucket").applyInPandas(meet, schema).groupBy("row").applyInPandas(meet, schema)
    return {r.row: np.array(r.sums) for r in rows.collect()}


def fit(rows: DataFrame, vector: str = "vector", components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening that ``rows`` give, and the rows that take part (with ``x``)."""
    rows = whole_vectors(rows, vector)
    distinct = cut_lineage(rows.groupBy("x").agg(F.count("*").alias("copies")).select("x", F.size("x").alias("dim")))
    lengths = distinct.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None:
        return None, rows
    dim, n = lengths["dim"], lengths["n"]
    vectors, rows = distinct.where(F.col("dim") == dim), rows.where(F.size("x") == dim)

    # whole numbers in two halves: 32 low bits and the rest, so that no sum of theirs overflows
    halves = _summed(vectors, dim, lambda x: np.stack([(x >> LOW_BITS).sum(0), (x & (1 << LOW_BITS) - 1).sum(0)]), "long")
    sums = [(int(h) << LOW_BITS) + int(low) for h, low in zip(halves[0], halves[1], strict=True)]
    mean = np.array([s / n for s in sums])
    products = _summed(vectors, dim, lambda x: _products(x - mean), "double")
    covariance = np.stack([products[i] for i in range(dim)]) / n

    values, components_ = spectrum(covariance)
    values, components_ = np.maximum(values[:components], 0.0), components_[:, :components]
    largest = np.abs(components_).argmax(axis=0)
    components_ = components_ * np.where(components_[largest, np.arange(components_.shape[1])] < 0, -1.0, 1.0)
    made = Whitening(n, sums, values, components_, float(np.trace(covariance)), 0.0)

    scaled = made.scaled()
    got = _summed(vectors, dim, lambda x: _products((x - mean) @ scaled), "double")
    identity = np.diag(np.any(scaled != 0, axis=0).astype(float))
    made.identity_error = float(np.abs(np.stack([got[i] for i in range(len(identity))]) / n - identity).max())
    return made, rows


def _products(centred: np.ndarray) -> np.ndarray:
    return centred.T @ centred


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums of (n x - S)^2: in 64 bits where they are sure to fit, else in whole numbers of any size."""
    top = max((abs(n * int(v) - s) for m in (x.min(axis=0), x.max(axis=0)) for v, s in zip(m, sums, strict=True)), default=0)
    if top * top * len(sums) < 1 << 62 and all(abs(s) < 1 << 62 for s in sums) and n * int(np.abs(x).max()) < 1 << 62:
        off = n * x - np.array(sums, np.int64)
        return pa.array((off * off).sum(axis=1), pa.int64())
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(rows: DataFrame, model: Whitening, vec_id: str = "vec_id") -> DataFrame:
    """``vec_id, deviation, whitened`` (a list by component) of each row with its ``x``."""
    scaled, n, sums, dim = model.scaled(), model.n, model.sums, model.dim
    mean = np.array([s / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim)
                white = (x - mean) @ scaled
                flat = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), _deviations(x, n, sums), flat], names=[vec_id, "deviation", "whitened"])

    kind = rows.schema[vec_id].dataType.simpleString()
    return rows.select(vec_id, "x").mapInArrow(run, f"`{vec_id}` {kind}, deviation long, whitened array<double>")


def components_of(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each row of ``vec_id, vector`` and component."""
    model, rows = fit(vectors, components=components)
    if model is None:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    explained = F.array(*(F.lit(float(v)) for v in model.explained()))
    long = whiten(rows.withColumn("vec_id", F.col("vec_id").cast("long")), model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE: dict[str, str] = {}
