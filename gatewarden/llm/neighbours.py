"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by halving it along the direction between two
means until the parts are small, so that lists are balanced. A graph joins each centroid
to its nearest ones; a beam search over it finds the lists of a vector. A vector goes to
its nearest list and to others that are hardly farther (distance ratio), so boundaries
are replicated. A query visits lists within a wider ratio of its nearest one, and some
lists in any case. Large lists and large groups of queries are split into blocks; each
pair of blocks is compared by one task and sends on a few rows per query.

Nearness is the cosine in double precision, on the original vectors. Every valid row is
indexed; vectors that are null, zero or hold null or non-finite components take no
part. Ties go to the smaller id. Rows that repeat an id count as one candidate (the
best score of its vectors); a query never finds its own id. If fewer candidates exist,
all are returned. Vectors of another length than the most common one in the sample
take no part. Further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewarden.llm.common import read
from gatewarden.session import cut_lineage

NEAREST = 5
#: Bounds of what is fitted and sent to every task: rows of the sample, and lists.
SAMPLE_ROWS, MOST_LISTS = 20_000, 1_024
#: Vectors in a list on average, while there are fewer than MOST_LISTS lists.
LIST_ROWS = 400
#: Neighbours of a centroid in the graph, and width of the beam.
DEGREE, BEAM = 24, 96
#: A vector is kept in lists within this ratio of its nearest centroid, at most so many.
KEEP_RATIO, MOST_KEPT = 1.06, 4
#: A query visits lists within this ratio, and at least and at most so many.
VISIT_RATIO, LEAST_VISITED, MOST_VISITED = 1.35, 16, 64
#: Vectors and queries in a block.
BLOCK_ROWS, BLOCK_QUERIES = 4_000, 1_000


def halve(sample: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Centroids of ``lists`` balanced parts (a power of two) of unit vectors."""
    rng, parts = np.random.default_rng(seed), [sample]
    while len(parts) < lists:
        halves = []
        for part in parts:
            if len(part) < 2:
                halves.append(part)
                continue
            a, b = part[rng.choice(len(part), 2, replace=False)]
            for _ in range(4):
                side = part @ (a - b)
                near = side >= np.median(side)
                if near.all() or not near.any():
                    break
                a, b = part[near].mean(0), part[~near].mean(0)
            order = np.argsort(part @ (a - b), kind="stable")
            halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        if len(halves) == len(parts):
            break
        parts = halves
    return np.array([p.mean(0) for p in parts if len(p)], np.float32)


class CentroidGraph:
    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.squares = (centroids.astype(np.float64) ** 2).sum(1).astype(np.float32)
        n = len(centroids)
        gaps = self.squares[None, :] - 2 * centroids @ centroids.T
        self.links = np.argsort(gaps, axis=1, kind="stable")[:, : min(n, DEGREE + 1)]
        # entries far from each other, by farthest-first choice
        entries = [0]
        least = gaps[0] + self.squares[0]
        while len(entries) < min(n, 16):
            entries.append(int(np.argmax(least)))
            least = np.minimum(least, gaps[entries[-1]] + self.squares[entries[-1]])
        self.entries = np.array(entries)

    def search(self, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest lists of unit vectors found by beam search, and their distances."""
        n, k = len(vectors), len(self.centroids)
        rows = np.arange(n)[:, None]
        dist = np.full((n, k), np.inf, np.float32)  # known distances; everything else is unseen
        spread = np.zeros((n, k), bool)

        def see(nodes: np.ndarray) -> None:
            found = self.squares[nodes] - 2 * np.einsum("ijk,ik->ij", self.centroids[nodes], vectors)
            dist[rows, nodes] = found

        see(np.broadcast_to(self.entries, (n, len(self.entries))))
        width = min(k, max(BEAM, most))
        for _ in range(4 * width):
            beam = np.argpartition(dist, width - 1, axis=1)[:, :width] if width < k else np.broadcast_to(np.arange(k), (n, k))
            score = np.where(spread[rows, beam], np.inf, dist[rows, beam])
            best = np.argsort(score, axis=1)[:, :4]  # the four best that were not followed yet
            if not np.isfinite(score[rows, best]).any():
                break
            nodes = beam[rows, best]
            fresh = np.isfinite(score[rows, best])
            nodes = np.where(fresh, nodes, nodes[:, :1])
            spread[rows, nodes] = True
            see(self.links[nodes].reshape(n, -1))
        order = np.argsort(dist, axis=1, kind="stable")[:, : min(k, most)]
        return order, np.sqrt(np.maximum(dist[rows, order] + 1, 0))


def is_valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (vectors / np.sqrt((vectors**2).sum(1, keepdims=True))).astype(np.float32)


def _lists(graph: CentroidGraph, ratio: float, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                lists, gaps = graph.search(_unit(_matrix(batch.column("vector"))), most)
                used = (gaps <= ratio * gaps[:, :1] + 1e-6) & np.isfinite(gaps)
                used[:, :least] |= np.isfinite(gaps[:, :least])
                row, place = np.nonzero(used)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), batch.column("vector").take(pa.array(row)), pa.array(lists[row, place], pa.int32())],
                    names=["id", "vector", "list"])

    return run


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The cosines of pairs of rows, summed in an order that depends on nothing else."""
    scale = lambda x: np.abs(x).max(axis=1, keepdims=True)
    huge = max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)) > 1e150
    tiny = min(scale(queries).min(initial=1), scale(vectors).min(initial=1)) < 1e-150
    if huge or tiny:
        queries, vectors = queries / scale(queries), vectors / scale(vectors)
    dot = (queries * vectors).sum(1)
    return dot / (np.sqrt((queries**2).sum(1)) * np.sqrt((vectors**2).sum(1)))


def _compare(nearest: int):
    def run(found: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if found.num_rows and queries.num_rows:
            q, v = (_matrix(t["vector"]).astype(np.float64) for t in (queries, found))
            q_ids, v_ids = queries["id"].to_numpy(), found["id"].to_numpy()
            rough = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
            rough[q_ids[:, None] == v_ids[None, :]] = -np.inf
            rough[np.isnan(rough)] = 2.0  # over- or underflow: the exact form decides
            # one place more than asked for each repeat of an id is not known beforehand: ties are all kept
            k = min(nearest, rough.shape[1])
            least = np.partition(rough, -k, axis=1)[:, -k] - 1e-9
            for i in range(len(q)):
                places = np.flatnonzero((rough[i] >= least[i]) & (rough[i] > -np.inf))
                scores = exact(np.broadcast_to(q[i], (len(places), q.shape[1])), v[places])
                order = np.lexsort((v_ids[places], -scores))
                ids, first = np.unique(v_ids[places][order], return_index=True)
                picked = order[np.sort(first)[:nearest]]
                if len(ids) < min(nearest, rough.shape[1]):  # repeats of an id took places: look at all
                    places = np.flatnonzero(rough[i] > -np.inf)
                    scores = exact(np.broadcast_to(q[i], (len(places), q.shape[1])), v[places])
                    order = np.lexsort((v_ids[places], -scores))
                    picked = order[np.sort(np.unique(v_ids[places][order], return_index=True)[1])[:nearest]]
                out.append((np.full(len(picked), q_ids[i]), v_ids[places][picked], scores[picked]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def fit(vectors: DataFrame) -> tuple[CentroidGraph, int]:
    """The graph of centroids and the length of vectors, from a sample of bounded size."""
    rows = vectors.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE_ROWS).select("vector").toArrow()
    vectors_ = rows["vector"].combine_chunks()
    lengths = vectors_.value_lengths().to_numpy()
    size = int(np.bincount(lengths).argmax()) if len(lengths) else 1
    sample = _unit(_matrix(vectors_.filter(pa.array(lengths == size)))) if len(lengths) else np.ones((1, 1), np.float32)
    lists = 1
    while lists < min(MOST_LISTS, vectors.count() / LIST_ROWS):
        lists *= 2
    return CentroidGraph(halve(sample, lists)), size


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``id, vector`` tables."""
    vectors = cut_lineage(vectors.where(is_valid(F.col("vector"))))
    graph, size = fit(vectors)
    same = F.size("vector") == size
    schema = "id long, vector array<double>, list int"
    kept = cut_lineage(vectors.where(same).mapInArrow(_lists(graph, KEEP_RATIO, 1, MOST_KEPT), schema))
    asked = cut_lineage(queries.where(is_valid(F.col("vector")) & same).mapInArrow(_lists(graph, VISIT_RATIO, LEAST_VISITED, MOST_VISITED), schema))
    blocks = lambda t, most, name: t.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    # one row per list, of which there are MOST_LISTS at most
    sizes = F.broadcast(cut_lineage(blocks(kept, BLOCK_ROWS, "vs").join(blocks(asked, BLOCK_QUERIES, "qs"), "list")))
    spread = lambda t, mine, other: t.join(sizes, "list").select(
        "id", "vector", "list", F.pmod(F.xxhash64("id"), F.col(mine)).cast("int").alias(mine[0]),
        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0]))
    key = ("list", "v", "q")
    pairs = spread(kept, "vs", "qs").groupBy(*key).cogroup(spread(asked, "qs", "vs").groupBy(*key)).applyInArrow(
        _compare(nearest), "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector")).where("id IS NOT NULL")
    return search(vectors, vectors.where("id % 50 = 0"))


QUERIES = {"op2_neighbours": op2_neighbours}
ORACLE: dict[str, str] = {}
