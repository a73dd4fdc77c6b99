"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its runs of five words (lower-cased, split at white space;
a shorter text is one run). Every distinct run sends out Poisson processes over its
weight, block by block: weights [0,1), [1,2), [2,4), [4,8), ... A point of a block
has a register, a value and a weight level; it counts if the level is below the weight
of the run (the process of a block is thinned to the part the weight covers). The
least value per register is the signature: two texts agree in a register with
probability sum(min) / sum(max) of their weights. Bands of registers name candidates.

Texts with equal multisets are one node. In each band bucket all nodes are compared with
one leader, the node that meets most others in its buckets, so that families of edits have
few leaders near their centre; accepted links (weighted Jaccard of 0.8 or more, counted
exactly) give components. Where a bucket still has several components, the nodes outside
its largest one have to be compared with all nodes of other components, and those pairs
are found without listing them (``candidates``): a run that few of these texts hold is
an index to its holders, and what two texts can share beyond such runs is bounded by the number of frequent
runs in each. A text of which more than a fifth is its own meets nobody. Bounds on sizes and
on the distances to the bucket's leader (the distance is a metric) thin the pairs that are
left; they are tested by rounds of leaders. No pair of a bucket that could reach 0.8 stays
untested unless it is already connected, and no bucket is ever gathered in one task.

Defined results: a null or empty text is a class of its own; the smallest id of a
class is its ``class_id`` and stays; a null id is replaced by its class only if others
have ids. Where copies are dropped, rows are told apart by a row id: texts that differ
are kept though their ids repeat, and of near copies without ids one stays. Further
columns are carried and never read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm.common import broadcast_if_bounded, read, text_slices, whole_text
from gatewarden.llm.components import components, merged
from gatewarden.session import cut_lineage

RUN_WORDS = 5
#: Similarity as a fraction: 4 / 5.
LEAST_SHARED, LEAST_ALL = 4, 5
#: A pair at the least similarity is missed with probability (1 - 0.8**7)**48 < 2e-5, one at
#: 0.85 with less than 1e-8; one at 0.5, as common passages make it, meets in 0.4 buckets.
BANDS, ROWS = 48, 7
REGISTERS = BANDS * ROWS
SLICE_BYTES = 1_000_000
#: Texts that hold a run at most for it to be an index to them: a run makes up to RARE (RARE - 1) / 2 pairs.
RARE = 4
#: Leaders of a bucket in the first round after the first leader; four times as many in each later one.
FIRST_LEADERS = 64
NO_ID = (1 << 63) - 1

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    return words + [""] * (RUN_WORDS - len(words)) if words else words


def bag_min_hash(doc: np.ndarray, run: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """Signatures (docs x registers) of weighted runs; ``run`` holds 64-bit hashes."""
    signature = np.full((docs, REGISTERS), np.inf)
    blocks = [(np.ones(len(doc), bool), 0, 1)]
    top, k = int(weight.max(initial=1)), 0
    while (1 << k) < top:
        blocks.append((weight > (1 << k), 1 << k, 1 << k))
        k += 1
    of, seed, low, width, limit = (np.concatenate(x) for x in zip(*(
        (doc[m], _mix(run[m] + _U(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))), np.full(m.sum(), a), np.full(m.sum(), b), weight[m])
        for i, (m, a, b) in enumerate(blocks)), strict=True))
    at, step = np.zeros(len(of)), 0
    while len(of):
        points = int(min(64, max(1, 100_000 // len(of))))
        count = np.arange(step + 1, step + points + 1, dtype=np.uint64)
        draw = _mix(seed[:, None] + count * _U(0xD1B54A32D192ED03))
        gaps = -np.log(((draw >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)) / width[:, None]
        # added strictly in order, so that the bits of a value do not depend on the other texts of the slice
        value = np.cumsum(np.concatenate([at[:, None], gaps], axis=1), axis=1)[:, 1:]
        other = _mix(draw + _U(0x8CB92BA72F3D8DD7))
        register = ((other & _U(0xFFFFFFFF)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
        level = low[:, None] + ((other >> _U(40)).astype(np.int64) * width[:, None] >> 24)  # upper bits
        good = (level < limit[:, None]) & (value < signature.max(axis=1)[of][:, None])
        np.minimum.at(signature, (np.broadcast_to(of[:, None], good.shape)[good], register[good]), value[good])
        at, step = value[:, -1], step + points
        going = at < signature.max(axis=1)[of]
        of, seed, low, width, limit, at = (x[going] for x in (of, seed, low, width, limit, at))
    return signature


def run_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs as (number of the text, 64-bit hash), sorted, and the number of runs of each text."""
    split = [words_of(t) for t in texts]
    table = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*split)}
    sizes = np.array([len(s) for s in split], np.int64)
    hashes = np.fromiter((table[w] for s in split for w in s), np.uint64, int(sizes.sum()))
    n_runs = np.maximum(sizes - RUN_WORDS + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n_runs)
    begin = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n_runs) - n_runs), n_runs) + np.arange(len(doc))
    run = np.zeros(len(doc), np.uint64)
    for k in range(RUN_WORDS):
        run = _mix(run + hashes[begin + k] + _U(k + 1))
    order = np.lexsort((run, doc))
    return doc[order], run[order], n_runs


def _first_places(doc: np.ndarray, run: np.ndarray) -> np.ndarray:
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])
    return np.flatnonzero(new)


def sketch(texts: list[str]) -> list[tuple[bytes | None, list[int] | None, int]]:
    """Digest of the multiset, band hashes and number of runs of each text."""
    doc, run, n_runs = run_hashes(texts)
    starts = _first_places(doc, run)
    weight = np.diff(np.append(starts, len(doc)))
    doc_u, run_u = doc[starts], run[starts]
    signature = bag_min_hash(doc_u, run_u, weight, len(texts)).view(np.uint64)
    bands = np.zeros((len(texts), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        bands = _mix(bands + signature.reshape(-1, BANDS, ROWS)[:, :, k])
    edges = np.searchsorted(doc_u, np.arange(len(texts) + 1))
    out = []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a == b:
            out.append((None, None, 0))
        else:
            digest = hashlib.blake2b(run_u[a:b].tobytes() + weight[a:b].tobytes(), digest_size=16).digest()
            out.append((digest, bands[i].view(np.int64).tolist(), int(n_runs[i])))
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(batch, "text", SLICE_BYTES):
            digests, bands, runs = zip(*sketch(texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, len(texts)), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(runs, pa.int64())],
                names=["doc_id", "node", "bands", "runs"])


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, node, bands, runs`` of every row, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return cut_lineage(rows.mapInArrow(_sketches, "doc_id long, node binary, bands array<long>, runs long"))


def bag(text: str) -> Counter:
    words = words_of(text)
    return Counter(zip(*(words[k:] for k in range(RUN_WORDS))))


def shared_runs(a: Counter, b: Counter) -> int:
    """sum(min) of two bags."""
    if len(a) > len(b):
        a, b = b, a
    return sum(min(n, b[run]) for run, n in a.items() if run in b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, held = None, Counter()
    for batch in batches:
        columns = [batch.column(c) for c in ("a", "b")]
        found = []
        for i, (leader, text_a, text_b) in enumerate(zip(columns[1].to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True)):
            if leader != last:
                last, held = leader, bag(text_b.as_py())
            other = bag(text_a.as_py())
            found.append((shared_runs(other, held), other.total() + held.total()))
        shared, total = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "shared", "total"])


def counted(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (``a, b``) with ``shared`` and ``total`` runs, counted on whole texts, written to the shared folder."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return cut_lineage(pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_count, "a binary, b binary, shared long, total long"))


def similar(shared, total):
    """sum(min) / sum(max) >= 4 / 5, in whole numbers."""
    return shared * (LEAST_SHARED + LEAST_ALL) >= total * LEAST_SHARED


def sizes_allow(n, m):
    """The smaller of two texts has at least 4 / 5 of the runs of the larger."""
    return (n * LEAST_ALL >= m * LEAST_SHARED) & (m * LEAST_ALL >= n * LEAST_SHARED)


def _node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the nodes (``node, rep``) that have candidates."""
    wanted = broadcast_if_bounded(nodes.select("node", F.col("rep").alias("id")))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), whole_text().alias("text"))

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a repeated id may have other texts: only the one of the node is taken
            for start, texts in text_slices(batch, "text", SLICE_BYTES):
                node = batch.column("node").slice(start, len(texts))
                same = [digest == n for (digest, *_), n in zip(map(_digest, texts), node.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([node, pa.array(texts, pa.string()), pa.array(same)], names=["node", "text", "same"])

    joined = rows.join(wanted, "id").select("node", "text")
    if not nodes.where("rep_rows > 1 or rep = " + str(NO_ID)).limit(1).isEmpty():
        joined = joined.mapInArrow(matching, "node binary, text string, same boolean").where("same").select("node", "text").dropDuplicates(["node"])
    return cut_lineage(joined)


def _digest(text: str) -> tuple:
    return sketch([text])[0]


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(batch, "text", SLICE_BYTES):
            doc, run, _ = run_hashes(texts)
            starts = _first_places(doc, run)
            nth = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
            element = _mix(run + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
            nodes = batch.column("node").slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(doc)), pa.array(element.view(np.int64))], names=["node", "element"])


def _rare(texts: DataFrame) -> DataFrame:
    """``node, element, holders`` of the elements (a run and its how-manieth time) that at most RARE of the texts hold.

    Written to the shared folder. Holders are counted before they meet, and frequent elements are not joined.
    """
    elements = texts.mapInArrow(_elements, "node binary, element long")
    few = elements.groupBy("element").agg(F.count("*").alias("holders")).where(F.col("holders") <= RARE)
    return cut_lineage(elements.join(few, "element"))


def candidates(open_: DataFrame, texts: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` that share rare runs and may be near, and the rows of ``open_`` that may be near without them.

    With r rare runs in common and f frequent ones in each, two texts share at most
    r + min(f) runs. ``open_`` (``bucket, node, label, ...``) comes back with ``n`` runs and ``f``.
    """
    nodes = open_.select("node", "label").distinct()
    rare = _rare(texts.join(nodes, "node", "left_semi"))
    own = rare.groupBy("node").agg(F.count("*").alias("rare"))
    of = cut_lineage(nodes.join(runs, "node").join(own, "node", "left").select("node", "label", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("f")))
    held = rare.where("holders > 1").select("node", "element")
    both = held.withColumnRenamed("node", "a").join(held.withColumnRenamed("node", "b"), "element").where("a < b").groupBy("a", "b").agg(F.count("*").alias("rare"))
    end = lambda e: of.select(F.col("node").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in ("label", "n", "f")))
    by_rare = both.join(end("a"), "a").join(end("b"), "b").where(F.col("label_a") != F.col("label_b")).where(
        similar(F.col("rare") + F.least("f_a", "f_b"), F.col("n_a") + F.col("n_b")) & sizes_allow(F.col("n_a"), F.col("n_b")))
    # a text that is not near to a part of itself, its frequent runs, is near to none without rare runs
    able = of.where(sizes_allow(F.col("f"), F.col("n"))).drop("label")
    return cut_lineage(by_rare.select("a", "b")), open_.join(able, "node")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, links, kept, runs`` of every row of ``docs`` (``links``: verified partners seen)."""
    rows = sketches(docs)
    some = rows.where("node IS NOT NULL").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    per_id = some.groupBy("node", "id").agg(F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("runs").alias("runs"))
    ids_elsewhere = some.groupBy("id").agg(F.count("*").alias("id_rows"))
    nodes = per_id.groupBy("node").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.max("runs").alias("runs"))
    nodes = cut_lineage(nodes.join(ids_elsewhere, nodes["rep"] == ids_elsewhere["id"]).select(
        "node", "rep", "bands", "runs", F.col("id_rows").alias("rep_rows")))
    runs = nodes.select("node", F.col("runs").alias("n"))

    # buckets with one node name no candidates and go at once
    member = nodes.select("node", F.col("runs").alias("n"), F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    member = cut_lineage(member.join(sizes, "bucket"))
    meets = member.groupBy("node").agg(F.sum("size").alias("meets"))
    heads = member.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node", "n")).alias("head")).select(
        "bucket", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"))
    member = cut_lineage(member.join(heads, "bucket").withColumn("place", F.xxhash64("node", "bucket")))
    ends = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    # the leader's text is read once for all that follow it
    led_by = member.where((F.col("node") != F.col("head")) & sizes_allow(F.col("n"), F.col("head_n")))
    texts = _node_texts(docs, nodes.join(member.select("node").distinct(), "node", "left_semi"))
    seen = counted(led_by.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), texts)
    tested = cut_lineage(seen.select(*ends("a", "b")).distinct())
    links = cut_lineage(seen.where(similar(F.col("shared"), F.col("total"))).select(*ends("a", "b")).distinct())
    labels = components(links)
    # similarity to the leader; a leader to itself is 1
    near = seen.select(F.col("a").alias("node"), F.col("b").alias("head"), (F.col("shared") / (F.col("total") - F.col("shared"))).alias("to_head"))
    label_of = lambda: F.coalesce("label", "node").alias("label")

    def open_nodes() -> DataFrame:
        """The nodes of buckets that have several components, with the label of the largest."""
        known = member.select("bucket", "node", "place", "head").join(labels, "node", "left").withColumn("label", label_of())
        counts = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        largest = counts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"))
        return known.join(largest.where("labels > 1").select("bucket", F.col("top.label").alias("top")), "bucket")

    def learn(pairs: DataFrame) -> None:
        nonlocal tested, links, labels
        tested = tested.unionByName(pairs)
        found = counted(pairs, texts)
        more = cut_lineage(found.where(similar(F.col("shared"), F.col("total"))).select("a", "b"))
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = merged(labels, more)

    first = cut_lineage(open_nodes())
    by_rare, able = candidates(first, texts, runs)
    able = cut_lineage(able.join(near, ["node", "head"], "left").select(
        "bucket", "node", "n", "f", F.when(F.col("node") == F.col("head"), 1.0).otherwise(F.col("to_head")).alias("to_head")))
    learn(cut_lineage(by_rare.join(tested, ["a", "b"], "left_anti")))

    leaders, led = FIRST_LEADERS, None
    while True:
        open_ = cut_lineage(open_nodes().select("bucket", "node", "place", "label", "top").join(able, ["bucket", "node"]))
        # frequent runs must reach the least size in the bucket, which is 4 / 5 of the own one at least
        least = open_.groupBy("bucket").agg(F.min("n").alias("least"))
        minor = open_.join(least, "bucket").where("label != top").where(
            similar(F.col("f"), F.col("n") + F.greatest("least", F.floor(F.col("n") * LEAST_SHARED / LEAST_ALL)))).drop("least")
        minor = minor if led is None else minor.join(led, ["bucket", "node"], "left_anti")
        minor = cut_lineage(minor.join(minor.groupBy("bucket").agg(F.count("*").alias("waiting")), "bucket"))
        if minor.isEmpty():
            break
        # a node leads if its place, as a share of the range of hashes, is below leaders / waiting
        share = (F.col("place").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
        now = cut_lineage(minor.where((F.col("waiting") <= leaders) | (share * F.col("waiting") < leaders)).select(
            "bucket", F.col("node").alias("leader"), F.col("label").alias("of"), F.col("n").alias("of_n"), F.col("f").alias("of_f"),
            F.col("to_head").alias("of_head")))
        # distances to the head of the bucket differ by at most the distance of the pair
        apart = F.coalesce(F.abs(F.col("to_head") - F.col("of_head")) <= 1 - LEAST_SHARED / LEAST_ALL + 1e-9, F.lit(True))
        crossed = open_.join(now, "bucket").where(
            (F.col("label") != F.col("of")) & sizes_allow(F.col("n"), F.col("of_n")) & apart
            & similar(F.least("f", "of_f"), F.col("n") + F.col("of_n"))).select(*ends("node", "leader")).distinct()
        learn(cut_lineage(crossed.join(tested, ["a", "b"], "left_anti")))
        now = now.select("bucket", F.col("leader").alias("node"))
        led, leaders = now if led is None else led.unionByName(now), 4 * leaders
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    of_node = nodes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of_node.groupBy("label").agg(F.min("rep").alias("class_id"))
    of_node = of_node.join(least, "label").join(degree, "node", "left").select("node", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.join(of_node, "node", "left")
    class_id = F.coalesce(F.when(F.col("class_id") != NO_ID, F.col("class_id")), F.col("doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "runs",
                      (F.col("doc_id").isNull() | (class_id == F.col("doc_id"))).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each class, in the columns of ``docs``: that of the least id, null ids last, then the first one.

    Rows are told apart by a row id, so a repeated or null ``doc_id`` decides nothing but the order.
    """
    whole = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row")))
    of = classes(whole.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text"))).select(
        F.col("doc_id").alias("rid"), "class_id", "runs")
    # texts without words are no copies of each other, but a row that repeats both id and such a text is
    wordless = (F.col("runs") == 0) & F.col("id").isNotNull()
    first = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "rid")).alias("first")
    staying = whole.select("rid", "id").join(of, "rid").groupBy(
        F.when(~wordless, F.col("class_id")), F.when(wordless, F.col("id"))).agg(first).select("first.rid")
    return whole.select("rid", "row").join(staying, "rid", "left_semi").select("row.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLE: dict[str, str] = {}
