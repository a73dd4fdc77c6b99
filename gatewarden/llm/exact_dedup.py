"""Exact dedup against a minimal perfect hash of historical distinct digests.

History is reduced to distinct digests. They are dealt to shards by their first
bytes, and each shard gets a minimal perfect hash: levels of bit arrays in which a
digest that is alone at its place is settled; the rank of its bit is its slot. Slots
hold the full digest and the winner (largest id, rows so far). The new rows are also
reduced to distinct digests, meet the shard of the index once, and are members only
if all 32 bytes in the slot agree. Members add to their slot; all others are groups
of their own. Since both sides are distinct digests dealt by hash, shards are even
whatever the copies: a text with a third of all rows is one entry.

Texts are equal when identical after lower-casing A-Z; null is an empty text. The row
with the largest id stays. Null ids lose against others. Of repeated rows (equal text
and equal id) exactly one stays. Further columns are carried and never read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm.common import read, whole_text
from gatewarden.session import cut_lineage

#: Digests that a shard of the index holds on average, and bits per digest and level.
SHARD_DIGESTS, GAMMA = 50_000, 2
_LEVELS = 40

INDEX = ("shard int, n long, level_bits array<int>, bits binary, "
         "digests binary, winners binary, rows binary, rest binary")
RESOLVED = "digest binary, keep_id long, keep_row long, group_size long, historical boolean"


def normalised(text: str = "text") -> Column:
    return F.translate(whole_text(text), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, digest`` of every row, written once so that ``rid`` is fixed."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(normalised(), 256)).alias("digest"))
    return cut_lineage(rows)


def _places(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The place of each digest (rows of four words) in a level of so many bits."""
    x = words[:, level % 4] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(31)) ^ words[:, (level + 1) % 4]) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) % np.uint64(bits)


class PerfectHash:
    """Slots 0..n-1 for n distinct digests; others get any slot or none (-1)."""

    def __init__(self, level_bits: list[int], bits: np.ndarray, rest: np.ndarray) -> None:
        self.level_bits, self.bits, self.rest = level_bits, bits, rest
        self.ranks = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        level_bits, parts, left = [], [], words
        while len(left) and len(parts) < _LEVELS:
            size = max(64, GAMMA * len(left))
            at = _places(left, len(parts), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            level_bits.append(size)
            parts.append(alone)
            left = left[~alone[at]]
        order = np.lexsort(left.T) if len(left) else np.empty(0, np.int64)
        return cls(level_bits, np.concatenate(parts) if parts else np.zeros(0, bool), left[order])

    def slots(self, words: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.level_bits):
            at = base + _places(words[left], level, size).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left, base = left[~hit], base + size
        for k, word in enumerate(self.rest):  # practically always empty
            out[left[(words[left] == word).all(axis=1)]] = self.ranks[-1] + k
        return out


def _words(digest: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digest.to_pylist()), dtype="<u8").reshape(-1, 4)


def _build(table: pa.Table) -> pa.Table:
    words = _words(table["digest"].combine_chunks())
    mph = PerfectHash.build(words)
    order = np.argsort(mph.slots(words))
    longs = lambda name: table[name].to_numpy()[order].astype("<i8").tobytes()
    return pa.table({
        "shard": pa.array(table["shard"].to_pylist()[:1], pa.int32()), "n": pa.array([len(words)], pa.int64()),
        "level_bits": pa.array([mph.level_bits], pa.list_(pa.int32())), "bits": [np.packbits(mph.bits).tobytes()],
        "digests": [np.ascontiguousarray(words[order]).tobytes()],
        "winners": [np.stack([table["keep_id"].to_numpy(), table["keep_row"].to_numpy()], 1)[order].astype("<i8").tobytes()],
        "rows": [longs("group_size")], "rest": [mph.rest.tobytes()],
    })


def _look_up(index: pa.Table, new: pa.Table) -> pa.Table:
    """All digests of a shard with their winners, members of the index brought together."""
    schema = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()),
                        ("group_size", pa.int64()), ("historical", pa.bool_())])
    words = _words(new["digest"].combine_chunks()) if new.num_rows else np.zeros((0, 4), np.uint64)
    won = np.stack([new["keep_id"].to_numpy(), new["keep_row"].to_numpy()], 1) if new.num_rows else np.zeros((0, 2), np.int64)
    size = new["group_size"].to_numpy() if new.num_rows else np.zeros(0, np.int64)
    member = np.zeros(len(words), bool)
    held, winners, rows = np.zeros((0, 4), np.uint64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    if index.num_rows:
        row = index.to_pylist()[0]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["level_bits"])).astype(bool)
        mph = PerfectHash(row["level_bits"], bits, np.frombuffer(row["rest"], "<u8").reshape(-1, 4))
        held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
        winners = np.frombuffer(row["winners"], "<i8").reshape(-1, 2).copy()
        rows = np.frombuffer(row["rows"], "<i8").copy()
        slots = mph.slots(words)
        found = np.flatnonzero(slots >= 0)
        member[found] = (held[slots[found]] == words[found]).all(axis=1)  # all bytes are compared
        at, mine = slots[member], won[member]
        later = (mine[:, 0] > winners[at, 0]) | ((mine[:, 0] == winners[at, 0]) & (mine[:, 1] > winners[at, 1]))
        winners[at[later]] = mine[later]
        rows[at] += size[member]
    all_words = np.concatenate([held, words[~member]])
    all_won = np.concatenate([winners, won[~member]])
    return pa.table({
        "digest": pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(all_words), [None, pa.py_buffer(np.ascontiguousarray(all_words))]).cast(pa.binary()),
        "keep_id": all_won[:, 0], "keep_row": all_won[:, 1], "group_size": np.concatenate([rows, size[~member]]),
        "historical": np.arange(len(all_words)) < len(held),
    }, schema=schema)


_NO_ID = -(1 << 63)


def winners_of(rows: DataFrame) -> DataFrame:
    """Distinct digests with the winning row, combined before the shuffle."""
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "rid"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select(
        "digest", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_row"), "group_size")


def _sharded(winners: DataFrame, shards: int) -> DataFrame:
    place = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return winners.withColumn("shard", (place % F.lit(shards)).cast("int"))


def shard_count(distinct: int) -> int:
    return max(1, -(-distinct // SHARD_DIGESTS))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of ``history`` (as of ``digests``): one row per shard, written to the shared folder."""
    return cut_lineage(_sharded(winners_of(history), shards).groupBy("shard").applyInArrow(_build, INDEX))


def resolve(index: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """Every distinct digest of history and ``new`` with the row that stays and the rows it stands for."""
    return index.groupBy("shard").cogroup(_sharded(winners_of(new), shards).groupBy("shard")).applyInArrow(_look_up, RESOLVED)


def mark(rows: DataFrame, is_history: Column) -> DataFrame:
    """``rows`` (as of ``digests``) with ``keep_id, keep_row, group_size, kept``.

    The rows that ``is_history`` names are indexed; the rest is looked up.
    """
    is_old = F.coalesce(is_history, F.lit(True))
    shards = shard_count(rows.agg(F.approx_count_distinct("digest")).first()[0])
    index = build_index(rows.where(is_old), shards)
    resolved = resolve(index, rows.where(~is_old), shards)
    kept = F.col("rid") == F.col("keep_row")
    return rows.join(resolved.drop("historical"), "digest").withColumn("kept", kept).withColumn(
        "keep_id", F.when(F.col("keep_id") != _NO_ID, F.col("keep_id")))


def earlier_half(rows: DataFrame) -> Column:
    """The rows that came first: ids up to the middle of their range count as history."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2).cast("long")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """One row of each text, in the columns of ``docs``."""
    whole = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(), 256)).alias("digest"), F.struct("*").alias("row")))
    rows = whole.drop("row")
    staying = mark(rows, earlier_half(rows)).where("kept").select("rid")
    return whole.select("rid", "row").join(staying, "rid", "left_semi").select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digests(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return mark(rows, earlier_half(rows)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
    WITH n AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
"""
QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE = {"op5_exact_dedup": OP5_SQL}
