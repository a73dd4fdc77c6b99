"""Byte-level BPE: encoding with a rank queue on a hierarchical bitmap, and decoding.

A text is split into pre-tokens by the pattern, and the bytes of each are merged in
the order of merge ranks (ties from left to right). The queue has a bucket per rank
with the positions of pairs of that rank; a two-level bitmap over the ranks gives the
next rank by find-first-set; positions whose pair has changed meanwhile are skipped
as stale. Parts form a linked list, so a merge touches its neighbours only and a
pre-token of n bytes costs O(n log n) however long it is. New pre-tokens go through the
queue together, each one apart; those seen before are taken from a bounded table.

Defined results: a null text is encoded as an empty one and has no ids; decoding ids
gives the bytes of the text; null ids decode to no bytes. Columns ``ids`` and
``decoded`` of the input are replaced; all others are carried.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from gatewarden.llm.common import read, text_slices, whole_text
from gatewarden.llm.token_counts import BEYOND_LATIN, LATIN_WORD

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pre-tokens that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: Bytes of text that are encoded together.
SLICE_BYTES = 1_000_000
#: A byte that never occurs in UTF-8.
BETWEEN = b"\xff"


class Vocabulary:
    """Ranks by token, tokens by rank, and the pre-tokens seen."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.tokens[-1] = b""  # what a null id decodes to
        self.pattern = regex.compile(pattern)
        # an equal pattern of plain classes for texts up to Latin-1, if it is the one that is known
        self.latin = LATIN_WORD if pattern == public_tokenizers.PATTERN else None
        tokens = [self.tokens.get(rank, b"") for rank in range(max(self.tokens) + 1)] + [b""]  # the last one for id -1
        self.table, self.widths = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.widths) - self.widths
        self.buckets: list[list[int] | None] = [None] * (max(self.tokens) + 1)
        self.word_of = [rank >> 8 for rank in range(len(self.buckets))]
        self.bit_of = [1 << (rank & 255) for rank in range(len(self.buckets))]
        self.lower = [0] * (len(self.buckets) // 256 + 1)
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = [self.ranks.get(bytes(ab), -1) for ab in product(range(256), repeat=2)]
        self.separable = not any(BETWEEN in token and len(token) > 1 for token in self.ranks)
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of a pre-token."""
        ranks, n = self.ranks, len(data)
        if (whole := ranks.get(data)) is not None:
            return [whole]
        find, pairs = ranks.get, self.pairs
        part = [self.bytes[b] for b in data]  # the id of the part that begins here
        after = list(range(1, n + 1))  # where a part ends, which is where the next begins
        before = list(range(-1, n - 1))
        pair = [pairs[a << 8 | b] for a, b in zip(data, data[1:])]  # rank of the pair that begins at a part
        pair.append(-1)
        # the queue is empty before and after: positions by rank, bits of 256 ranks to a word, bits of words
        buckets, lower, word_of, bit_of, upper = self.buckets, self.lower, self.word_of, self.bit_of, 0
        for i, rank in enumerate(pair):
            if rank >= 0:
                if buckets[rank]:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = word_of[rank]
                    lower[word] |= bit_of[rank]
                    upper |= bit_of[word]
        while upper:
            less = upper - 1  # find first set, in both levels: x ^ (x - 1) ends at the lowest bit
            word = (upper ^ less).bit_length() - 1
            bits = lower[word]
            rest = bits - 1
            rank = (word << 8) + (bits ^ rest).bit_length() - 1
            lower[word] = bits = bits & rest
            if not bits:
                upper &= less
            positions, buckets[rank] = buckets[rank], None
            if len(positions) > 1:
                positions.sort()
            for k, i in enumerate(positions):
                if pair[i] != rank:
                    continue  # stale: another pair begins here by now, or none
                middle = after[i]
                after[i] = end = after[middle]
                part[i] = rank
                pair[middle] = pair[i] = least = -1
                if end < n:
                    before[end] = i
                    new = find(data[i : after[end]], -1)
                    if new >= 0:
                        pair[i] = least = new
                        if buckets[new]:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            word = word_of[new]
                            lower[word] |= bit_of[new]
                            upper |= bit_of[word]
                left = before[i]
                if left >= 0:
                    pair[left] = new = find(data[left:end], -1)
                    if new >= 0:
                        if least < 0 or new < least:
                            least = new
                        if buckets[new]:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            word = word_of[new]
                            lower[word] |= bit_of[new]
                            upper |= bit_of[word]
                if 0 <= least <= rank and k + 1 < len(positions):  # goes first: the rest waits
                    buckets[rank] = (buckets[rank] or []) + positions[k + 1 :]
                    lower[word_of[rank]] |= bit_of[rank]
                    upper |= bit_of[word_of[rank]]
                    break
        ids, i = [], 0
        while i < n:
            ids.append(part[i])
            i = after[i]
        return ids

    def merge_all(self, words: list[str]) -> list[bytes]:
        """The ids of many pre-tokens, merged in one pass of the queue.

        A byte that UTF-8 never has stands between them. No longer token holds it, so
        nothing is merged across, and the words share the steps over the ranks.
        """
        if not words:
            return []
        if not self.separable:
            return [array("i", self.merge(w.encode())).tobytes() for w in words]
        ids = array("i", self.merge(BETWEEN.join([w.encode() for w in words]))).tobytes()
        flat = np.frombuffer(ids, np.int32)
        ends = np.flatnonzero(flat == self.bytes[BETWEEN[0]]).tolist()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(flat)], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        split = [self.split(text) for text in texts]
        words = set().union(*split)
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        new = sorted(words.difference(self.known))
        found = dict(zip(new, self.merge_all(new), strict=True))
        longer = {w: found.pop(w) for w in new if len(w) > REMEMBERED_CHARS}
        self.known.update(found)
        find = self.known.get
        return [b"".join([find(w) or longer[w] for w in words]) for words in split]

    def split(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or not BEYOND_LATIN.search(text)):
            return self.latin.findall(text)
        return self.pattern.findall(text)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids behind each other, gathered from a flat table, and where the texts of ``ends`` end."""
        widths = self.widths[ids]
        stops = np.cumsum(widths)
        places = np.repeat(self.places[ids] - (stops - widths), widths)
        places += np.arange(len(places))
        return self.table[places], np.concatenate(([0], stops))[ends]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(path, pattern)


def _with_column(df: DataFrame, name: str, kind) -> StructType:
    return StructType([f for f in df.schema.fields if f.name != name]).add(name, kind)


def encode(
    docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, text: str = "text", decoded: bool = False
) -> DataFrame:
    """``docs`` with a column ``ids``, and with ``decoded`` also the bytes that those ids give."""
    made = ["ids", "decoded"] if decoded else ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            names = [n for n in batch.schema.names if n not in made]
            for start, texts in text_slices(batch, text, SLICE_BYTES):
                ids = vocab.encode([t or "" for t in texts])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                columns = [*batch.select(names).slice(start, len(ids)).columns, pa.ListArray.from_arrays(pa.array(ends), flat)]
                if decoded:
                    columns.append(_decoded(vocab, columns[-1]))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    schema = _with_column(docs, "ids", ArrayType(IntegerType()))
    return docs.mapInArrow(run, StructType([f for f in schema.fields if f.name != "decoded"]).add("decoded", BinaryType()) if decoded else schema)


def _decoded(vocab: Vocabulary, ids: pa.ListArray) -> pa.Array:
    ids = ids.fill_null([])
    ends = np.concatenate(([0], ids.value_lengths().to_numpy().cumsum()))
    data, ends = vocab.decode_all(ids.flatten().fill_null(-1).to_numpy(), ends)
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def decode(encoded: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` in a column ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, _decoded(vocab, batch.column("ids"))], names=[*names, "decoded"])

    return encoded.mapInArrow(run, _with_column(encoded, "decoded", BinaryType()))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    # both directions in one worker, which keeps one vocabulary in memory
    coded = encode(docs, decoded=True)
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_bpe": op3_bpe}
ORACLE: dict[str, str] = {}
