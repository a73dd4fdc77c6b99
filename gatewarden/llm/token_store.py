"""Token ids in binary shards: a wavelet matrix per shard.

Texts are encoded with a word tokenizer, an end id is appended to each document, and
the ids go to shards in ascending order of document ids. A shard is one compressed
file: for each bit of an id a plane (most significant first; at each level the ids
with bit 0 move before those with bit 1), cut in segments that are compressed one by one, a
directory with the place of each segment and the ones before it, and the
document ids and offsets. Access to a token, counting and finding the occurrences of a
token read the directory and unpack the few segments that they touch; decoding reads all.

White space separates pre-tokens in this tokenizer, so the ids of a piece between
white space do not depend on what surrounds it. Pieces are encoded by the library once
and remembered; texts beyond Latin-1, with unusual separators or with the string of an added
token go to it whole.

Defined results: a null text has only the end id; repeated document ids keep all their
rows, in any order among themselves; null ids come first and are read back as null.
Documents are never split over shards. Further columns are never read.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatewarden.llm.common import broadcast_if_bounded, read, text_slices, whole_text
from gatewarden.session import cut_lineage

TOKENIZER, END_ID = public_tokenizers.path("word_bpe_49k.json"), 1
#: Ids in a shard (documents are kept whole), and bytes of text for a task that writes shards.
SHARD_IDS, TASK_BYTES = 1 << 20, 16_000_000
#: Pieces that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 64
#: Bytes of text that are encoded together.
SLICE_BYTES = 8_000_000
MAGIC = b"WMATRIX2"
#: Bits of a plane that are compressed together, and unpacked segments that a reader holds.
SEGMENT_BITS, HELD_SEGMENTS = 1 << 15, 64
ID = np.dtype("<u4")
NO_ID = -(1 << 63)

SHARD = "part int, seq int, n_ids long, content binary"


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes."""

    #: Separators on which the library and ``str.split`` may differ.
    UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0]")
    BEYOND = re.compile("[^\x00-\xff]")
    #: Fixed value: the pattern by which the tokenizer splits.
    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode the words of new pieces in one call; the last id of each word tells where it ends."""
        known = self.known
        # most pieces are a word, or a word and one other letter behind it
        parts = {p: [p[:-1], p[-1]] if p[:-1].isalpha() else self.WORD.findall(p) for p in pieces if not p.isalpha()}
        words = [w for w in dict.fromkeys(w for ws in parts.values() for w in ws) if w not in known]
        words = list(dict.fromkeys([*words, *(p for p in pieces if p not in parts)]))
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, ID)
        stops = np.flatnonzero(self.is_end[ids]) + 1
        if len(stops) == len(words):
            data, at = ids.tobytes(), [0, *(stops * ID.itemsize).tolist()]
            known.update(zip(words, (data[a:b] for a, b in zip(at, at[1:])), strict=True))
        else:
            known.update((w, self._whole(w)) for w in words)
        for piece, ws in parts.items():
            known[piece] = b"".join([known[w] for w in ws])

    def _plain(self, text: str) -> bool:
        """Whether the ids of the text are those of what stands between its white space."""
        return (text.isascii() or not self.BEYOND.search(text)) and not self.UNUSUAL.search(text) and not self.added.search(text)

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + 2 * len(new) > REMEMBERED:
            self.known, new = {"": b""}, pieces
        long = {p: self._whole(p) for p in new if len(p) > REMEMBERED_CHARS}
        if len(new) > len(long):
            self._learn([p for p in new if p not in long] if long else new)
        known = self.known
        return [long[p] if p in long else known[p] for p in pieces] if long else [known[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: pieces are told apart once, and their ids are put where the pieces stand."""
        plain = [self._plain(text) for text in texts]
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string())))
        pieces = split.flatten().dictionary_encode()
        found = self._ids_of(pieces.dictionary.to_pylist())
        flat, sizes = np.frombuffer(b"".join(found), ID), np.array([len(x) // ID.itemsize for x in found], np.int64)
        at = pieces.indices.to_numpy()
        counts = sizes[at]
        ends = np.cumsum(counts)
        places = np.repeat(((np.cumsum(sizes) - sizes)[at] - (ends - counts)).astype(np.int32), counts)
        places += np.arange(len(places), dtype=np.int32)
        ids = flat[places].tobytes()
        ends = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()] * ID.itemsize
        return [ids[a:b] if p else self._whole(t) for t, p, a, b in zip(texts, plain, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Plane:
    """One bit of all ids in its level's order: compressed segments and a directory of ranks."""

    def __init__(self, n: int, before: np.ndarray, places: np.ndarray, data: memoryview) -> None:
        self.n, self.before, self.places, self.data = n, before, places, data
        self.zeros = n - int(before[-1])
        self.segment = functools.lru_cache(HELD_SEGMENTS)(self._segment)

    @classmethod
    def pack(cls, bit: np.ndarray) -> Plane:
        packed, step = np.packbits(bit), SEGMENT_BITS // 8
        press = zstandard.ZstdCompressor(level=1).compress
        parts = [press(packed[a : a + step].tobytes()) for a in range(0, len(packed), step)]
        ones = [int(np.bitwise_count(packed[a : a + step]).sum()) for a in range(0, len(packed), step)]
        return cls(len(bit), np.cumsum([0, *ones], dtype="<i8"), np.cumsum([0, *map(len, parts)], dtype="<i8"), memoryview(b"".join(parts)))

    def _segment(self, k: int) -> np.ndarray:
        data = zstandard.ZstdDecompressor().decompress(self.data[self.places[k] : self.places[k + 1]])
        return np.frombuffer(data, np.uint8)

    def bits(self) -> np.ndarray:
        parts = [self._segment(k) for k in range(len(self.places) - 1)]
        return np.unpackbits(np.concatenate(parts), count=self.n).astype(bool) if parts else np.zeros(0, bool)

    def bit(self, i: int) -> int:
        k, i = divmod(i, SEGMENT_BITS)
        return int(self.segment(k)[i >> 3]) >> (7 - (i & 7)) & 1

    def ones(self, i: int) -> int:
        """Ones before place i: the directory, whole bytes of one segment, and the bits of one byte."""
        k, rest = divmod(i, SEGMENT_BITS)
        total = int(self.before[k])
        if rest:
            segment = self.segment(k)
            total += int(np.bitwise_count(segment[: rest >> 3]).sum())
            if rest & 7:
                total += (int(segment[rest >> 3]) >> (8 - (rest & 7))).bit_count()
        return total

    def select(self, one: int, rank: int) -> int:
        """The place of the rank-th (from 0) bit of that kind: segment by bisection, then byte, then bit."""
        before = self.before if one else np.minimum(np.arange(len(self.before)) * SEGMENT_BITS, self.n) - self.before
        k = int(np.searchsorted(before, rank, side="right")) - 1
        segment = self.segment(k) if one else ~self.segment(k)
        counts, rank = np.cumsum(np.bitwise_count(segment), dtype=np.int64), rank - int(before[k])
        byte = int(np.searchsorted(counts, rank, side="right"))
        inside = np.flatnonzero(np.unpackbits(segment[byte : byte + 1]))[rank - (int(counts[byte - 1]) if byte else 0)]
        return k * SEGMENT_BITS + byte * 8 + int(inside)


class WaveletMatrix:
    """A sequence of ids in bit-planes with rank and select."""

    def __init__(self, n: int, planes: list[Plane]) -> None:
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels, planes = max(1, int(ids.max(initial=0)).bit_length()), []
        x = ids.astype(np.uint16) if levels <= 16 else ids  # narrower numbers move faster
        for level in range(levels - 1, -1, -1):
            bit = (x & x.dtype.type(1 << level)) != 0
            planes.append(Plane.pack(bit))
            x = np.concatenate([x[~bit], x[bit]])
        return cls(len(ids), planes)

    def decode(self) -> np.ndarray:
        """All ids: the moves of the levels are undone from the last to the first."""
        narrow = np.uint16 if len(self.planes) <= 16 else np.uint32
        x = np.zeros(self.n, narrow)
        for k, plane in reversed(list(enumerate(self.planes))):
            bit, up = plane.bits(), np.empty(self.n, narrow)
            up[~bit] = x[: plane.zeros]
            up[bit] = x[plane.zeros :] | narrow(1 << (len(self.planes) - 1 - k))
            x = up
        return x.astype(ID)

    def access(self, i: int) -> int:
        value = 0
        for plane in self.planes:
            one, ones = plane.bit(i), plane.ones(i)
            value = value << 1 | one
            i = plane.zeros + ones if one else i - ones
        return value

    def _bits_of(self, token: int) -> list[int]:
        return [token >> (len(self.planes) - 1 - k) & 1 for k in range(len(self.planes))]

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for plane, one in zip(self.planes, self._bits_of(token), strict=True):
            a, b = plane.ones(low), plane.ones(high)
            low, high = (plane.zeros + a, plane.zeros + b) if one else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrences(self, token: int) -> list[int]:
        """Ascending places of a token."""
        if token >> len(self.planes):
            return []
        out, upward = [], list(zip(reversed(self.planes), reversed(self._bits_of(token)), strict=True))
        for at in range(*self._range(token, 0, self.n)):
            for plane, one in upward:
                at = plane.select(one, at - plane.zeros if one else at)
            out.append(at)
        return out


def write_shard(doc_ids: list[int], ids: list[bytes]) -> bytes:
    """The file of a shard: head, document ids, ends of documents, then a directory and segments for each plane."""
    matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), ID))
    ends = np.cumsum([len(x) // ID.itemsize for x in ids], dtype="<i8")
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(np.array(doc_ids, "<i8").tobytes()), pack(ends.tobytes())]
    for plane in matrix.planes:
        parts += [np.stack([plane.before, plane.places]).astype("<i8").tobytes(), bytes(plane.data)]
    sizes = struct.pack(f"<{len(parts)}Q", *map(len, parts))
    body = struct.pack("<QQI", matrix.n, len(doc_ids), len(matrix.planes)) + sizes + b"".join(parts)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def read_shard(content: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, ends of documents and the matrix, whose planes stay compressed; raises if the file is damaged."""
    if content[:8] != MAGIC or struct.unpack_from("<I", content, 8)[0] != zlib.crc32(memoryview(content)[12:]):
        raise ValueError("no shard, or a damaged one")
    n, docs, planes = struct.unpack_from("<QQI", content, 12)
    sizes = struct.unpack_from(f"<{2 * planes + 2}Q", content, 32)
    at, parts = 32 + 8 * len(sizes), []
    for size in sizes:
        parts.append(memoryview(content)[at : at + size])
        at += size
    unpack = zstandard.ZstdDecompressor().decompress
    matrix = WaveletMatrix(n, [Plane(n, *np.frombuffer(d, "<i8").reshape(2, -1), data) for d, data in zip(parts[2::2], parts[3::2], strict=True)])
    return np.frombuffer(unpack(parts[0]), "<i8"), np.frombuffer(unpack(parts[1]), "<i8"), matrix


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int, bytes]]:
    encoder, end = word_encoder(path), np.array([end_id], ID).tobytes()
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for start, texts in text_slices(batch, "text", SLICE_BYTES):
            for i, ids in enumerate(encoder.encode(texts), start):
                yield doc_ids[i], ids + end


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, seq, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()),
             pa.array([write_shard(doc_ids, ids)], pa.binary())], names=["part", "seq", "n_ids", "content"])

    for doc_id, data in _encoded(batches, path, end_id):
        if ids and size + len(data) // ID.itemsize > SHARD_IDS:
            yield row()
            seq, doc_ids, ids, size = seq + 1, [], [], 0
        doc_ids.append(doc_id)
        ids.append(data)
        size += len(data) // ID.itemsize
    if ids:
        yield row()


def write_shards(docs: DataFrame, path: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The shards (``part, seq`` in ascending order of documents), written to the shared folder.

    Texts are dealt to ranges of ids, not their tokens: finding the ranges samples ids
    only, and each text is encoded once, in the task that writes its shard.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), whole_text().alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # lets the rows of a repeated id be spread
    ranges = rows.repartitionByRange(max(1, -(-total // TASK_BYTES)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return cut_lineage(ranges.select("doc_id", "text").mapInArrow(lambda batches: _shards(batches, path, end_id), SHARD))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, content in zip(*(batch.column(c) for c in ("part", "seq", "content")), strict=True):
            doc_ids, ends, matrix = read_shard(content.as_py())
            ids, starts = matrix.decode(), np.concatenate(([0], ends[:-1]))
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.as_py()] * len(ends), pa.int32()) for x in (part, seq)]
                + [pa.array(x, pa.int64()) for x in (doc_ids, starts, ends - starts, crcs)],
                names=["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard: sums within a part, then over the parts (one row each)."""
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before")).join(
        parts, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    rows = shards.select("part", "seq", "content").mapInArrow(
        _digest, "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(broadcast_if_bounded(shard_starts(shards)), ["part", "seq"]).select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(read(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op7_token_store": op7_token_store}
ORACLE: dict[str, str] = {}
