"""Repeated passages by a distributed merge sort of suffixes that knows common prefixes.

A string of ``LENGTH`` bytes is repeated if it starts at another place too, in the same
document or another. Sorting every suffix is not needed: each such window has an anchor,
the place of the least hash of 16 bytes among its first half, which equal windows share.
The windows of an anchor are consecutive, so a suffix that begins at the anchor (and the
bytes before it) stands for all of them.

1. Texts are packed into chunks, chunks into groups. The 200 bytes that follow each anchor are hashed;
   hashes that occur once in the corpus rule their anchors out (no distinguishing prefix is sent).
2. Each group sorts its other suffixes and sends them front-coded (the length shared with
   the one before, and the rest) to ranges between splitters of a sample that grows with the ranges.
3. A loser tree merges the runs of a range. It compares lengths of known common prefixes
   and reads bytes only beyond them; each suffix comes out with the length shared with
   the one before. Neighbours tell which windows are surely repeated or surely not.
4. Windows between the two (their left and their right part have different partners) and
   those at the seams of ranges are counted by 128-bit hashes over the whole corpus.
5. The windows found return to their group; covered bytes are removed.

Buckets and ranges grow in number with the input, and each of them gets a row from every group that
meets it: groups are as large as a task can hold, so that such a row has many entries.
Equal suffixes of a group with equal bytes before them are one entry with a list of places.
A group and a bucket of hashes are bounded by bytes or entries (one document larger than a
chunk is a chunk of its own). A range is not: equal suffixes go to one range, an entry for each group
that has them and all their places.

Defined results: a null text has no bytes; texts below ``LENGTH`` bytes lose nothing;
repeated rows are repeats of each other; ids may be null or equal. Further columns are
never read.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm.common import read, whole_text
from gatewarden.session import cut_lineage

LENGTH, CORE, GRAM = 400, 200, 16
#: Bytes of text in a chunk, suffixes in a range, hashes in a bucket.
CHUNK_BYTES, RANGE_SUFFIXES, BUCKET_HASHES = 1_000_000, 20_000, 500_000
#: A group has 2 ** GROUP_BITS chunks at most; a place in it is the number of the chunk and, below PLACE_BITS, the byte.
GROUP_BITS, PLACE_BITS = 4, 40
#: The splitters come from so many groups at least and so many suffixes of each at most, and so many for each range.
SAMPLE_GROUPS, SAMPLE_SUFFIXES, RANGE_SAMPLE = 4, 600, 8

_U = np.uint64
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


#: Two hashes of strings: a number per byte value, a base and its inverse modulo 2**64.
_BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)
_VALUES = [_mix(np.arange(1, 257, dtype=np.uint64) * _U(b)) for b in _BASES]


@functools.lru_cache(maxsize=8)
def _powers(which: int, inverse: bool, bits: int) -> np.ndarray:
    base = pow(_BASES[which], -1 if inverse else 1, 1 << 64)
    out = np.ones(1 << bits, np.uint64)
    for k in range(bits):  # doubling: the second half is the first times base ** half
        half = 1 << k
        out[half : 2 * half] = out[:half] * _U(pow(base, half, 1 << 64))
    return out


def hashes(data: np.ndarray, starts: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of the strings of that length at ``starts``."""
    bits = max(10, len(data).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[which][data] * _powers(which, False, bits)[: len(data)], out=sums[1:])
    return _mix((sums[starts + length] - sums[starts]) * _powers(which, True, bits)[starts])


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of joined texts, with the first and last window of each."""
    n, none = len(data), np.empty(0, np.int64)
    if n < LENGTH:
        return none, none, none
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    eight = np.empty(n + 8, np.uint64)
    for k in range(8):
        count = (n + 8 - k + 7) // 8
        eight[k::8] = padded[k : k + 8 * count].view("<u8")
    key = eight[:n] * _U(0x9FB21C651E98DF25) ^ (eight[8:] * _U(0xA24BAED4963EE407) >> _U(7))
    key = (_mix(key) & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)  # equal hashes: the first place
    width = 1
    while 2 * width <= CORE + 1:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (CORE + 1 - width)], key[CORE + 1 - width :])
    ends = np.cumsum(sizes)
    first, count = ends - sizes, np.maximum(sizes - LENGTH + 1, 0)
    windows = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    if not len(windows):
        return none, none, none
    at = (key[windows] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1))))
    return at[new], windows[new], windows[np.append(new[1:], len(windows)) - 1]


# --- chunks -----------------------------------------------------------------------

CHUNK = "chunk long, doc_ids array<long>, sizes array<long>, data binary"


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    part, seq, ids, texts, total, filled = TaskContext.get().partitionId(), 0, [], [], 0, 0

    def following() -> int:
        """The number of the next chunk: of another group if this one has its bytes."""
        return seq + 1 if filled + total < chunk_bytes << GROUP_BITS else (seq >> GROUP_BITS) + 1 << GROUP_BITS

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
             pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(texts))], pa.binary())],
            names=["chunk", "doc_ids", "sizes", "data"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            data = text.as_py().encode()
            if texts and total + len(data) > chunk_bytes:
                yield row()
                filled, seq = filled + total, following()
                filled = filled if seq % (1 << GROUP_BITS) else 0
                ids, texts, total = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(data)
            total += len(data)
    if texts:
        yield row()


def _chunk(table: pa.Table | pa.RecordBatch, i: int = 0) -> tuple[int, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(table.column("data")[i].as_py())
    return table.column("chunk")[i].as_py(), np.frombuffer(data, np.uint8), np.array(table.column("sizes")[i].as_py(), np.int64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are in ``known``, which is sorted: each is looked up, ``known`` is not read whole."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _by_bucket(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the values that belong to each bucket."""
    bucket = (values % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(bucket[places[0]]), places


# --- 1: hashes that occur twice ----------------------------------------------------

CORES = "bucket int, grp long, hashes binary"
_CORES = pa.schema([("bucket", pa.int32()), ("grp", pa.int64()), ("hashes", pa.binary())])


def _cores(buckets: int):
    def rows(group: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(parts), return_counts=True)
        value = np.concatenate([value, value[count > 1]])  # twice is enough
        return pa.RecordBatch.from_pylist(
            [{"bucket": b, "grp": group, "hashes": value[p].tobytes()} for b, p in _by_bucket(value, buckets)], schema=_CORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, data, sizes = _chunk(batch, i)
                if parts and chunk >> GROUP_BITS != group:
                    yield rows(group, parts)
                    parts = []
                group, (at, _, _) = chunk >> GROUP_BITS, anchors(data, sizes)
                if len(at):
                    parts.append(hashes(data, at, CORE))
        if parts:
            yield rows(group, parts)

    return run


REPEATED = "grp long, n long, hashes binary"


def _repeated(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
    value, count = np.unique(np.concatenate(parts), return_counts=True)
    twice = value[count > 1]
    rows = []
    for group, part in zip(table["grp"].to_pylist(), parts, strict=True):
        found = np.unique(part[_among(part, twice)])
        if len(found):
            rows.append({"grp": group, "n": len(found), "hashes": found.tobytes()})
    return pa.Table.from_pylist(rows, schema=pa.schema([("grp", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())]))


# --- 2: sorted, front-coded runs ---------------------------------------------------

_PARTS = ("shared", "rests", "rest_sizes", "lefts", "left_sizes", "counts", "places")
RUN = "range int, grp long, " + ", ".join(f"{n} binary" for n in _PARTS)
_RUN = pa.schema([("range", pa.int32()), ("grp", pa.int64()), *((n, pa.binary()) for n in _PARTS)])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which ``known`` bytes are not read again."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 32
    while a[known : known + step] == b[known : known + step]:
        known += step
    while a[known] == b[known]:
        known += 1
    return known


def suffixes(chunks: pa.Table, found: pa.Table) -> list[tuple[bytes, bytes, list[int]]]:
    """``(right, left, places)`` of the anchors of a group whose core is repeated, in order."""
    twice, items = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in found["hashes"].to_pylist()])), []
    for i in range(chunks.num_rows):
        chunk, data, sizes = _chunk(chunks, i)
        at, first, last = anchors(data, sizes)
        good = _among(hashes(data, at, CORE), twice) if len(at) else np.zeros(0, bool)
        raw, base = data.tobytes(), chunk % (1 << GROUP_BITS) << PLACE_BITS
        items += [(raw[a : z + LENGTH], raw[f:a], base + a)
                  for a, f, z in zip(at[good].tolist(), first[good].tolist(), last[good].tolist(), strict=True)]
    items.sort()
    out, before = [], None
    for right, left, place in items:
        if (right, left) == before:
            out[-1][2].append(place)
        else:
            out.append((right, left, [place]))
            before = right, left
    return out


def _runs(splitters: list[bytes]):
    def run(key, chunks: pa.Table, found: pa.Table) -> pa.Table:
        if not chunks.num_rows or not found.num_rows:
            return _RUN.empty_table()
        items, rows, pack = suffixes(chunks, found), [], zstandard.ZstdCompressor(level=3).compress
        begin = 0
        while begin < len(items):
            where = bisect_right(splitters, items[begin][0])
            end = len(items) if where == len(splitters) else bisect_right(items, (splitters[where],), begin)
            part, last, shared, rests = items[begin:end], b"", [], []
            for right, _, _ in part:
                shared.append(common(last, right))
                rests.append(right[shared[-1] :])
                last = right
            rows.append({
                "range": where, "grp": key[0].as_py(), "shared": np.array(shared, "<u2").tobytes(),
                "rests": pack(b"".join(rests)), "rest_sizes": np.array([len(r) for r in rests], "<u2").tobytes(),
                "lefts": pack(b"".join(x[1] for x in part)), "left_sizes": np.array([len(x[1]) for x in part], "<u2").tobytes(),
                "counts": np.array([len(x[2]) for x in part], "<u4").tobytes(),
                "places": np.array([p for x in part for p in x[2]], "<i8").tobytes()})
            begin = end
        return pa.Table.from_pylist(rows, schema=_RUN)

    return run


def _sample(key, chunks: pa.Table, found: pa.Table) -> pa.Table:
    items = suffixes(chunks, found) if chunks.num_rows and found.num_rows else []
    picked = items[:: max(1, -(-len(items) // SAMPLE_SUFFIXES))]
    return pa.table({"right": pa.array([x[0] for x in picked], pa.binary())})


# --- 3: merging --------------------------------------------------------------------


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs (strings, length shared with the one before): ``run, index, shared``.

    A loser at a node knows the length it shares with the string that beat it, which is
    the last one put out when the node is visited again. Of two strings the one that
    shares more with that string is less; bytes are read only if both share as much.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    strings = [r[0] for r in runs]
    index = [0] * k
    alive = [i < len(runs) and bool(runs[i][0]) for i in range(k)]

    def play(i: int, hi: int, j: int, hj: int) -> tuple[int, int, int, int]:
        """Winner and its shared length, loser and its shared length."""
        if not alive[j]:
            return i, hi, j, -1
        if not alive[i]:
            return j, hj, i, -1
        if hi > hj:
            return i, hi, j, hj
        if hj > hi:
            return j, hj, i, hi
        a, b = strings[i][index[i]], strings[j][index[j]]
        h = common(a, b, hi)
        if h == len(a) or (h < len(b) and a[h] < b[h]):
            return i, hi, j, h
        return j, hj, i, h

    losers: list[tuple[int, int]] = [(0, -1)] * k
    level = [(i, 0) for i in range(k)]
    base = k
    while len(level) > 1:
        base //= 2
        up = []
        for m in range(base):
            w, hw, l, hl = play(*level[2 * m], *level[2 * m + 1])
            losers[base + m] = (l, hl)
            up.append((w, hw))
        level = up
    winner, shared = level[0]
    while alive[winner]:
        yield winner, index[winner], shared
        index[winner] += 1
        if index[winner] < len(strings[winner]):
            shared = runs[winner][1][index[winner]]
        else:
            alive[winner], shared = False, -1
        node = (winner + k) // 2
        while node:
            l, hl = losers[node]
            winner, shared, l, hl = play(winner, shared, l, hl)
            losers[node] = (l, hl)
            node //= 2


class Found:
    """What a range has decided: windows by group, and hashes of open windows."""

    def __init__(self) -> None:
        self.windows: dict[int, tuple[list[int], list[int]]] = {}
        self.open: list[tuple[np.ndarray, np.ndarray, int, np.ndarray, int]] = []

    def sure(self, group: int, places: list[int], before: int, after: int) -> None:
        """All windows from ``before`` bytes before each place to ``after`` bytes behind it."""
        first, last = self.windows.setdefault(group, ([], []))
        first += [p - before for p in places]
        last += [p + after for p in places]

    def ask(self, text: bytes, starts: np.ndarray, group: int, windows: np.ndarray, weight: int) -> None:
        data = np.frombuffer(text, np.uint8)
        self.open.append((hashes(data, starts, LENGTH, 0), hashes(data, starts, LENGTH, 1), group, windows, weight))


def decide(block: list[tuple[bytes, bytes, int, list[int]]], seam: bool, found: Found) -> None:
    """Decide the windows of suffixes ``(right, left, group, places)`` that share a core.

    ``x`` is how far a window begins before the anchor: it needs ``x`` equal bytes on the
    left and ``LENGTH - x`` on the right.
    """
    same: dict[tuple[bytes, bytes], list[tuple[int, list[int]]]] = {}
    for right, left, group, places in block:
        same.setdefault((right, left[::-1]), []).append((group, places))
    alone = {kind: len(members) == 1 == len(members[0][1]) for kind, members in same.items()}
    kinds = sorted(same)
    n = len(kinds)
    for right, left in kinds:
        if not alone[right, left]:
            for group, places in same[right, left]:
                found.sure(group, places, len(left), len(right) - LENGTH)
    if n == 1 and not seam:
        return
    rights = [common(a[0], b[0]) for a, b in zip(kinds, kinds[1:])]
    lefts = [common(a[1], b[1]) for a, b in zip(kinds, kinds[1:])]
    order = sorted(range(n), key=lambda i: kinds[i][1])
    most_left = [0] * n
    for i, j in zip(order, order[1:]):
        h = common(kinds[i][1], kinds[j][1])
        most_left[i], most_left[j] = max(most_left[i], h), h
    spans, undecided = [], False
    for i, (right, left) in enumerate(kinds):
        least, most = LENGTH - len(right), len(left)
        near = [k for k in (i - 1, i) if 0 <= k < n - 1]
        low = least if seam else max(least, LENGTH - max(rights[k] for k in near))
        high = most if seam else min(most, most_left[i])
        spans.append((low, high))
        if not alone[right, left]:
            continue
        sure = sorted((max(least, LENGTH - rights[k]), min(most, lefts[k])) for k in near)
        sure = [s for s in sure if s[0] <= s[1]]
        (group, places), reached = same[right, left][0], low
        for first, last in sure:
            found.sure(group, places, last, -first)
            if first <= reached:
                reached = max(reached, last + 1)
        undecided |= reached <= high
    if not undecided and not seam:
        return
    for (right, left), (low, high) in zip(kinds, spans, strict=True):
        if low <= high:
            group, places = same[right, left][0]
            x = np.arange(low, high + 1)
            found.ask(left[::-1] + right, len(left) - x, group, places[0] - x, 1 if alone[right, left] else 2)


DECIDED = "kind int, key long, a binary, b binary, c binary, d binary, e binary"
_DECIDED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), *((n, pa.binary()) for n in "abcde")])


def _merge_range(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        runs, sides, unpack = [], [], zstandard.ZstdDecompressor().decompress
        for row in table.to_pylist():
            rests, shared = unpack(row["rests"]), np.frombuffer(row["shared"], "<u2").tolist()
            strings, last, at = [], b"", 0
            for h, size in zip(shared, np.frombuffer(row["rest_sizes"], "<u2").tolist(), strict=True):
                last = last[:h] + rests[at : at + size]
                strings.append(last)
                at += size
            raw, ends = unpack(row["lefts"]), np.cumsum(np.frombuffer(row["left_sizes"], "<u2"), dtype=np.int64).tolist()
            lefts = [raw[a:b] for a, b in zip([0, *ends], ends)]
            flat, ends = np.frombuffer(row["places"], "<i8").tolist(), np.cumsum(np.frombuffer(row["counts"], "<u4"), dtype=np.int64).tolist()
            runs.append((strings, shared))
            sides.append((lefts, row["grp"], [flat[a:b] for a, b in zip([0, *ends], ends)]))
        found, block, first = Found(), [], True
        for r, i, shared in merge(runs):
            if block and shared < CORE:
                decide(block, first, found)
                block, first = [], False
            lefts, group, places = sides[r]
            block.append((runs[r][0][i], lefts[i], group, places[i]))
        if block:
            decide(block, True, found)
        rows = [{"kind": 0, "key": group, "a": np.array(first, "<i8").tobytes(), "b": np.array(last, "<i8").tobytes()}
                for group, (first, last) in found.windows.items()]
        if found.open:
            one, two = (np.concatenate([o[k] for o in found.open]) for k in (0, 1))
            counts = [len(o[0]) for o in found.open]
            group, weight = np.repeat([o[2] for o in found.open], counts), np.repeat([o[4] for o in found.open], counts)
            window = np.concatenate([o[3] for o in found.open])
            for bucket, p in _by_bucket(one, buckets):
                rows.append({"kind": 1, "key": bucket, "a": one[p].tobytes(), "b": two[p].tobytes(), "c": group[p].astype("<i8").tobytes(),
                             "d": window[p].astype("<i8").tobytes(), "e": weight[p].astype("<i8").tobytes()})
        return pa.Table.from_pylist(rows, schema=_DECIDED)

    return run


# --- 4: open windows ---------------------------------------------------------------

WINDOWS = "grp long, first binary, last binary"
_WINDOWS = pa.schema([("grp", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])


def _count(table: pa.Table) -> pa.Table:
    one, two = (np.concatenate([np.frombuffer(x, "<u8") for x in table[c].to_pylist()]) for c in "ab")
    owner, window, weight = (np.concatenate([np.frombuffer(x, "<i8") for x in table[c].to_pylist()]) for c in "cde")
    order = np.lexsort((two, one))
    new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
    group = np.cumsum(new) - 1
    good = order[np.bincount(group, weights=weight[order])[group] > 1]
    good = good[np.lexsort((window[good], owner[good]))]
    rows = []
    for places in np.split(good, np.flatnonzero(np.diff(owner[good])) + 1) if len(good) else []:
        data = window[places].astype("<i8").tobytes()
        rows.append({"grp": int(owner[places[0]]), "first": data, "last": data})
    return pa.Table.from_pylist(rows, schema=_WINDOWS)


# --- 5: removal --------------------------------------------------------------------

CLEANED = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_CLEANED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                      ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _remove(chunks: pa.Table, found: pa.Table) -> pa.Table:
    first, last = (np.concatenate([np.frombuffer(x, "<i8") for x in [b"", *found[c].to_pylist()]]) for c in ("first", "last"))
    order = np.argsort(first)
    first, last, tables = first[order], last[order], [_CLEANED.empty_table()]
    for i in range(chunks.num_rows):
        chunk, data, sizes = _chunk(chunks, i)
        base = chunk % (1 << GROUP_BITS) << PLACE_BITS
        mine = slice(*np.searchsorted(first, [base, base + (1 << PLACE_BITS)]))
        depth = np.zeros(len(data) + 1, np.int32)
        np.add.at(depth, first[mine] - base, 1)
        np.add.at(depth, last[mine] - base + LENGTH, -1)
        tables.append(_cleaned(chunks["doc_ids"][i].as_py(), data, sizes, np.cumsum(depth[:-1]) > 0))
    return pa.concat_tables(tables)


def _cleaned(doc_ids: list, data: np.ndarray, sizes: np.ndarray, gone: np.ndarray) -> pa.Table:
    ends, rows = np.cumsum(sizes), []
    for doc_id, start, end in zip(doc_ids, (ends - sizes).tolist(), ends.tolist(), strict=True):
        mine = gone[start:end]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8))).reshape(-1, 2).tolist()
        rows.append({"doc_id": doc_id, "n_bytes": end - start, "spans": [{"start": a, "end": b} for a, b in edges],
                     "kept": data[start:end][~mine].tobytes() if edges else data[start:end].tobytes()})
    return pa.Table.from_pylist(rows, schema=_CLEANED)


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, range_suffixes: int = RANGE_SUFFIXES) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row: the removed runs and the bytes left."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    chunks = cut_lineage(rows.mapInArrow(lambda batches: _pack(batches, chunk_bytes), CHUNK))
    total = chunks.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, total // (CORE // 2) // BUCKET_HASHES + 1)
    cores = chunks.select("chunk", "sizes", "data").mapInArrow(_cores(buckets), CORES)
    repeated = cut_lineage(cores.groupBy("bucket").applyInArrow(_repeated, REPEATED))
    count = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, count // range_suffixes + 1)

    grouped = chunks.withColumn("grp", F.shiftright("chunk", GROUP_BITS))
    light, by_group = grouped.select("grp", "chunk", "sizes", "data"), repeated.groupBy("grp")
    sampled = max(SAMPLE_GROUPS, -(-ranges * RANGE_SAMPLE // SAMPLE_SUFFIXES))
    few = repeated.select("grp").distinct().orderBy(F.xxhash64("grp")).limit(sampled)
    some = light.join(F.broadcast(few), "grp", "left_semi").groupBy("grp").cogroup(
        repeated.join(F.broadcast(few), "grp", "left_semi").groupBy("grp"))
    picked = sorted(r.right for r in some.applyInArrow(_sample, "right binary").collect()) if ranges > 1 else []
    splitters = sorted({bytes(picked[len(picked) * i // ranges]) for i in range(1, ranges)}) if picked else []

    runs = light.groupBy("grp").cogroup(by_group).applyInArrow(_runs(splitters), RUN)
    decided = cut_lineage(runs.groupBy("range").applyInArrow(_merge_range(buckets), DECIDED))
    counted = decided.where("kind = 1").drop("kind").groupBy("key").applyInArrow(_count, WINDOWS)
    found = decided.where("kind = 0").select(F.col("key").alias("grp"), F.col("a").alias("first"), F.col("b").alias("last")).unionByName(counted)
    return grouped.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(_remove, CLEANED)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    # a cut may part the bytes of a character: the shown text has a replacement there, the digest is of the bytes
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"),
                          F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE: dict[str, str] = {}
