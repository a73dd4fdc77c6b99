"""Token counts without ids: byte-pair merging with a heap and a linked list.

A text is cut at the strings of added tokens (each is one token, as the library does by
default), the rest is split into pre-tokens, and the bytes of a pre-token are its initial
symbols. A heap holds the adjacent pairs that some merge joins, keyed by rank and place;
the pair of lowest rank is popped, the leftmost first, and skipped if a merge has changed
it meanwhile. The symbols are a linked list, so a merge looks at its two neighbours only,
and a pre-token of n bytes costs O(n log n) however long it is. The count is the number
of initial symbols less the number of merges; no ids are made. Counts of pre-tokens seen
before are taken from a table of bounded size.

The library splits by an older Unicode table than the ``regex`` module. Texts up to Latin-1
are split by an equal pattern of plain classes, other texts by the pattern itself, and
texts with characters that are new to this Python's table by the library's own splitter.

Defined results: a null text is empty and has no tokens; an empty table gives an empty
one; repeated rows are counted each; a column ``n_tokens`` of the input is replaced and all
others are carried. There is no longest text: nothing is truncated.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from tokenizers import Tokenizer

from gatewarden.llm.common import read, text_slices, whole_text

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512
#: Pre-tokens that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 64
#: Bytes of text that are counted together.
SLICE_BYTES = 1_000_000
#: Bits for a place in a pre-token and for a symbol.
PLACE, SYMBOL = 40, 24

#: Letters, numbers and white space of Latin-1.
_L, _N, _S = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN_WORD = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND_LATIN = re.compile("[^\x00-\xff]")


def byte_names() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {b: chr(b) for b in plain}
    names.update((b, chr(256 + k)) for k, b in enumerate(b for b in range(256) if b not in names))
    return [names[b] for b in range(256)]


def unassigned() -> re.Pattern:
    """Characters that this Python's Unicode table does not know."""
    spans: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]")


class Counter:
    """Merge ranks by pair of symbols, and the counts of pre-tokens seen."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized"))
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not plain or any(
                model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        vocabulary = model["vocab"]
        self.symbols = [vocabulary[name] for name in byte_names()]
        self.pairs: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocabulary[a] << SYMBOL | vocabulary[b]] = rank
            self.joined.append(vocabulary[a + b])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pattern, self.unknown = regex.compile(pattern), unassigned()
        self.latin = LATIN_WORD if pattern == public_tokenizers.PATTERN else None
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.known: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """The tokens of one pre-token."""
        n, find, joined = len(data), self.pairs.get, self.joined
        symbols = self.symbols
        part = [symbols[b] for b in data]
        heap = []
        for i in range(n - 1):
            rank = find(part[i] << SYMBOL | part[i + 1])
            if rank is not None:
                heap.append(rank << PLACE | i)
        if not heap:
            return n
        heapify(heap)
        part.append(-1)  # joins with nothing, like a symbol that was merged away
        after, before, merges, places = list(range(1, n + 1)), list(range(-1, n - 1)), 0, (1 << PLACE) - 1
        before.append(n - 1)
        while heap:
            top = heappop(heap)
            i = top & places
            left, middle = part[i], after[i]
            if left < 0 or find(left << SYMBOL | part[middle]) != top >> PLACE:
                continue  # stale
            part[i] = symbol = joined[top >> PLACE]
            part[middle] = -1
            after[i] = end = after[middle]
            before[end] = i
            merges += 1
            if end < n:
                rank = find(symbol << SYMBOL | part[end])
                if rank is not None:
                    heappush(heap, rank << PLACE | i)
            first = before[i]
            if first >= 0:
                rank = find(part[first] << SYMBOL | symbol)
                if rank is not None:
                    heappush(heap, rank << PLACE | first)
        return n - merges

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens."""
        if self.latin and (text.isascii() or not BEYOND_LATIN.search(text)):
            return self.latin.findall(text)
        if self.unknown.search(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def _words(self, words: list[str]) -> int:
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        total = 0
        for word in words:
            count = known.get(word)
            if count is None:
                count = self.merged(word.encode())
                if len(word) <= REMEMBERED_CHARS:
                    known[word] = count
            total += count
        return total

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._words(self.split(text))
        pieces = self.added.split(text)
        return len(pieces) - 1 + sum(self._words(self.split(p)) for p in pieces if p)


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """One vocabulary per worker process."""
    return Counter(path, pattern)


def count_tokens(docs: DataFrame, path: str = TOKENIZER, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """``docs`` with a column ``n_tokens``: the tokens of the whole ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern).count
        for batch in batches:
            names = [n for n in batch.schema.names if n != "n_tokens"]
            for start, texts in text_slices(batch, text, SLICE_BYTES):
                found = pa.array([count(t or "") for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(names).slice(start, len(texts)).columns, found], names=[*names, "n_tokens"])

    schema = StructType([f for f in docs.schema.fields if f.name != "n_tokens"]).add("n_tokens", LongType())
    return docs.mapInArrow(run, schema)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    return count_tokens(docs).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLE: dict[str, str] = {}
