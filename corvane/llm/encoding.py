"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: contiguous rank array. A word's part boundaries and the ranks of adjacent parts lie
in one short array; it is scanned for the smallest rank, that boundary is deleted, and the
two neighbouring ranks are refreshed. Long runs without a break use a heap over the same
boundaries, so no word costs more than n log n. Words repeat, so each Python worker keeps a
bounded store of encoded words; texts travel in Arrow batches.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corvane.runtime import ship_package

# Fixed value: the published split pattern of the tokenizer's vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary files lie on driver and executors, unless another folder is given.
TOKENIZERS = "/opt/tokenizers"
#: Up to this many bytes a word is merged by scanning, beyond with a heap.
SHORT = 96
#: Encoded words kept by a Python worker, some 40 MB; then the store starts anew.
KEPT_WORDS = 150_000

_NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks of a file with a base64 token and a rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word: boundaries and adjacent ranks in two parallel arrays."""
    get, n = ranks.get, len(word)
    starts = list(range(n + 1))
    pair = [get(word[i : i + 2], _NONE) for i in range(n - 1)]
    while pair:
        low = min(pair)
        if low == _NONE:
            break
        i = pair.index(low)
        del starts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[starts[i] : starts[i + 2]], _NONE)
        if i:
            pair[i - 1] = get(word[starts[i - 1] : starts[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges, with linked boundaries and a heap of ranks."""
    get, n = ranks.get, len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    rank_at = [get(word[i : i + 2], _NONE) for i in range(n - 1)] + [_NONE]
    heap = [(rank, i) for i, rank in enumerate(rank_at) if rank != _NONE]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        rank, i = heapq.heappop(heap)
        if not alive[i] or rank_at[i] != rank:
            continue
        gone = after[i]
        alive[gone] = 0
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        for j in (i, before[i]):
            if j < 0:
                continue
            end = after[after[j]] if after[j] < n else n + 1
            rank_at[j] = get(word[j:end], _NONE) if end <= n else _NONE
            if rank_at[j] != _NONE:
                heapq.heappush(heap, (rank_at[j], j))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Word to its ids, computed when first asked for."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.words = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> array:
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        merge = merge_short if len(raw) <= SHORT else merge_long
        ids = array("i", [whole] if whole is not None else merge(raw, self.ranks))
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(raw) <= SHORT:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> array:
        ids = array("i")
        if text:
            for word in self.words(text):
                ids += self[word]
        return ids


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(path)


def vocabulary_path(name: str, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def encode(rows: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids array<int>) for every row: the ids of the text, without special tokens.

    Empty and null texts give an empty list. Strings of special tokens inside a text are
    ordinary text. Repeated rows are repeated; other columns are left out. `path` must be
    readable on every executor.
    """
    ship_package(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, ends = array("i"), array("i", [0])
                for value in part.column(1):
                    ids += to_ids(value.as_py())
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(memoryview(ends)), pa.array(memoryview(ids), type=pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(rows: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, tokens int): the length of encode(), without building the lists."""
    ship_package(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path).encode
        for batch in batches:
            counts = array("i", (len(to_ids(value.as_py())) for value in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(memoryview(counts), type=pa.int32())], names=[key, "tokens"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, tokens int")
