"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

Each partition splits its texts into pre-tokens, codes every distinct pre-token once, and expands codes to ids with
array operations. The distinct pre-tokens are merged together with a pair occurrence index: every adjacent pair maps to
all its positions, the active pair of the lowest rank is merged at all of them, and only the lists of the neighbouring
pairs are updated.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import ship

#: Where the vocabulary lies; the driver reads it once and broadcasts its ranks (fixed size, below 1 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The public pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same pattern with its classes spelled out for texts of these characters only (faster engine).
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿŒœŸ", "0-9²³¹¼½¾"
_S = r"\t-\r \x85\xa0"
PLAIN_TEXT = re.compile(r"[\x00-\x1b!-\x84\x86-\xff ŒœŸ‐-―‘-‟•…€]*")
PLAIN_PATTERN = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairIndexEncoder:
    """Ids of pre-tokens by merging the pairs of a whole set of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_id = [ranks[bytes([i])] for i in range(256)]
        # pair of ids -> id of their merger: every way to cut a token in two of its own kind
        self.merge: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.merge[a, b] = rank

    def encode(self, words: list[bytes]) -> list[list[int]]:
        symbol: list[int] = []
        starts = []
        for w in words:
            starts.append(len(symbol))
            symbol += [self.byte_id[x] for x in w]
            symbol.append(-1)  # no pair reaches over it
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            pair = (symbol[i], symbol[i + 1])
            if pair in self.merge:
                where.setdefault(pair, []).append(i)
        active = [(self.merge[p], p) for p in where]
        heapq.heapify(active)
        while active:
            new, pair = heapq.heappop(active)
            places = where.pop(pair, None)
            if places is None:
                continue
            a, b = pair
            for i in sorted(places):
                j = after[i]
                if symbol[i] != a or j >= n or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = new, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if symbol[k] >= 0:
                        self._note(where, active, (new, symbol[k]), i)
                h = before[i]
                if h >= 0 and symbol[h] >= 0:
                    self._note(where, active, (symbol[h], new), h)
        out = []
        for s, w in zip(starts, words):
            ids, i, end = [], s, s + len(w)
            while i < end:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out

    def _note(self, where: dict, active: list, pair: tuple[int, int], place: int) -> None:
        if pair in self.merge:
            if pair not in where:
                where[pair] = []
                heapq.heappush(active, (self.merge[pair], pair))
            where[pair].append(place)


class Codes(dict):
    """Pre-token -> its number, given on first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class CorpusEncoder:
    """Texts to ids; keeps what it learned of a partition's pre-tokens, and starts anew at ``most`` of them."""

    def __init__(self, ranks: dict[bytes, int], most: int = 500_000):
        import regex

        self.bpe, self.any_pattern, self.most = PairIndexEncoder(ranks), regex.compile(PATTERN), most
        self._clear()

    def _clear(self) -> None:
        self.codes = Codes()
        self.ids = np.empty(0, np.int32)
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def split(self, text: str) -> list[str]:
        return (PLAIN_PATTERN if PLAIN_TEXT.fullmatch(text) else self.any_pattern).findall(text)

    def _learn(self) -> None:
        known = len(self.start)
        if len(self.codes) == known:
            return
        fresh = [w.encode("utf-8", "surrogatepass") for w in list(self.codes)[known:]]
        ids = self.bpe.encode(fresh)
        length = np.array([len(x) for x in ids], np.int64)
        self.start = np.append(self.start, len(self.ids) + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.ids = np.append(self.ids, np.array([i for x in ids for i in x], np.int32))

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.codes) > self.most:
            self._clear()
        code = self.codes.__getitem__
        parts, counts = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                parts.append(np.fromiter(map(code, self.split(t)), np.int32))
                counts[i] = len(parts[-1])
        self._learn()
        codes = np.concatenate(parts) if parts else np.empty(0, np.int32)
        length = self.length[codes]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[codes] - (ends - length), length) + np.arange(total)
        ends = np.append(0, ends)
        offsets = ends[np.append(0, np.cumsum(counts))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.ids[at], pa.int32()))


def encode_documents(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row of ``docs``: whole texts, without special tokens.

    A null and an empty text give an empty list; rows repeat as they come; other columns are not read. Batches are cut
    by text length, so very long texts do not add up in memory.
    """
    spark = ship(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(ranks.value)
        for batch in batches:
            texts = batch.column(1)
            for at in _slices(texts):
                part = texts.slice(*at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(*at), encoder.encode(part.to_pylist())], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def _slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of at most ``most`` characters, one text at least."""
    sizes = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i - start
            start, size = i, 0
        size += int(n)
    if len(sizes) > start:
        yield start, len(sizes) - start
