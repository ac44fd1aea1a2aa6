"""Problem 9: evaluation passages inside a training corpus, by latent semantic retrieval and ordered-match checks.

1. Every text becomes the positions of the evaluation set's own words (a bounded vocabulary; other words only hold
   their place). Written once, read by the later passes.
2. Document frequencies and a randomised range finder ``Y = AᵀA·Ω`` of the TF-IDF matrix of all passages are summed
   over the partitions; ``svd(Y)`` spans the leading right singular vectors. Both are kept per language of the items (a
   passage belongs to the language most of its words are from), else a rare language would lie flat in the space.
3. Each passage is projected and compared with all passages of the evaluation items of every language it has enough words
   of, so a quotation in another language than the text around it counts too; what exceeds ``min_cosine`` is a candidate,
   without any cap. The items are the stated query set, taken in blocks of bounded size against all passages.
4. Candidates are checked by a weighted ordered alignment (a longest common subsequence whose words count by rarity,
   with gap costs and one cheap jump over an interruption). Items without answers (as in the test tables) are passages and
   nothing more; where ``item_answer`` names a column, a paraphrase (not a literal chain) must hold the answer's words too.
5. Neither similarity nor rarity can drop a passage: wherever ``span`` blocks share as many word triples with an item as
   ``min_words`` words in that few pieces must, the longest chain of matched words (few rewordings and interruptions)
   decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.text import words
from lexweave.session import ship, staged

BLOCK = 16  # tokens; a passage is two adjacent blocks


@dataclass(frozen=True)
class Params:
    """rank: latent dimensions. min_cosine: least similarity of a candidate passage. min_words: words of the item that
    must be matched in order. min_score: least alignment score a leak has (a rare word counts 10). rewordings,
    interruptions: most words of the item left out and most interruptions in a chain of matched words that needs no score
    (``chained``); span: blocks it lies within. language_words: words of a language that a passage needs to be compared with
    its items. block_words: words of the items that are searched for at once, which bounds all that is broadcast."""

    rank: int = 160
    extra: int = 16
    min_cosine: float = 0.52
    min_words: int = 20
    min_score: int = 100
    rewordings: int = 2
    interruptions: int = 1
    span: int = 7
    sketch_block: int = 64
    seed: int = 11
    language_words: int = 12
    block_words: int = 400_000


@dataclass
class Items:
    """The evaluation set as word ids (its size is what bounds everything that is broadcast here)."""

    keys: list
    tokens: list[np.ndarray]
    vocabulary: dict[str, int] = field(default_factory=dict)
    lang: np.ndarray | None = None  # language of each item
    member: np.ndarray | None = None  # languages x words (and a zero for -1): words that items of the language have
    answers: list[np.ndarray] = field(default_factory=list)  # words of each item's answer, none for an item without one

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        """From (key, text, language[, answer]) rows; rows without a key or words are no items."""
        voc: dict[str, int] = {}
        keys, tokens, langs, answers = [], [], [], []
        for key, text, lang, *answer in sorted(rows, key=str):
            ids = [voc.setdefault(w, len(voc)) for w in words(text or "")]
            if key is not None and ids:
                keys.append(key)
                tokens.append(np.array(ids, np.int32))
                langs.append(lang or "")
                answers.append(np.array([voc.setdefault(w, len(voc)) for x in answer for w in words(x or "")], np.int32))
        names = sorted(set(langs))
        lang = np.array([names.index(x) for x in langs], np.int64)
        member = np.zeros((len(names), len(voc) + 1), np.float32)
        for n, t in zip(lang, tokens):
            member[n, t] = 1
        return Items(keys, tokens, voc, lang, member, answers)

    def language_of(self, ids: np.ndarray) -> np.ndarray:
        """Language of each row of word ids."""
        return self.member[:, ids].sum(2).argmax(0)


def dtype_of(items: Items) -> str:
    return "<i2" if len(items.vocabulary) < 32_000 else "<i4"


def tokenized(docs: DataFrame, items: Items, key: str, text: str) -> DataFrame:
    """(key, ids): ids are the little-endian word ids of the whole text, -1 for words no item has."""
    sc = docs.sparkSession.sparkContext
    voc = sc.broadcast(items.vocabulary)
    kind = dtype_of(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = voc.value.get
        for batch in batches:
            ids = [np.array([get(w, -1) for w in words(t)], kind).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("key").isNotNull() & (F.col("text") != ""))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids binary")


def blocks_of(texts: list[np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with -1 to whole blocks: (blocks x block ids, first block of each text and the end)."""
    counts = np.array([max(1, -(-len(t) // block)) for t in texts], np.int64)
    first = np.append(0, np.cumsum(counts))
    flat = np.full(int(first[-1]) * block, -1, np.int32)
    for t, f in zip(texts, first):
        flat[f * block : f * block + len(t)] = t
    return flat.reshape(-1, block), first


def _arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    size = pa.compute.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(size):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(size) > start:
        yield batch.slice(start, len(size) - start)


def _summed(tokens: DataFrame, shape: tuple[int, int], kind: str, partial, fan_in: int = 32) -> np.ndarray:
    """Sum over all rows of ``partial(texts)``, an array of the given (bounded) shape.

    Partials are as many as there are cores, whatever the data (input partitions are read one after another by a task, not
    shuffled), and are added by a tree of ``fan_in``; the driver gets one array.
    """

    def total_of(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in arrays:
            total += x
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total_of(partial(_arrays(part.column("ids"), kind)) for batch in batches for part in _slices(batch))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total_of(np.frombuffer(x, np.float32).reshape(shape) for batch in batches for x in batch.column(0).to_pylist())

    n = max(1, min(tokens.rdd.getNumPartitions(), 2 * tokens.sparkSession.sparkContext.defaultParallelism))
    parts = tokens.select("ids").coalesce(n).mapInArrow(run, "part binary")
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(add, "part binary")
    total = np.zeros(shape)
    for r in parts.toLocalIterator():
        total += np.frombuffer(r.part, np.float32).reshape(shape)
    return total


def weights(tokens: DataFrame, items: Items, kind: str, block: int) -> np.ndarray:
    """idf of every word over the passages of all documents, in the language where it is most common."""
    size, langs = len(items.vocabulary), len(items.member)

    def partial(texts: list[np.ndarray]) -> np.ndarray:
        ids, _ = blocks_of(texts, block)
        of = items.language_of(ids)
        s = np.sort(ids, 1)
        new = np.ones(s.shape, bool)
        new[:, 1:] = s[:, 1:] != s[:, :-1]
        code = (s + 1 + of[:, None] * (size + 1))[new]
        counts = np.bincount(code, minlength=langs * (size + 1)).astype(float).reshape(langs, size + 1)
        counts[:, 0] = np.bincount(of, minlength=langs)
        return counts

    total = _summed(tokens, (langs, size + 1), kind, partial)
    idf = np.log((total[:, :1] + 1) / (total[:, 1:] + 1))
    return np.where(items.member[:, :size] > 0, idf, np.inf).min(0)


def right_bases(tokens: DataFrame, items: Items, idf: np.ndarray, kind: str, p: Params) -> np.ndarray:
    """Per language an orthonormal words x rank basis of the leading right singular vectors of its passage matrix."""
    size, langs = len(idf), len(items.member)
    width = min(size, p.rank + p.extra)
    omega = np.random.default_rng(p.seed).standard_normal((size, width)).astype(np.float32)
    weight = idf.astype(np.float32)

    def partial(texts: list[np.ndarray]) -> np.ndarray:
        ids, _ = blocks_of(texts, p.sketch_block)
        of = items.language_of(ids)
        total = np.zeros((langs, size, width))
        for lang in range(langs):
            mine = ids[of == lang]
            for i in range(0, len(mine), 2048):
                part = mine[i : i + 2048]
                flat = part + 1 + (np.arange(len(part)) * (size + 1))[:, None]
                a = np.bincount(flat.ravel(), minlength=len(part) * (size + 1)).reshape(len(part), size + 1)[:, 1:].astype(np.float32) * weight
                a /= np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-6)
                total[lang] += a.T @ (a @ omega)
        return total.reshape(langs * size, width)

    y = _summed(tokens, (langs * size, width), kind, partial).reshape(langs, size, width)
    return np.stack([np.linalg.svd(x, full_matrices=False)[0][:, : p.rank] for x in y]).astype(np.float32)


def align(doc: np.ndarray, item: np.ndarray, gain: np.ndarray, gap: int = 4, jump: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignments of pairs: (score, matched words). doc is pairs x n, item pairs x m, padded with -1 and -2.

    A matched word scores its gain; a replaced one costs 6, a left-out one ``gap``, and any run of words in the
    document costs at most ``jump``. Score and matches share a 64-bit integer, so one maximum carries both.
    """
    pairs, n = doc.shape
    unit = 1 << 24
    ramp = np.arange(n, dtype=np.int64) * (gap * unit)
    row = np.zeros((pairs, n), np.int64)
    best = np.zeros(pairs, np.int64)
    for i in range(item.shape[1]):
        w = item[:, i : i + 1]
        hit = doc == w
        step = np.where(hit, gain[w].astype(np.int64) * unit + 1, -6 * unit)
        diag = np.empty_like(row)
        diag[:, 0] = 0
        diag[:, 1:] = row[:, :-1]
        new = np.maximum(diag + step, row - gap * unit)
        np.maximum(new, 0, out=new)
        slid = np.maximum.accumulate(new + ramp, 1) - ramp
        far = np.maximum.accumulate(new, 1) - jump * unit
        row = np.maximum(np.maximum(slid, far), 0)
        np.maximum(best, new.max(1), out=best)
    return best // unit, best % unit


def align_score(doc: np.ndarray, item: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The scores of ``align`` (gap 4, jump 24) alone, exactly, in 16 bits where they fit, else in 32.

    ``doc`` has a multiple of 8 columns; the pairs lie along the contiguous axis, so that every step runs over all of them at
    once. A run of up to 7 words is left out by shifts of 1, 2 and 4 places. One of 8 or more ends in a later block of 8, which
    gets the best of the blocks before it less the jump; so does one of 7, but for that from a block's first place to its last.
    """
    gap, jump = 4, 24
    pairs, n = doc.shape
    doc, item = np.ascontiguousarray(doc.T), np.ascontiguousarray(item.T)
    kind = np.int16 if (len(item) + 1) * int(gain.max(initial=1)) < 32_000 else np.int32
    row, best = np.zeros((n, pairs), kind), np.zeros(pairs, kind)
    gain = gain.astype(kind)
    gap_, jump_, miss = kind(gap), kind(jump), kind(-6)
    reach = [(k, kind(gap * k)) for k in (1, 2, 4)]
    step, new, held, hit = np.empty_like(row), np.empty_like(row), np.empty_like(row), np.empty(row.shape, bool)
    for w in item:
        np.equal(doc, w, out=hit)
        np.multiply(hit, gain[w] - miss, out=step)
        step += miss
        new[0] = step[0]
        np.add(row[:-1], step[1:], out=new[1:])
        np.subtract(row, gap_, out=held)
        np.maximum(new, held, out=new)
        np.maximum(new, 0, out=new)
        tops = new.reshape(-1, 8, pairs).max(1)
        np.maximum(best, tops.max(0), out=best)
        across = new[::8] - jump_
        for k, cost in reach:
            np.subtract(new[:-k], cost, out=held[:-k])
            np.maximum(new[k:], held[:-k], out=new[k:])
        np.maximum(new[7::8], across, out=new[7::8])
        far = np.maximum.accumulate(tops, 0)[:-1] - jump_
        later = new.reshape(-1, 8, pairs)[1:]
        np.maximum(later, far[:, None, :], out=later)
        row, new = new, row
    return best


def chained(doc: np.ndarray, item: np.ndarray, rewordings: int, interruptions: int) -> np.ndarray:
    """Most words of each pair matched in order, every word counting one. doc and item as in ``align``.

    Between two matches there may be up to 3 other words of the document, at an interruption up to 31, and words of the item
    may be left out. ``rewordings`` bounds the words of the item left out in all (at least one where there is no
    interruption), so what remains is nearly all of a stretch of the item, not the frame that sentences have in common.
    """
    pairs, n = doc.shape
    doc, item = np.ascontiguousarray(doc.T), np.ascontiguousarray(item.T)
    kind = np.uint8 if len(item) < 255 else np.int32
    row = np.zeros((interruptions + 1, rewordings + 1, n, pairs), kind)
    best = np.zeros(pairs, kind)
    near: list[np.ndarray] = []  # best end of a chain in the 4 (far: 32) places up to each, of the last words of the item
    far: list[np.ndarray] = []
    for w in item:
        new = np.zeros_like(row)
        new[:, :, 1:] = row[:, :, :-1]
        for left, x in enumerate(reversed(near)):
            r = max(1, left)
            np.maximum(new[:, r:, 1:], x[:, :-r, :-1], out=new[:, r:, 1:])
        for left, x in enumerate(reversed(far)):
            np.maximum(new[1:, left:, 1:], x[:-1, : rewordings + 1 - left, :-1], out=new[1:, left:, 1:])
        new += kind(1)
        new *= doc == w
        np.maximum(best, new[-1, -1].max(0), out=best)
        reach = new.copy()
        for k in (1, 2, 4, 8, 16):
            reach[:, :, k:] = np.maximum(reach[:, :, k:], reach[:, :, :-k])
            if k == 2:
                near = [*near, reach.copy()][-rewordings - 1 :]
        far = [*far, reach][-rewordings - 1 :]
        row = new
    return best


class Searcher:
    """Projects passages, finds candidates, and checks them; made on each worker from what is broadcast."""

    def __init__(self, items: Items, idf: np.ndarray, bases: np.ndarray, p: Params):
        self.items, self.p = items, p
        scaled = bases * idf[None, :, None].astype(np.float32)
        self.tables = np.concatenate([scaled, np.zeros((len(bases), 1, bases.shape[2]), np.float32)], 1)  # zeros for -1
        self.gain = np.append(np.clip(np.round(idf * 10 / 3.0), 1, 10).astype(np.int32), [0, 0])
        self.passages, self.owner = [], []
        for lang, table in enumerate(self.tables):
            rows, owner = [], []
            for k in np.flatnonzero(items.lang == lang):
                t = items.tokens[k]
                for s in range(0, max(1, len(t) - BLOCK), BLOCK // 2):
                    part = t[s : s + 2 * BLOCK]
                    rows.append(np.pad(part, (0, 2 * BLOCK - len(part)), constant_values=-1))
                    owner.append(k)
            v = table[np.array(rows, np.int32).reshape(-1, 2 * BLOCK)].sum(1)
            self.passages.append((v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-6)).T.copy())
            self.owner.append(np.array(owner, np.int64))
        size = len(items.vocabulary)
        codes = [np.unique(self._triples(t.astype(np.int64), size)) for t in items.tokens]
        code, of = np.concatenate([*codes, np.empty(0, np.int64)]), np.repeat(np.arange(len(codes)), [len(x) for x in codes])
        order = np.argsort(code, kind="stable")
        self.triples, self.triple_at, self.triple_n = np.unique(code[order], return_index=True, return_counts=True)
        self.triple_owner = of[order]

    @staticmethod
    def _triples(t: np.ndarray, size: int) -> np.ndarray:
        return (t[:-2] * size + t[1:-1]) * size + t[2:]

    def alike(self, ids: np.ndarray, cells: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
        """(block, item) where the ``span`` blocks from there on share enough word triples with the item: a chain of m words
        in k pieces has m - 2k at least. Blocks of the next text count too; that only adds candidates."""
        n, p = len(self.items.keys), self.p
        least = max(1, p.min_words - 2 * (p.rewordings + p.interruptions + 1))
        found = [np.empty(0, np.int64)]
        if not len(self.triples):
            return found[0], found[0]
        step = max(8, cells // n)
        for lo in range(0, len(ids), step):
            part = ids[lo : lo + step + p.span]
            flat = part.ravel().astype(np.int64)
            code = self._triples(flat, len(self.items.vocabulary))
            at = np.minimum(np.searchsorted(self.triples, code), len(self.triples) - 1)
            pos = np.flatnonzero((self.triples[at] == code) & (flat[:-2] >= 0) & (flat[1:-1] >= 0) & (flat[2:] >= 0))
            many = self.triple_n[at[pos]]
            nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            owner = self.triple_owner[np.repeat(self.triple_at[at[pos]], many) + nth]
            rows = len(part) + p.span - 1
            count = np.bincount(np.repeat(pos // BLOCK * n, many) + owner, minlength=rows * n).reshape(rows, n).astype(np.int16)
            total = count[: len(part)].copy()
            for k in range(1, p.span):
                total += count[k : k + len(part)]
            r, c = np.nonzero(total[:step] >= least)
            found.append((r + lo) * n + c)
        code = np.concatenate(found)
        return code // n, code % n

    def candidates(self, ids: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(block, item) with a passage (the block and the next) that is like a passage of the item."""
        n = len(self.items.keys)
        after = np.vstack([ids[1:], np.full((1, ids.shape[1]), -1, ids.dtype)])
        has = self.items.member[:, ids].sum(2)
        has[:, :-1] += has[:, 1:].copy()
        of = has.argmax(0)
        found = [np.empty(0, np.int64)]
        for lang, table in enumerate(self.tables):
            mine = np.flatnonzero(((of == lang) & (has[lang] > 0)) | (has[lang] >= self.p.language_words))
            for i in range(0, len(mine), chunk):
                at = mine[i : i + chunk]
                here = table[ids[at]].sum(1)
                there = np.empty_like(here)
                run = np.flatnonzero(at[1:] == at[:-1] + 1)  # the next block is a row of this chunk
                there[run] = here[run + 1]
                rest = np.setdiff1d(np.arange(len(at)), run, assume_unique=True)
                there[rest] = table[after[at[rest]]].sum(1)
                here += there
                here /= np.maximum(np.sqrt((here * here).sum(1, keepdims=True)), 1e-6)
                r, c = np.nonzero(here @ self.passages[lang] >= self.p.min_cosine)
                found.append(np.unique(at[r] * n + self.owner[lang][c]))
        code = np.concatenate(found)
        return code // n, code % n

    def leaks(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item, score, words) of every pair that holds."""
        if not self.items.keys or not texts:
            return []
        ids, first = blocks_of(texts, BLOCK)
        out = self._aligned(ids, first)
        for key, (score, matched) in self._chained(ids, first, out).items():
            s, m = out.get(key, (0, 0))
            out[key] = (max(s, score), max(m, matched))
        return [(t, k, s, m) for (t, k), (s, m) in out.items()]

    def _aligned(self, ids: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        block, item = self.candidates(ids)
        if not len(block):
            return {}
        text = np.searchsorted(first, block, "right") - 1
        # Candidates of one pair that lie near each other are one region; the region gets the item's length around it.
        order = np.lexsort((block, item, text))
        text, item, block = text[order], item[order], block[order]
        near = 6
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (block[1:] - block[:-1] > near)
        at = np.flatnonzero(new)
        last = block[np.append(at[1:] - 1, len(block) - 1)]
        text, item, start = text[at], item[at], block[at]
        reach = np.array([-(-len(t) // BLOCK) for t in self.items.tokens])[item]
        lo = np.maximum(first[text], start - reach - 2)
        hi = np.minimum(first[text + 1], last + 2 + reach + 2)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for group in self._groups(hi - lo, np.array([len(t) for t in self.items.tokens])[item]):
            doc, query = self._padded(ids, lo[group], hi[group], item[group])
            small = len(self.gain) < 32_000
            likely = align_score(doc.astype(np.int16) if small else doc, query.astype(np.int16) if small else query, self.gain) >= self.p.min_score
            group, doc, query = group[likely], doc[likely], query[likely]  # nearly all candidates end here
            if not len(group):
                continue
            score, matched = align(doc, query, self.gain)
            for r, s, m in zip(group, score, matched):
                if m >= self.p.min_words and s >= self.p.min_score and self._answered(ids[lo[r] : hi[r]], int(item[r])):
                    key = (int(text[r]), int(item[r]))
                    out[key] = max(out.get(key, (0, 0)), (int(s), int(m)))
        return out

    def _answered(self, ids: np.ndarray, item: int) -> bool:
        """The region holds all words of the item's answer, or the item has none."""
        answer = self.items.answers[item] if self.items.answers else ()
        return len(answer) == 0 or bool(np.isin(answer, ids).all())

    def _chained(self, ids: np.ndarray, first: np.ndarray, known: dict) -> dict[tuple[int, int], tuple[int, int]]:
        block, item = self.alike(ids)
        text = np.searchsorted(first, block, "right") - 1
        n = len(self.items.keys)
        rest = ~np.isin(text * n + item, [t * n + k for t, k in known])
        text, item, block = text[rest], item[rest], block[rest]
        if not len(block):
            return {}
        order = np.lexsort((block, item, text))
        text, item, block = text[order], item[order], block[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (block[1:] - block[:-1] > 1)
        at = np.flatnonzero(new)
        last = block[np.append(at[1:] - 1, len(block) - 1)]
        text, item, lo = text[at], item[at], block[at]
        hi = np.minimum(first[text + 1], last + self.p.span)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for group in self._groups(hi - lo, np.array([len(t) for t in self.items.tokens])[item], 10_000):
            doc, query = self._padded(ids, lo[group], hi[group], item[group])
            matched = chained(doc, query, self.p.rewordings, self.p.interruptions)
            holds = matched >= self.p.min_words
            if holds.any():
                score, _ = align(doc[holds], query[holds], self.gain)
                for r, s, m in zip(group[holds], score, matched[holds]):
                    key = (int(text[r]), int(item[r]))
                    out[key] = max(out.get(key, (0, 0)), (int(s), int(m)))
        return out

    def _padded(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks and items of a group as the rows that alignments take."""
        doc = np.full((len(lo), int((hi - lo).max()) * BLOCK), -1, np.int32)
        query = np.full((len(lo), max(len(self.items.tokens[k]) for k in item)), -2, np.int32)
        for g, (a, b, k) in enumerate(zip(lo, hi, item)):
            part = ids[a:b].ravel()
            doc[g, : len(part)] = part
            query[g, : len(self.items.tokens[k])] = self.items.tokens[k]
        return doc, query

    @staticmethod
    def _groups(size: np.ndarray, length: np.ndarray, cells: int = 60_000) -> Iterator[np.ndarray]:
        """Pairs of like size together, so that padding is small."""
        order = np.lexsort((length, size))
        start = 0
        for i in range(1, len(order) + 1):
            if i == len(order) or (i - start + 1) * size[order[i]] * BLOCK > cells:
                yield order[start:i]
                start = i


def _blocks(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Item rows in blocks of at most ``most`` words (one longer item alone)."""
    block, held = [], 0
    for row in rows:
        n = len(words(row[1] or ""))
        if block and held + n > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += n
    if block:
        yield block


def leaked(
    docs: DataFrame, items_df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", item_lang: str = "lang", item_answer: str | None = None
) -> DataFrame:
    """(doc_id, item_id, score, words) of every document that holds a passage of an item, one row per pair.

    Null or empty texts and null keys give none; rows repeated under one key count once. ``items_df`` is the evaluation
    set, read in the order of its keys, ``p.block_words`` words at a time; each block is searched for in all documents, so what
    is broadcast has a bound whatever the set's size.
    """
    spark = ship(docs.sparkSession)
    columns = [F.col(item_key).alias("k"), F.col(item_text).alias("t"), (F.col(item_lang).cast("string") if item_lang in items_df.columns else F.lit("")).alias("l")]
    if item_answer:
        columns.append(F.col(item_answer).cast("string").alias("a"))
    kinds = [docs.schema[key].dataType.simpleString(), items_df.schema[item_key].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score int, words int"
    out = None
    for block in _blocks((tuple(r) for r in items_df.select(*columns).distinct().orderBy("k", "t").toLocalIterator()), p.block_words):
        items = Items.of(block)
        if items.keys:
            found = _leaked(docs, items, p, key, text, schema, kinds)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("words").alias("words"))


def _leaked(docs: DataFrame, items: Items, p: Params, key: str, text: str, schema: str, kinds: list[str]) -> DataFrame:
    """Rows of ``leaked`` for one block of items, repeated where a document's row is."""
    kind = dtype_of(items)
    tokens = staged(tokenized(docs, items, key, text), "tokens")
    idf = weights(tokens, items, kind, 2 * BLOCK)
    shared = docs.sparkSession.sparkContext.broadcast((items, idf, right_bases(tokens, items, idf, kind, p)))
    out_types = [pa.int64() if k == "bigint" else pa.string() if k == "string" else pa.int32() for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = None
        for batch in batches:
            searcher = searcher or Searcher(*shared.value, p)
            for part in _slices(batch):
                found = searcher.leaks(_arrays(part.column("ids"), kind))
                if found:
                    keys = part.column("key").to_pylist()
                    t, k, s, m = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[x] for x in t], out_types[0]), pa.array([searcher.items.keys[x] for x in k], out_types[1]), pa.array(s, pa.int32()), pa.array(m, pa.int32())],
                        names=["doc_id", "item_id", "score", "words"],
                    )

    return tokens.mapInArrow(run, schema)
