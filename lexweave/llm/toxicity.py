"""Problem 10: scores for abusive, hateful or sexual text, by a chain of linear classifiers.

The unit that is scored is the sentence; a document counts as its worst one. Words are undisguised first (look-alike
and invisible characters, digits for letters, spaced, starred and stretched spelling), then words, pairs and skipped pairs
are hashed. Beside them a sentence has a few dense features: how common its words and pairs are in the whole corpus
(document frequencies over all rows) and its length; what nobody else writes is what the raters' marks then tell apart.

No word list says what is abusive. Raters mark documents, so the sentence that earns a mark is found by rounds of
multiple-instance training that start from the odds of its features against the corpus. The marked sentences are then told
apart into ``KINDS`` latent categories by clustering. The chain predicts the categories one after another and, last,
``toxic``; each later model also sees the probabilities of the earlier ones, which in training are out-of-fold predictions.

Only the labelled rows are gathered, up to ``max_labelled`` documents (the least hashes of doc_id); models have a fixed
size whatever the corpus. Every document is scored, whole. With fewer than ``min_marked`` marked or unmarked documents there
is no model: all scores are null and a warning says so.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.text import clean
from lexweave.session import ship, staged

BITS = 18
SIZE = 1 << BITS
KINDS = 4  # latent categories of marked sentences, before ``toxic``
CATEGORIES = [*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"]
_LEET = str.maketrans("0134578", "oieastb")
_STAR = re.compile(r"(?<![\w*])[^\W\d_]\*+[^\W\d_]*(?![\w*])")
_SPACED = re.compile(r"(?<![\w.])[^\W\d_](?: [^\W\d_]){2,}(?!\w)")
_TOKEN = re.compile(r"[^\W_]+|[.!?\n\r]")
_RUN = re.compile(r"(.)\1+")


def _join(m: re.Match) -> str:
    return m.group().replace(" ", "")


def split_words(text: str) -> list[str]:
    """Small-letter tokens and sentence ends of a text, with starred and spaced words made one token."""
    text = clean(text).lower()
    if "*" in text:
        text = _STAR.sub(" xstarx ", text)
    if _SPACED.search(text):
        text = _SPACED.sub(_join, text)
    return _TOKEN.findall(text)


def plain_form(word: str) -> str:
    """The undisguised form of one token: digits among letters as letters, no accents, runs of a letter as one."""
    if word.isdigit():
        return "#"
    if not word.isalpha():
        word = word.translate(_LEET)
    if not word.isascii():
        word = "".join(ch for ch in unicodedata.normalize("NFD", word) if not unicodedata.combining(ch))
    return _RUN.sub(r"\1", word)


class Hashes(dict):
    """Token -> 31-bit hash of its plain form; -1 for the end of a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = -1 if word in ".!?\n\r" else zlib.crc32(plain_form(word).encode()) & 0x7FFFFFFF
        return h


def hashes_of(texts: list[str | None], cache: Hashes) -> list[np.ndarray]:
    get = cache.__getitem__
    return [np.fromiter(map(get, split_words(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]


def features(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, pair, skipped pair) buckets at every token; pairs over a sentence's end and the end itself are SIZE (none)."""
    end, t = tokens < 0, tokens.astype(np.uint32)
    shift = np.uint32(32 - BITS)
    word = np.where(end, SIZE, (t * np.uint32(2_654_435_761)) >> shift).astype(np.int32)
    pair, skip = np.full(len(t), SIZE, np.int32), np.full(len(t), SIZE, np.int32)
    a, b = t * np.uint32(2_246_822_519), t * np.uint32(3_266_489_917)
    pair[:-1] = np.where(end[:-1] | end[1:], SIZE, ((a[:-1] ^ (b[1:] >> np.uint32(3))) * np.uint32(668_265_263)) >> shift)
    skip[:-2] = np.where(end[:-2] | end[1:-1] | end[2:], SIZE, ((b[:-2] ^ (a[2:] >> np.uint32(5))) * np.uint32(374_761_393)) >> shift)
    return word, pair, skip


def sentences(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens in a row with an end after each text, the starts of their sentences, and the text of each sentence."""
    end = np.array([-1], np.int32)
    flat = np.concatenate([x for t in texts for x in (t, end)]) if texts else np.empty(0, np.int32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    ends = np.flatnonzero(flat < 0)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else np.empty(0, np.int64)
    full = ends > starts
    return flat, starts[full], owner[starts[full]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def document_counts(texts: list[np.ndarray]) -> np.ndarray:
    """In how many of the texts each bucket occurs; the last entry is the number of texts."""
    flat, _, _ = sentences(texts)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 1 for t in texts]) * (SIZE + 1)
    codes = _distinct(np.concatenate([text + f for f in features(flat)])) if len(flat) else np.empty(0, np.int64)
    counts = np.bincount(codes % (SIZE + 1), minlength=SIZE + 1)
    counts[SIZE] = len(texts)
    return counts


def _common(buckets: tuple, starts: np.ndarray, flat: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Per sentence the mean log share of documents that have its words, its pairs and its skipped pairs; its words (to 12)."""
    out = []
    for f in buckets:
        there = np.add.reduceat((f < SIZE).astype(np.float32), starts)
        out.append(np.add.reduceat(share[f], starts) / np.maximum(there, 1))
    return np.column_stack([*out, np.minimum(np.add.reduceat((flat >= 0).astype(np.float32), starts), 12)])


def _dense(z: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((z - mean) / spread, -4, 4)
    return np.column_stack([z, z[:, :3] * z[:, 3:], z[:, 0] ** 2 / 4])


def log_share(counts: np.ndarray) -> np.ndarray:
    """Log share of documents per bucket from ``document_counts``; 0 for none."""
    return np.append(np.log((counts[:SIZE] + 0.5) / (counts[SIZE] + 1)), 0).astype(np.float32)


@dataclass
class Model:
    """Chain of linear models: per category weights of buckets (the last row is none), of dense features and of earlier
    categories, and a bias; ``quality`` holds (category, marked, found, both) out of fold."""

    weight: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    share: np.ndarray
    threshold: float
    quality: list = field(default_factory=list)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Probabilities per text and category: those of its worst sentence in that category; 0 without words."""
        out = np.zeros((len(texts), len(self.bias)))
        flat, starts, owner = sentences(texts)
        if len(starts):
            buckets = features(flat)
            sums = self.weight[buckets[0]]
            for f in buckets[1:]:
                sums += self.weight[f]
            sums = np.add.reduceat(sums, starts, 0) + _dense(_common(buckets, starts, flat, self.share), self.mean, self.spread) @ self.dense.T + self.bias
            p = np.empty_like(sums)
            for k in range(sums.shape[1]):
                p[:, k] = _sigmoid(sums[:, k] + p[:, :k] @ self.chain[k, :k])
            np.maximum.at(out, owner, p)
        return out


@dataclass
class _Rows:
    """Sparse 0/1 rows: columns, and the (ascending) row of each."""

    cols: np.ndarray
    row: np.ndarray
    n: int

    def __post_init__(self) -> None:
        self.starts = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1])) if len(self.row) else np.empty(0, np.int64)
        self.filled = self.row[self.starts]

    def take(self, rows: np.ndarray) -> _Rows:
        new = np.full(self.n, -1, np.int64)
        new[rows] = np.arange(len(rows))
        keep = new[self.row] >= 0
        return _Rows(self.cols[keep], new[self.row[keep]], len(rows))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.starts):
            out[self.filled] = np.add.reduceat(w[self.cols], self.starts)
        return out


def _fit(x: _Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, prior: tuple[np.ndarray, float] | None = None, rounds: int = 25, l2: float = 1.0) -> tuple[np.ndarray, float, np.ndarray]:
    """Weighted logistic regression by accelerated gradient steps scaled per feature. ``prior`` (weights of the first columns
    of ``extra``, bias) is where it starts from and what it is drawn to."""
    w, u, b = np.zeros(width), np.zeros(extra.shape[1]), 0.0
    if prior is not None:
        u[: len(prior[0])], b = prior
    middle, pull = u.copy(), 0.1 if prior is None else 2.0
    curve = 0.25 * np.bincount(x.cols, weight[x.row], width) + l2
    fan = max(1.0, float(np.bincount(x.row, minlength=x.n).max(initial=1)))
    step, step_b = 2.0 / (curve * min(fan, 24.0)), 2.0 / (0.25 * weight.sum() + 1e-9)
    step_u = 1.0 / (0.25 * (weight[:, None] * extra**2).sum(0) + 1.0 + pull)
    vw, vu, vb = w.copy(), u.copy(), b
    for t in range(rounds):
        g = (_sigmoid(x.dot(vw) + extra @ vu + vb) - y) * weight
        nw = vw - step * (np.bincount(x.cols, g[x.row], width) + l2 * vw)
        nu = vu - step_u * (extra.T @ g + pull * (vu - middle))
        nb = vb - 0.5 * step_b * g.sum()
        m = t / (t + 3)
        vw, vu, vb = nw + m * (nw - w), nu + m * (nu - u), nb + m * (nb - b)
        w, u, b = nw, nu, nb
    return w, b, u


def _kinds(x: _Rows, marked: np.ndarray, idf: np.ndarray, kinds: int, seed: int, rank: int = 12, rounds: int = 20) -> np.ndarray:
    """Latent kind of each marked row: k-means in the leading singular space of their idf-weighted shared features, started
    from the rows farthest apart there. Rows without a shared feature are of the first kind."""
    part = x.take(marked)
    often = np.bincount(part.cols, minlength=len(idf))
    shared = np.flatnonzero(often >= max(2, part.n // 100))
    if not len(shared):
        return np.zeros(part.n, np.int64)
    at = np.full(len(idf), -1, np.int64)
    at[shared] = np.arange(len(shared))
    use = at[part.cols] >= 0
    dense = np.zeros((part.n, len(shared)), np.float32)
    dense[part.row[use], at[part.cols[use]]] = idf[part.cols[use]]
    dense /= np.maximum(np.sqrt((dense**2).sum(1, keepdims=True)), 1e-6)
    dense -= dense.mean(0)
    y = dense.T @ (dense @ np.random.default_rng(seed).standard_normal((len(shared), rank)).astype(np.float32))
    space = dense @ np.linalg.svd(dense.T @ (dense @ y), full_matrices=False)[0]
    space /= np.maximum(np.sqrt((space**2).sum(1, keepdims=True)), 1e-6)
    centres = [space[int((space @ space.mean(0)).argmax())]]
    while len(centres) < kinds:
        centres.append(space[int((space @ np.stack(centres).T).max(1).argmin())])
    for _ in range(rounds):
        kind = (space @ np.stack(centres).T).argmax(1)
        for k in range(kinds):
            if (kind == k).any():
                c = space[kind == k].mean(0)
                centres[k] = c / max(1e-6, float(np.linalg.norm(c)))
    return kind


def train(texts: list[np.ndarray], marks: np.ndarray, counts: np.ndarray, seed: int = 3, folds: int = 3, rounds: int = 3, min_marked: int = 5) -> Model | None:
    """The chain from texts (token hashes), their mean marks in [0, 1] and the corpus's ``document_counts``.

    Texts whose raters are evenly split are left out. None with fewer than ``min_marked`` texts of either kind.
    """
    clear = np.flatnonzero(np.abs(marks - 0.5) > 0.01)
    texts, label = [texts[i] for i in clear], (marks[clear] > 0.5).astype(float)
    flat, starts, owner = sentences(texts)
    if not len(starts) or min(label.sum(), len(label) - label.sum()) < min_marked:
        return None
    buckets, share = features(flat), log_share(counts)
    of = np.zeros(len(flat), np.int64)
    of[starts] = 1
    row = np.tile(np.maximum(np.cumsum(of) - 1, 0), 3)
    cols = np.concatenate(buckets).astype(np.int64)
    codes = _distinct((row * SIZE + cols)[cols < SIZE])
    row, cols = codes // SIZE, codes % SIZE
    in_doc = _distinct(owner[row] * SIZE + cols)
    d, c = in_doc // SIZE, in_doc % SIZE
    pos, total = np.bincount(c, label[d], SIZE), np.bincount(c, minlength=SIZE)
    rate = label.mean()
    # Columns that say something: how often the marked documents have a feature, against the unmarked ones.
    z = (pos - total * rate) / np.sqrt(total * rate * (1 - rate) + 0.25)
    kept = np.flatnonzero((np.abs(z) > np.where(total < 20, 0.9, 2.5)) & (total > 1))
    index = np.full(SIZE, -1, np.int64)
    index[kept] = np.arange(len(kept))
    use = index[cols] >= 0
    x, width = _Rows(index[cols[use]], row[use], len(starts)), len(kept)
    common = _common(buckets, starts, flat, share)
    mean, spread = common.mean(0), common.std(0) + 1e-6
    extra = _dense(common, mean, spread)

    # Which sentences of a marked text earn the mark: the least common one, then what models of the dense features alone
    # and, after them, models of the other folds find likely. A marked text without such a sentence is a rater's error.
    fold = np.random.default_rng(seed).permutation(len(texts)) % folds
    bad, none = label[owner] > 0, _Rows(np.empty(0, np.int64), np.empty(0, np.int64), len(starts))
    like, long = -common[:, 1], common[:, 3] >= 4
    for t in range(2 * rounds):
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, np.where(long, like, like - 10))
        worst = long & (like >= top[owner])
        y = (bad & (worst if t < rounds else (like > 0) | (worst & (like > -2)))).astype(float)
        weight = np.where(bad & (y == 0), 0.2, 1.0)
        if t < rounds - 1:
            _, b, u = _fit(none, extra, y, weight, 1, rounds=200)
            like, prior = extra @ u + b, (u, b)
        else:
            like = _out_of_fold(x, extra, y, weight, width, fold[owner], folds, prior)

    marked, n, base = np.flatnonzero(y > 0), len(CATEGORIES), extra.shape[1]
    kind = np.full(len(starts), -1)
    if len(marked):
        kind[marked] = _kinds(x, marked, -share[kept], KINDS, seed)
    model = Model(np.zeros((SIZE + 1, n), np.float32), np.zeros((n, base)), np.zeros(n), np.zeros((n, n)), mean, spread, share, 0.5)
    margin = like
    for k in range(n):
        target = (kind == k).astype(float) if k < KINDS else y
        if target.sum() < 2:
            model.bias[k] = -9.0
            extra = np.column_stack([extra, np.zeros(len(starts))])
            continue
        margin = _out_of_fold(x, extra, target, weight, width, fold[owner], folds, prior)
        w, b, u = _fit(x, extra, target, weight, width, prior)
        model.weight[kept, k], model.bias[k], model.dense[k], model.chain[k, :k] = w, b, u[:base], u[base:]
        extra = np.column_stack([extra, _sigmoid(margin)])
        model.quality.append((CATEGORIES[k], int(target.sum()), int((margin > 0).sum()), int(((margin > 0) & (target > 0)).sum())))
    # The threshold that fits the marks best, out of fold.
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, owner, margin)
    cuts = np.linspace(-3, 2, 51)
    f1 = np.array([2 * ((top >= t) * label).sum() / max(1.0, (top >= t).sum() + label.sum()) for t in cuts])
    best = cuts[f1 >= f1.max() - 0.004]  # raters err, so the top is flat: the even odds, or what is nearest to them
    cut = best[np.abs(best).argmin()]
    model.threshold = float(_sigmoid(cut))
    model.quality.append(("documents", int(label.sum()), int((top >= cut).sum()), int(((top >= cut) * label).sum())))
    return model


def _out_of_fold(x: _Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, fold: np.ndarray, folds: int, prior: tuple) -> np.ndarray:
    margin = np.zeros(x.n)
    for f in range(folds):
        fit, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        w, b, u = _fit(x.take(fit), extra[fit], y[fit], weight[fit], width, prior)
        margin[rest] = x.take(rest).dot(w) + b + extra[rest] @ u
    return margin


def _slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` units together, a larger row alone."""
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, source, tokens) of every row: the token hashes of the whole text as little-endian 32-bit integers."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in batches:
            size = pa.compute.fill_null(pa.compute.utf8_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(size, 4_000_000):
                part = batch.slice(a, b - a)
                tokens = [h.astype("<i4").tobytes() for h in hashes_of(part.column(2).to_pylist(), cache)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tokens, pa.binary())], names=["key", "source", "tokens"])

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), source.alias("source"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, source string, tokens binary")


def _texts(batch: pa.RecordBatch, column: str = "tokens") -> Iterator[tuple[int, int, list[np.ndarray]]]:
    size = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for a, b in _slices(size, 4_000_000):
        yield a, b, [np.frombuffer(x, "<i4") for x in batch.column(column).slice(a, b - a).to_pylist()]


def corpus_counts(tokens: DataFrame) -> np.ndarray:
    """``document_counts`` over all rows that have words: sparse partial sums, added up by bucket (at most SIZE + 1 rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for _, _, texts in _texts(batch):
                total += document_counts(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = tokens.where(F.length("tokens") > 0).select("tokens").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE + 1, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def _trained(tokens: DataFrame, labels: DataFrame, key: str, max_labelled: int, min_marked: int) -> Model | None:
    marks = (
        labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.avg((F.col("toxic") > 0).cast("double")).alias("mark"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(max_labelled)
    )
    rows = tokens.where(F.length("tokens") > 0).join(F.broadcast(marks), "key").select("key", "tokens", "mark").orderBy("key", "tokens")
    texts, values = [], []
    for r in rows.toLocalIterator():
        texts.append(np.frombuffer(bytes(r[1]), "<i4"))
        values.append(r[2])
    return train(texts, np.array(values, float), corpus_counts(tokens), min_marked=min_marked) if texts else None


def trained(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, key: str = "doc_id", text: str = "text", min_marked: int = 5) -> Model | None:
    """The chain, trained on at most ``max_labelled`` labelled documents; None with too few marks of either kind."""
    ship(docs.sparkSession)
    return _trained(staged(hashed(docs, key, text), "hashed"), labels, key, max_labelled, min_marked)


def scored(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, key: str = "doc_id", text: str = "text", min_marked: int = 5) -> DataFrame:
    """(key, source, one score per category, flagged) of every row of ``docs``.

    Null, empty and wordless texts score 0. Labels of unknown documents and null labels count for nothing; raters who
    disagree are averaged, an even split teaches nothing. With fewer than ``min_marked`` marked or unmarked labelled
    documents nothing can be learned: every score and ``flagged`` are null, and a warning says so.
    """
    spark = ship(docs.sparkSession)
    tokens = staged(hashed(docs, key, text), "hashed")
    model = _trained(tokens, labels, key, max_labelled, min_marked)
    if model is None:
        warnings.warn(f"no toxicity model: fewer than {min_marked} marked or unmarked labelled documents; all scores are null", stacklevel=2)
        return tokens.select(F.col("key").alias(key), "source", *(F.lit(None).cast("double").alias(c) for c in CATEGORIES), F.lit(None).cast("boolean").alias("flagged"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, texts in _texts(batch):
                p = model.score(texts)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= model.threshold)],
                    names=[key, "source", *CATEGORIES, "flagged"],
                )

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, source string, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", flagged boolean"
    return tokens.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(category, marked, found, both, precision, recall) out of fold: sentences per category, and documents against the raters."""
    model = trained(docs, labels)
    rows = [(c, m, f, b, b / f if f else None, b / m if m else None) for c, m, f, b in (model.quality if model else [])]
    return docs.sparkSession.createDataFrame(rows, "category string, marked int, found int, both int, precision double, recall double")


def rates(scores: DataFrame) -> DataFrame:
    """Documents, flagged ones and their rate per source (partially aggregated before the shuffle); no rate without a model."""
    return scores.groupBy("source").agg(F.count("*").alias("docs"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"))
