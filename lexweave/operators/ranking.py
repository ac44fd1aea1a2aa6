"""Ranked retrieval: lexical, vector, fusion, signals, collapse, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.names import c

K1, B = 1.2, 0.75


def bm25(docs: DataFrame, query: str, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, score) of all rows with a query term: fielded BM25, idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    One pass counts lengths and the query's terms per row (no postings are built for other words), one row of
    statistics is crossed in. Terms repeat-free in order of the query; null texts are empty. Scores have 6 places.
    """
    terms = list(dict.fromkeys(query_terms(query)))
    # Tokens apart by two blanks: " term " can be counted by plain replacement, without arrays or lambdas.
    spaced = lambda f: F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(c(f), F.lit(""))), F.lit(" ")), r"[^\p{L}\p{N}]+", "  ")
    times = lambda x, y: (F.length(x) - F.length(F.replace(x, F.lit(y), F.lit("")))) / len(y)
    rows = docs.select(F.col(key), *(spaced(f).alias(f"t_{i}") for i, f in enumerate(fields)))
    cols = [F.col(key)]
    for i in range(len(fields)):
        cols.append((times(F.col(f"t_{i}"), "  ") - 1).alias(f"len_{i}"))
        cols += [times(F.col(f"t_{i}"), f" {t} ").alias(f"tf_{i}_{j}") for j, t in enumerate(terms)]
    counted = rows.select(*cols)
    pairs = [(i, j) for i in range(len(fields)) for j in range(len(terms))]
    stats = counted.agg(
        F.count("*").alias("n"),
        *(F.avg(f"len_{i}").alias(f"avg_{i}") for i in range(len(fields))),
        *(F.count_if(F.col(f"tf_{i}_{j}") > 0).alias(f"df_{i}_{j}") for i, j in pairs),
    )
    score = F.lit(0.0)
    boosts = list(fields.values())
    for i, j in pairs:
        tf, df = F.col(f"tf_{i}_{j}"), F.col(f"df_{i}_{j}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        norm = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"len_{i}") / F.nullif(F.col(f"avg_{i}"), F.lit(0.0))))
        score = score + F.coalesce(F.when(tf > 0, boosts[i] * idf * norm), F.lit(0.0))
    # Which rows can score is told by the raw text; a filter on the counts would be pushed below them and make them twice.
    holds = [F.contains(F.lower(F.coalesce(c(f), F.lit(""))), F.lit(t)) for f in fields for t in terms]
    some = holds[0] if holds else F.lit(False)
    for h in holds[1:]:
        some = some | h
    few = docs.where(some).select(F.col(key), *(spaced(f).alias(f"t_{i}") for i, f in enumerate(fields))).select(*cols)
    return few.crossJoin(F.broadcast(stats)).select(key, F.round(score, 6).alias("score")).where("score > 0")


def query_terms(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\W_]+", query.lower()) if t]


def top(scored: DataFrame, key: str, k: int, score: str = "score", ties: bool = False) -> DataFrame:
    """The k best with their rank: score to 1/1000, then the key. A total order, so no tie is cut at random; with ``ties``
    rows as good as the last one are kept too, however many."""
    rounded = F.round(F.col(score) * 1000)
    best = scored.orderBy(rounded.desc(), F.col(key)).limit(k)
    if ties:
        last = best.select(rounded.alias("s")).agg(F.min("s").alias("_least"), F.count("*").alias("_n"))
        best = scored.crossJoin(F.broadcast(last)).where((rounded >= F.col("_least")) | (F.col("_n") < k)).drop("_least", "_n")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(rounded.desc(), F.col(key))).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_to(vectors: DataFrame, query: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, cosine) of every vector to the one query row; null for a zero vector."""
    q = query.select(F.col(vector).alias("q")).limit(1)
    unit = lambda x: F.sqrt(dot(x, x))
    value = dot(F.col(vector), F.col("q")) / F.nullif(unit(F.col(vector)) * unit(F.col("q")), F.lit(0.0))
    return vectors.crossJoin(F.broadcast(q)).select(key, F.round(value, 6).alias("cosine"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """(query_id, key, cosine, rank): for every query row its k best vectors in the order of ``top``; zero vectors have no
    cosine and come last. Queries are compared a block at a time by matrix products; each task keeps k rows of a query."""
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    of = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    unit = lambda m: m / np.where((n := np.sqrt((m * m).sum(1, keepdims=True))) == 0, np.nan, n)

    def best(shared):
        def run(batches):
            ids, q = shared.value
            q = unit(q)
            keys, who, cos = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for batch in batches:
                if not len(batch):
                    continue
                there = batch.column(0).to_numpy(zero_copy_only=False)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(there), -1)
                c = np.round(q @ unit(v).T, 6)
                rank = np.where(np.isnan(c), -9e9, np.round(c * 1000))
                cut = np.partition(rank, -k, 1)[:, -k][:, None] if len(there) > k else rank.min(1, keepdims=True, initial=0)
                r, x = np.nonzero(rank >= cut)  # the k best and all that tie with the last of them
                keys, who, cos = np.concatenate([keys, there[x]]), np.concatenate([who, r]), np.concatenate([cos, c[r, x]])
                order = np.lexsort((keys, -np.where(np.isnan(cos), -9e9, np.round(cos * 1000)), who))
                keys, who, cos = keys[order], who[order], cos[order]
                first = np.searchsorted(who, np.arange(len(ids)))
                keep = np.arange(len(who)) - first[who] < k
                keys, who, cos = keys[keep], who[keep], cos[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[who]), pa.array(keys), pa.array(cos, from_pandas=True)], names=["query_id", key, "cosine"])

        return of(vectors).mapInArrow(run, f"query_id bigint, {key} bigint, cosine double")

    out, ids, held = None, [], []
    rows = of(queries).toLocalIterator()
    while True:
        r = next(rows, None)
        if r is not None:
            ids.append(r.id)
            held.append(r.v)
        if len(ids) == block or (r is None and (ids or out is None)):
            part = best(spark.sparkContext.broadcast((ids, np.array(held, float).reshape(len(ids), -1)))) if ids else spark.createDataFrame([], f"query_id bigint, {key} bigint, cosine double")
            out, ids, held = part if out is None else out.unionByName(part), [], []
        if r is None:
            break
    w = Window.partitionBy("query_id").orderBy(F.round(F.col("cosine") * 1000).desc_nulls_last(), F.col(key))
    return out.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def rrf(lexical: DataFrame, vector: DataFrame, key: str | list[str], w1: float = 1.0, w2: float = 1.0, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, rank), or of such lists per query with several keys: 1.0 for rank 1
    in both, also if one list is empty. A rank of 0 means absent from that list."""
    keys = [key] if isinstance(key, str) else key
    a = lexical.select(*keys, F.col("rank").alias("lex_rank"))
    b = vector.select(*keys, F.col("rank").alias("vec_rank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (k + F.col(r)), F.lit(0.0))
    return a.join(b, keys, "full_outer").select(
        *keys, F.coalesce("lex_rank", F.lit(0)).alias("lex_rank"), F.coalesce("vec_rank", F.lit(0)).alias("vec_rank"), F.round((part(w1, "lex_rank") + part(w2, "vec_rank")) / ((w1 + w2) / (k + 1)), 6).alias("score")
    )


def adjusted(score: Column, title_path: Column, refs_in: Column, chunks: Column, is_note: Column, superseded: Column, hub: bool = False) -> Column:
    """Ranking signals: +0.10 x title match, hub boost (off by default), +0.10 for three chunks, -0.20 notes, -0.50 superseded."""
    value = score + 0.10 * F.coalesce(title_path, F.lit(0.0)) + F.when(chunks >= 3, 0.10).otherwise(0.0)
    value = value - F.when(is_note, 0.20).otherwise(0.0) - F.when(superseded, 0.50).otherwise(0.0)
    if hub:
        value = value + F.least(F.log(1 + F.coalesce(refs_in, F.lit(0))) * 0.02, F.lit(0.10))
    return F.round(value, 6)


def title_fraction(query: str, *parts: str | Column) -> Column:
    """Share of the query's distinct terms that label, title or path hold."""
    terms = F.array(*(F.lit(t) for t in dict.fromkeys(query_terms(query))))
    have = F.flatten(F.array(*(F.coalesce(T.tokens(p), F.array().cast("array<string>")) for p in parts)))
    return F.size(F.array_intersect(terms, have)) / F.size(terms)


def with_chunks(candidates: DataFrame, query: list[str], work: str) -> DataFrame:
    """Candidates with ``chunks``, how many of the same list are of the same work (1 where the work is unknown)."""
    n = candidates.where(F.col(work).isNotNull()).groupBy(*query, work).agg(F.count("*").alias("chunks"))  # of listed candidates only
    return candidates.join(n, [*query, work], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)).cast("bigint"))


def collapse(scored: DataFrame, group: str, key: str, score: str = "score") -> DataFrame:
    """The best row per group (ties: least key): an aggregate, so no window over a hot group."""
    rest = [x for x in scored.columns if x != group]
    return scored.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(key))).alias("best")).select(group, "best.*")


def pinned(ranked: DataFrame, pins: DataFrame, key: str) -> DataFrame:
    """Pins (key, pin 1, 2, ...) with score 2.0 ahead of the rest (pin 0); ranked rows of a pinned key fall away."""
    rest = ranked.join(pins.select(key), key, "left_anti").select(key, "score", F.lit(0).alias("pin"))
    return pins.select(key, F.lit(2.0).alias("score"), F.col("pin").cast("int").alias("pin")).unionByName(rest)


def abstains(lexical: Column, cosine: Column, pins: Column) -> Column:
    """No pin, and both legs weak (or cosine below its floor; without a cosine the lexical share alone)."""
    weak = F.when(cosine.isNull(), lexical < 0.34).otherwise(((lexical < 0.34) & (cosine < 0.30)) | (cosine < 0.28))
    return (pins == 0) & weak


def best_share(items: DataFrame, docs: DataFrame, item_key: str, text: str) -> DataFrame:
    """(item_key, share) of every item: the greatest share of its distinct words that one document has; 0 without words.

    The items are collected (they alone bound what is broadcast); every document is compared with all of them.
    """
    import numpy as np
    import pyarrow as pa

    spark = items.sparkSession
    rows = [tuple(r) for r in items.select(item_key, F.array_distinct(T.tokens(text))).toLocalIterator()]
    voc: dict[str, int] = {}
    asked = [[voc.setdefault(t, len(voc)) for t in q or []] for _, q in rows]
    shared = spark.sparkContext.broadcast((voc, asked))

    def run(batches):
        voc, asked = shared.value
        has = np.zeros((len(voc), len(asked)), np.float32)
        for k, q in enumerate(asked):
            has[q, k] = 1
        best = np.zeros(len(asked), np.float32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 512):
                docs = np.zeros((len(texts[i : i + 512]), len(voc)), np.float32)
                for n, tokens in enumerate(texts[i : i + 512]):
                    docs[n, [voc[t] for t in tokens if t in voc]] = 1
                best = np.maximum(best, (docs @ has).max(0, initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(best)), pa.int64()), pa.array(best.astype(int), pa.int64())], names=["nth", "hits"])

    found = docs.where(F.col(text).isNotNull()).select(F.array_distinct(T.tokens(text)).alias("t")).mapInArrow(run, "nth bigint, hits bigint")
    hits = found.groupBy("nth").agg(F.max("hits").alias("hits"))
    kind = items.schema[item_key].dataType.simpleString()
    keys = spark.createDataFrame([(n, k, len(q)) for n, ((k, _), q) in enumerate(zip(rows, asked))], f"nth bigint, {item_key} {kind}, words bigint")
    return keys.join(hits, "nth", "left").select(item_key, F.coalesce(F.col("hits") / F.nullif(F.col("words"), F.lit(0)), F.lit(0.0)).alias("share"))


def best_lines(docs: DataFrame, query: str, key: str, text: str, cap: int = 220) -> DataFrame:
    """(key, line_no, hits, snippet): the line with most distinct query terms, the first of equals, cut at ``cap`` characters."""
    terms = F.array(*(F.lit(t) for t in dict.fromkeys(query_terms(query))))
    each = F.transform(
        T.lines(text),
        lambda l, i: F.struct((-F.size(F.array_intersect(terms, T.tokens(l)))).alias("less"), (i + 1).alias("line_no"), l.alias("line")),
    )
    best = F.array_min(each)
    return docs.where(c(text).isNotNull()).select(key, best.alias("b")).where("b.less < 0").select(
        key, F.col("b.line_no").cast("int").alias("line_no"), (-F.col("b.less")).cast("int").alias("hits"), F.substring("b.line", 1, cap).alias("snippet")
    )


def within_budget(rows: DataFrame, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Leading rows whose running cost stays within the budget; the list ends at the first that overflows. A row costs at
    least 1, so only the first ``budget`` + 1 rows can matter and no more reach the running sum."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    few = rows.withColumn(cost, F.greatest(F.col(cost), F.lit(1))).orderBy(*order).limit(budget + 1)
    return few.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def shared_words(items: DataFrame, docs: DataFrame, item_key: str, doc_key: str, text: str, k: int) -> DataFrame:
    """(item_key, doc_key, hits, rank): for every item the k documents with most of its distinct words (ties: least key).

    Postings of the items' own words only, so what is joined has the size of the matches; words that every document has
    are pre-aggregated per item and document before the ranking.
    """
    asked = items.select(item_key, F.explode(F.array_distinct(T.tokens(text))).alias("word"))
    words = docs.where(F.col(text).isNotNull()).select(doc_key, F.explode(F.array_distinct(T.tokens(text))).alias("word"))
    hits = words.join(F.broadcast(asked) if asked.count() <= 2_000_000 else asked, "word").groupBy(item_key, doc_key).agg(F.count("*").alias("hits"))
    w = Window.partitionBy(item_key).orderBy(F.desc("hits"), doc_key)
    return hits.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
