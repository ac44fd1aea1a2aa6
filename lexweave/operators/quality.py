"""Evaluation, sampling, lots, consensus, ledgers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import ship


def ranking_metrics(ranked: DataFrame, gold: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, recall, ndcg, mrr) at ``k`` of ranked rows (query, key, rank) against gold rows (query, key); 0 for no hit."""
    want = gold.groupBy(query).agg(F.countDistinct(key).alias("wanted"))
    hit = ranked.where(F.col("rank") <= k).join(gold.select(query, key).distinct(), [query, key])
    got = hit.groupBy(query).agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("wanted", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return want.join(got, query, "left").select(
        query, zero(F.col("hits") / F.col("wanted")).alias("recall"), zero(F.col("dcg") / best).alias("ndcg"), zero(1 / F.col("first")).alias("mrr")
    )


def nearest_rank(rows: DataFrame, value: str, p: float, by: list[str]) -> DataFrame:
    """Nearest-rank percentile per group: the value at position ceil(n p), never in between two."""
    at = F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(at.alias("value"))


def bootstrap(rows: DataFrame, value: str, by: str, rounds: int = 1000, seed: int = 41) -> DataFrame:
    """(by, low, high): 2.5 and 97.5 % order statistics of resampled means. A Poisson bootstrap: every row draws its
    weight in every round from its own hash, so partial sums merge and no group is held in one place."""
    ship(rows.sparkSession)

    # Poisson(1) by inversion of uniform draws, each a hash of the row's hash and the round.
    steps = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(12)])
    salts = np.random.default_rng(seed).integers(1, 2**63, rounds).astype(np.uint64)

    def weights(h: np.ndarray) -> np.ndarray:
        z = h.astype(np.uint64)[:, None] ^ salts
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
        return np.searchsorted(steps, (z >> np.uint64(11)).astype(float) / 2**53)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby("g", dropna=False):
                total, weight = sums.setdefault(g, (np.zeros(rounds), np.zeros(rounds)))
                for i in range(0, len(part), 2000):
                    w = weights(part["h"].to_numpy()[i : i + 2000])
                    total += part["v"].to_numpy()[i : i + 2000] @ w
                    weight += w.sum(0)
        yield pd.DataFrame([(g, i, t[i], w[i]) for g, (t, w) in sums.items() for i in range(rounds)], columns=["g", "i", "t", "w"])

    data = rows.where(F.col(value).isNotNull()).select(F.col(by).cast("string").alias("g"), F.xxhash64(*rows.columns).alias("h"), F.col(value).cast("double").alias("v"))
    sums = data.mapInPandas(partial, "g string, i int, t double, w double").groupBy("g", "i").agg((F.sum("t") / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY mean)")
    return sums.where("mean IS NOT NULL").groupBy(F.col("g").alias(by)).agg(at(0.025).alias("low"), at(0.975).alias("high"))


def round_robin(rows: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """``n`` rows, one of each stratum in turn, in the given order within it."""
    # No row beyond a stratum's first n can be drawn, so a large stratum is cut in pieces before it is ordered in one place.
    salted = rows.withColumn("_piece", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
    few = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum, "_piece").orderBy(*order))).where(F.col("_rn") <= n).select(*rows.columns)
    w = Window.partitionBy(stratum).orderBy(*order)
    return few.withColumn("turn", F.row_number().over(w).cast("int")).orderBy("turn", stratum).limit(n)


def seeded_sample(rows: DataFrame, stratum: str, key: str, per_stratum: int, seed: str) -> DataFrame:
    """The rows of each stratum with the least sha256 of (seed, key): the same on every engine and at every run.

    A stratum's rows are cut to ``per_stratum`` before they are ranked against each other in one place.
    """
    salted = rows.withColumn("draw", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    part = Window.partitionBy(stratum, F.substring("draw", -2, 2)).orderBy("draw", key)
    few = salted.withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= per_stratum)
    whole = Window.partitionBy(stratum).orderBy("draw", key)
    return few.withColumn("rn", F.row_number().over(whole).cast("int")).where(F.col("rn") <= per_stratum)


def lots(graded: DataFrame, lot: str, error: str, accept: int) -> DataFrame:
    """(lot, graded, errors, rate, decision): accepted if fully graded and the errors do not exceed ``accept``."""
    g = graded.groupBy(lot).agg(F.count("*").alias("items"), F.count(error).alias("graded"), F.count_if(F.col(error)).alias("errors"))
    decision = F.when(F.col("graded") < F.col("items"), "open").when(F.col("errors") <= accept, "accepted").otherwise("rejected")
    return g.select(lot, "graded", "errors", F.round(F.col("errors") / F.nullif(F.col("graded"), F.lit(0)), 6).alias("rate"), decision.alias("decision"))


def switching(lots_: DataFrame, order: str) -> DataFrame:
    """Inspection level after each lot: tightened if 2 of the last 5 were rejected, reduced if the last 10 were accepted."""
    w = Window.orderBy(order)
    bad = (F.col("decision") == "rejected").cast("int")
    last5, last10 = F.sum(bad).over(w.rowsBetween(-4, 0)), F.sum(bad).over(w.rowsBetween(-9, 0))
    n = F.count("*").over(w.rowsBetween(-9, 0))
    return lots_.withColumn("level", F.when(last5 >= 2, "tightened").when((n == 10) & (last10 == 0), "reduced").otherwise("normal"))


def latest(receipts: DataFrame, item: str, sequence: list[str]) -> DataFrame:
    """The newest receipt per item: an aggregate that merges before its shuffle."""
    rest = [x for x in receipts.columns if x != item]
    return receipts.groupBy(item).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("x")).select(item, "x.*")


def budget(calls: DataFrame, by: str, reserved: str, actual: str, cap: float) -> DataFrame:
    """(by, charged, unresolved, remaining): actual cost where known, the reservation where not."""
    spent = F.sum(F.coalesce(actual, reserved))
    return calls.groupBy(by).agg(
        F.round(spent, 4).alias("charged"), F.count_if(F.col(actual).isNull()).alias("unresolved"), F.round(F.greatest(F.lit(0.0), cap - F.coalesce(spent, F.lit(0.0))), 4).alias("remaining")
    )


def consensus(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, state): both, only_first or only_second, with one flag per field that agrees (null equals null)."""
    a = first.select(key, F.struct(*fields).alias("a"))
    b = second.select(key, F.struct(*fields).alias("b"))
    j = a.join(b, key, "full_outer")
    state = F.when(F.col("b").isNull(), "only_first").when(F.col("a").isNull(), "only_second").otherwise("both")
    return j.select(key, state.alias("state"), *(F.coalesce(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(False)).alias(f"{f}_agrees") for f in fields))


def combined(artifacts: DataFrame, id_: str, content: list[str], evidence: str) -> DataFrame:
    """(id, versions, conflict, evidence): artifacts of one id united; differing contents are a conflict."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return artifacts.groupBy(id_).agg(
        F.countDistinct(digest).alias("versions"), F.array_sort(F.collect_set(evidence)).alias("evidence")
    ).withColumn("conflict", F.col("versions") > 1)


def aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, how): records (id, node, title, level_name) of two dates matched by node, then id, then (title, level),
    each stage on what the stages before left, and only where the key is unique on both sides."""
    left, right, out = old, new, None
    for how, keys in (("node", ["node"]), ("id", ["id"]), ("title", ["title", "level_name"])):
        one = lambda df, name: df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.col("id_")).alias(name)).where("n = 1").drop("n")  # noqa: E731, B023
        a = one(left.withColumn("id_", F.col("id")), "old_id")
        b = one(right.withColumn("id_", F.col("id")), "new_id")
        hit = a.join(b, keys).select("old_id", "new_id", F.lit(how).alias("how"))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit.select(F.col("old_id").alias("id")), "id", "left_anti")
        right = right.join(hit.select(F.col("new_id").alias("id")), "id", "left_anti")
    return out


def reconciled(known: DataFrame, incoming: DataFrame, native: str, digest: str) -> DataFrame:
    """(uid, how, id): incoming units matched to known ones by a native id unique on both sides, else by a unique digest;
    the rest is new, or a conflict where the digest is known but not unique."""
    out, rest = None, incoming
    for how in (native, digest):
        once = lambda df: df.where(F.col(how).isNotNull()).groupBy(how).agg(F.count("*").alias("n"), F.min("id").alias("id"))  # noqa: E731, B023
        k = once(known).where("n = 1").select(how, F.col("id").alias("known_id"))
        i = once(rest.withColumnRenamed("uid", "id")).where("n = 1").select(how, F.col("id").alias("uid"))
        hit = i.join(k, how).select("uid", F.lit(how).alias("how"), F.col("known_id").alias("id"))
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(hit.select("uid"), "uid", "left_anti")
    twice = rest.join(known.select(digest).distinct(), digest, "left_semi").select("uid", F.lit("conflict").alias("how"), F.lit("").alias("id"))
    fresh = rest.join(twice.select("uid"), "uid", "left_anti").select("uid", F.lit("new").alias("how"), F.lit("").alias("id"))
    return out.unionByName(twice).unionByName(fresh)


def leaking_splits(tasks: DataFrame, query: str, split: str) -> DataFrame:
    """Queries that stand in more than one split."""
    return tasks.groupBy(query).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def hard_questions(ranks: DataFrame, query: str, lexical: str, vector: str, n: int) -> DataFrame:
    """Questions that neither baseline solves within rank ``n`` (a null rank is not found)."""
    worst = 2**31 - 1
    return ranks.where(F.least(F.coalesce(lexical, F.lit(worst)), F.coalesce(vector, F.lit(worst))) > n).select(query)


def passage_audit(passages: DataFrame, body: str, words: Column, short: int = 20) -> DataFrame:
    """One row: passages, distinct bodies, short ones, and the median of their words (nearest rank)."""
    return passages.select(body, words.alias("w")).agg(
        F.count("*").alias("passages"), F.countDistinct(F.sha2(body, 256)).alias("distinct_bodies"), F.count_if(F.col("w") < short).alias("short"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY w)").alias("median_words")
    )


def coverage(items: DataFrame, by: str, state: str) -> DataFrame:
    """(by, proposed, agreed, published, withheld): what became of everything that was proposed."""
    n = lambda *s: F.count_if(F.col(state).isin(*s))
    return items.groupBy(by).agg(F.count("*").alias("proposed"), n("agreed", "published").alias("agreed"), n("published").alias("published"), n("withheld").alias("withheld"))


def quota_split(rows: DataFrame, group: str, key: str, quota: int, seed: str) -> DataFrame:
    """(group, rows, split): whole groups in seeded order go to tuning until the quota of rows is met, the rest is held out."""
    sizes = rows.groupBy(group).agg(F.count(key).alias("rows"))
    w = Window.orderBy(F.sha2(F.concat(F.lit(seed), F.col(group).cast("string")), 256), group).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(w), F.lit(0))
    return sizes.withColumn("split", F.when(before < quota, "tuning").otherwise("heldout"))


def reusable_stages(receipts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(stage, reuse): a stage's last complete receipt may be reused iff its input key and output digest are those wanted.

    receipts: stage, attempt, input_key, output_digest, complete; wanted: stage, input_key, output_digest.
    """
    last = latest(receipts.where("complete").select("stage", "attempt", "input_key", "output_digest"), "stage", ["attempt"])
    both = wanted.alias("w").join(last.alias("l"), "stage", "left")
    same = F.col("w.input_key").eqNullSafe(F.col("l.input_key")) & F.col("w.output_digest").eqNullSafe(F.col("l.output_digest")) & F.col("l.attempt").isNotNull()
    return both.select("stage", F.coalesce(same, F.lit(False)).alias("reuse"))
