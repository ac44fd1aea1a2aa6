"""Typed knowledge graphs: concepts, mentions, relations with checked evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.session import staged


def normal(x: str | Column) -> Column:
    """Lower case, single blanks, no punctuation, one blank around: for whole-phrase containment."""
    return F.concat(F.lit(" "), F.array_join(T.tokens(x), " "), F.lit(" "))


def aliases(concepts: DataFrame) -> DataFrame:
    """(alias, id) of labels and aliases (concepts: id, label, aliases)."""
    names = F.array_distinct(F.filter(F.transform(F.concat(F.array("label"), F.coalesce("aliases", F.array())), normal), lambda x: F.trim(x) != ""))
    return concepts.select("id", F.explode(names).alias("alias")).distinct()


def mentioned(concepts: DataFrame, query: str) -> DataFrame:
    """(id, alias, ambiguous): concepts whose alias stands in the query as whole words."""
    hit = aliases(concepts).where(F.contains(normal(F.lit(query)), F.col("alias")))
    per = hit.groupBy("alias").agg((F.countDistinct("id") > 1).alias("ambiguous"))
    return hit.join(per, "alias").select("id", F.trim("alias").alias("alias"), "ambiguous")


def lookup(concepts: DataFrame, what: str) -> DataFrame:
    """Concepts by id, label or alias, case-blind; ``*`` for all."""
    if what == "*":
        return concepts
    ids = aliases(concepts).where(F.col("alias") == normal(F.lit(what))).select("id").unionByName(concepts.where(F.lower("id") == what.lower()).select("id")).distinct()
    return concepts.join(ids, "id", "left_semi")


def traverse(relations: DataFrame, start: DataFrame, depth: int, types: list[str] | None = None, states: tuple[str, ...] = ("passed",)) -> DataFrame:
    """(relation_id, from_id, to_id, type, depth, path): every admitted relation once, at its least depth, with the path of
    ids that led there. relations: relation_id, from_id, to_id, type, directed, state."""
    r = relations.where(F.col("state").isin(*states))
    if types:
        r = r.where(F.col("type").isin(types))
    there = r.select("relation_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"), "from_id", "to_id", "type")
    back = r.where(~F.col("directed")).select("relation_id", F.col("to_id").alias("a"), F.col("from_id").alias("b"), "from_id", "to_id", "type")
    step = there.unionByName(back)
    frontier = start.select("id", F.array("id").alias("path")).distinct()
    levels: list[DataFrame] = []
    for k in range(1, depth + 1):
        new = frontier.join(step, F.col("id") == F.col("a")).select("relation_id", "from_id", "to_id", "type", F.lit(k).alias("depth"), F.concat("path", F.array("b")).alias("path"), "b")
        for seen in levels:
            new = new.join(seen.select("relation_id"), "relation_id", "left_anti")
        # one path per relation: the least, so that the result does not depend on the order of rows
        new = new.groupBy("relation_id").agg(F.min(F.struct("path", "from_id", "to_id", "type", "depth", "b")).alias("x")).select("relation_id", "x.*")
        new = staged(new, "relations")
        if new.isEmpty():
            break
        levels.append(new.drop("b"))
        frontier = new.groupBy(F.col("b").alias("id")).agg(F.min("path").alias("path"))
    if not levels:
        return there.limit(0).select("relation_id", "from_id", "to_id", "type", F.lit(0).alias("depth"), F.array("a").alias("path"))
    return reduce(DataFrame.unionByName, levels)


def faults(concepts: DataFrame, relations: DataFrame, evidence: DataFrame, files: DataFrame) -> DataFrame:
    """(id, fault): unknown endpoints, a passed relation without evidence, evidence whose file digest is not the recorded one,
    a concept id with two labels, a quote that is not in its text. evidence: relation_id, path, sha256, quote; files: path, text."""
    known = concepts.select(F.col("id").alias("end")).distinct()
    ends = relations.select("relation_id", F.explode(F.array("from_id", "to_id")).alias("end"))
    out = [
        ends.join(known, "end", "left_anti").select(F.col("relation_id").alias("id"), F.lit("unknown_endpoint").alias("fault")),
        relations.where("state = 'passed'").join(evidence, "relation_id", "left_anti").select(F.col("relation_id").alias("id"), F.lit("no_evidence").alias("fault")),
        concepts.groupBy("id").agg(F.countDistinct(F.lower("label")).alias("n")).where("n > 1").select("id", F.lit("two_labels").alias("fault")),
    ]
    e = evidence.join(files.select("path", "text", F.sha2("text", 256).alias("now")), "path", "left")
    out.append(e.where(F.col("now").isNull() | (F.col("now") != F.col("sha256"))).select(F.col("relation_id").alias("id"), F.lit("stale_evidence").alias("fault")))
    out.append(e.where(F.col("text").isNotNull() & ~F.contains("text", "quote")).select(F.col("relation_id").alias("id"), F.lit("quote_not_found").alias("fault")))
    return reduce(DataFrame.unionByName, out).distinct()


def agreement(proposed: DataFrame, verified: DataFrame, fields: list[str]) -> DataFrame:
    """(digest, state): claims of two readers matched by the digest of what they mean."""
    digest = F.sha2(F.to_json(F.struct(*(F.lower(F.trim(f)).alias(f) for f in fields))), 256)
    a = proposed.select(digest.alias("digest")).distinct().withColumn("first", F.lit(True))
    b = verified.select(digest.alias("digest")).distinct().withColumn("second", F.lit(True))
    state = F.when(F.col("second").isNull(), "only_proposed").when(F.col("first").isNull(), "only_verified").otherwise("agreed")
    return a.join(b, "digest", "full_outer").select("digest", state.alias("state"))
