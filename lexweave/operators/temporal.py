"""Dated versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import names


def in_order() -> Window:
    return Window.partitionBy("id").orderBy(F.col("effective").asc_nulls_first())


def as_of(expressions: DataFrame, day: str) -> DataFrame:
    """The text of every work in force on ``day``: the last with effective <= day (undated first); none if it is retired by
    then, with no way back to an older one. An aggregate, so no window over a hot work."""
    rest = [x for x in expressions.columns if x != "id"]
    d = F.lit(day).cast("date")
    last = (
        expressions.where(F.col("effective").isNull() | (F.col("effective") <= d))
        .groupBy("id")
        .agg(F.max_by(F.struct(*rest), F.coalesce("effective", F.lit("0001-01-01").cast("date"))).alias("x"))
        .select("id", "x.*")
    )
    return last.where(F.col("retired").isNull() | (F.col("retired") > d))


def active(expressions: DataFrame, day: str, include_superseded: bool = False) -> DataFrame:
    """Expressions that may be shown on ``day``: the ones in force, or every one published by then."""
    if include_superseded:
        return expressions.where(F.col("effective").isNull() | (F.col("effective") <= F.lit(day).cast("date")))
    return as_of(expressions, day)


def current(expressions: DataFrame) -> DataFrame:
    """The latest Expression without a successor, else the latest."""
    rest = [x for x in expressions.columns if x != "id"]
    key = F.struct(F.col("superseded_by").isNull(), F.coalesce("effective", F.lit("0001-01-01").cast("date")))
    return expressions.groupBy("id").agg(F.max_by(F.struct(*rest), key).alias("x")).select("id", "x.*")


def chain(expressions: DataFrame) -> DataFrame:
    """Each version with its number and the one before it."""
    w = in_order()
    return expressions.withColumn("version", F.row_number().over(w).cast("int")).withColumn("previous", F.lag(names.expression_id(F.col("id"), F.col("effective"))).over(w))


def chain_faults(expressions: DataFrame) -> DataFrame:
    """(id, effective, fault): declared links that are not those of the version order, or are not mutual."""
    w = in_order()
    me = names.expression_id(F.col("id"), F.col("effective"))
    x = expressions.select(
        "id", "effective", "supersedes", "superseded_by", F.lag(me).over(w).alias("before"), F.lead(me).over(w).alias("after"), F.lead("supersedes").over(w).alias("claimed"), me.alias("expr")
    )
    faults = F.array(
        F.when(F.col("supersedes").isNotNull() & ~F.col("supersedes").eqNullSafe(F.col("before")), "supersedes"),
        F.when(F.col("superseded_by").isNotNull() & ~F.col("superseded_by").eqNullSafe(F.col("after")), "superseded_by"),
        F.when(F.col("superseded_by").isNotNull() & F.col("after").isNotNull() & ~F.col("claimed").eqNullSafe(F.col("expr")), "not_mutual"),
    )
    return x.select("id", "effective", F.explode(F.array_compact(faults)).alias("fault"))


def with_actions(expressions: DataFrame, actions: DataFrame) -> DataFrame:
    """History rows (id, version, step, what): the actions a version names, before the version; none for the first."""
    c = chain(expressions)
    amends = c.where("version > 1").select("id", "version", F.lit(0).alias("step"), F.explode("amended_by").alias("what"))
    amends = amends.withColumn("what", names.plain_action("what")).join(actions.select(F.col("action_id").alias("what")), "what", "left_semi")
    return amends.select("id", "version", "step", "what").distinct().unionByName(c.select("id", "version", F.lit(1).alias("step"), names.expression_id(F.col("id"), F.col("effective")).alias("what")))


def compared(old: DataFrame, new: DataFrame, key: str, version: Column | str) -> DataFrame:
    """(key, change): added, changed or removed between two listings (a null version equals null)."""
    v = F.col(version) if isinstance(version, str) else version
    a = old.select(key, v.alias("v0"), F.lit(True).alias("in_old"))
    b = new.select(key, v.alias("v1"), F.lit(True).alias("in_new"))
    return (
        a.join(b, key, "full_outer")
        .withColumn("change", F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("v0").eqNullSafe(F.col("v1")), "changed"))
        .where(F.col("change").isNotNull())
        .select(key, "change")
    )
