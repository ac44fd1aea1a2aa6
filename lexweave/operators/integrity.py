"""Problem 4: references to records that do not exist (or not at that time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.session import staged


def deliveries(sections: DataFrame, *payload: str | Column) -> DataFrame:
    """One row per Expression (plain id, effective): ``payload`` of its latest delivery.

    Ties of loaded_at go to the greater payload; rows without an id are no Expressions. After this there is at most
    one row per work and day, so no work can hold more rows than the calendar has days.
    """
    cols = [F.col(x) if isinstance(x, str) else x for x in payload]
    kept = F.struct(*cols)
    orderable = F.struct(F.col("loaded_at"), F.hash(*cols), F.xxhash64(*cols))
    return (
        sections.select(names.plain_work("id").alias("id"), F.col("effective").cast("date").alias("effective"), kept.alias("kept"), orderable.alias("at"))
        .where(F.col("id").isNotNull())
        .groupBy("id", "effective")
        .agg(F.max_by("kept", "at").alias("kept"))
        .select("id", "effective", "kept.*")
    )


def highest_revisions(actions: DataFrame) -> DataFrame:
    """One row per action: target work and effective of its highest revision (then latest receipt, feed position)."""
    return (
        actions.select(
            names.plain_action("action_id").alias("action_id"),
            F.struct(names.plain_work("target_id").alias("work"), F.col("effective").cast("date").alias("effective")).alias("kept"),
            F.struct("revision", "received_at", "feed_pos").alias("at"),
        )
        .where(F.col("action_id").isNotNull())
        .groupBy("action_id")
        .agg(F.max_by("kept", "at").alias("kept"))
        .select("action_id", "kept.*")
    )


def references(expressions: DataFrame, actions: DataFrame) -> DataFrame:
    """(field, from_key, to_key, effective) of every named work or action; each named one once per referrer and field."""
    ids = F.transform("narrows", lambda n: n["id"])
    named = F.concat(
        F.transform(F.coalesce("amended_by", F.array()), lambda x: F.struct(F.lit("amended_by").alias("field"), names.plain_action(x).alias("to_key"))),
        F.transform(F.coalesce("overrides", F.array()), lambda x: F.struct(F.lit("overrides").alias("field"), names.plain_work(x).alias("to_key"))),
        F.transform(F.coalesce(ids, F.array()), lambda x: F.struct(F.lit("narrows").alias("field"), names.plain_work(x).alias("to_key"))),
    )
    from_sections = expressions.select(
        names.expression_id(F.col("id"), F.col("effective")).alias("from_key"), "effective", F.explode(F.array_distinct(named)).alias("r")
    ).select("r.field", "from_key", "r.to_key", "effective")
    from_actions = actions.select(F.lit("target_id").alias("field"), F.col("action_id").alias("from_key"), F.col("work").alias("to_key"), "effective")
    return from_sections.unionByName(from_actions).where(F.col("to_key").isNotNull())


def keys_without_record(keys: DataFrame, parents: DataFrame, key: str = "to_key") -> DataFrame:
    """Distinct non-null keys that no parent has: the anti-join the rest is built on."""
    return keys.select(key).where(F.col(key).isNotNull()).distinct().join(parents.select(key).distinct(), key, "left_anti")


def dates_without_text(dated: DataFrame, expressions: DataFrame) -> DataFrame:
    """Distinct (to_key, effective) at which the work has no text in force.

    As-of join without pairs: Expressions and asked dates are merged per work in date order and the last Expression
    so far is carried on. One work has at most a row per day on either side.
    """
    asked = dated.select("to_key", "effective").where(F.col("effective").isNotNull()).distinct()
    texts = expressions.select(F.col("id").alias("to_key"), "effective", F.struct(F.col("retired").cast("date").alias("retired")).alias("text"), F.lit(0).alias("side"))
    line = texts.unionByName(asked.select("to_key", "effective", F.lit(None).cast("struct<retired:date>").alias("text"), F.lit(1).alias("side")))
    sofar = Window.partitionBy("to_key").orderBy(F.col("effective").asc_nulls_first(), "side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        line.withColumn("last", F.last("text", ignorenulls=True).over(sofar))
        .where((F.col("side") == 1) & (F.col("last").isNull() | (F.col("last.retired") <= F.col("effective"))))
        .select("to_key", "effective")
    )


def orphans(sections: DataFrame, actions: DataFrame) -> DataFrame:
    """(field, from_key, to_key, ref_month) of the references that lead nowhere.

    A reference does if nothing has that id; if its referrer is dated and the work has no text then; or, for
    amended_by, if the action takes effect after the referrer. Null and empty names are no references; null dates
    are only checked for the id. Empty tables give no rows (an empty parent table makes every reference an orphan).
    """
    return _lost(*_staged_references(sections, actions))


def _staged_references(sections: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    expressions = staged(deliveries(sections, "retired", "amended_by", "overrides", "narrows"), "expressions")
    acts = staged(highest_revisions(actions), "revisions")
    return expressions, acts, staged(references(expressions, acts), "references")


def _lost(expressions: DataFrame, acts: DataFrame, refs: DataFrame) -> DataFrame:
    to_action = F.col("field") == "amended_by"
    works = refs.where(~to_action)
    no_work = keys_without_record(works, expressions.select(F.col("id").alias("to_key"))).withColumn("effective", F.lit(None).cast("date"))
    no_text = dates_without_text(works, expressions)
    # Either kind of finding is few keys; it is joined back to the references by key, or by key and day.
    found = no_work.unionByName(no_text.join(no_work.select("to_key"), "to_key", "left_anti"))
    bad_keys = found.where(F.col("effective").isNull()).select("to_key")
    bad_days = found.where(F.col("effective").isNotNull()).select("to_key", "effective")
    lost_works = works.join(bad_keys, "to_key", "left_semi").unionByName(
        works.join(bad_days, ["to_key", "effective"], "left_semi").select(*works.columns)
    )
    # Actions: the anti-join of distinct keys finds those nobody has; of the others, those that take effect too late.
    amended, there = refs.where(to_action), acts.select(F.col("action_id").alias("to_key"), F.col("effective").alias("acts_on"))
    no_action = keys_without_record(amended, there)
    late = amended.join(there.where("acts_on IS NOT NULL"), "to_key").where(F.col("acts_on") > F.col("effective"))
    lost_actions = amended.join(no_action, "to_key", "left_semi").select(*refs.columns).unionByName(late.select(*refs.columns))
    lost = lost_works.unionByName(lost_actions)
    return lost.select("field", "from_key", "to_key", names.month_of(F.col("effective")).alias("ref_month"))


def orphan_counts(sections: DataFrame, actions: DataFrame) -> DataFrame:
    """References, orphans and their rate per field and month of the referrer."""
    expressions, acts, found = _staged_references(sections, actions)
    refs = found.groupBy("field", names.month_of(F.col("effective")).alias("ref_month")).agg(F.count("*").alias("refs"))
    lost = _lost(expressions, acts, found).groupBy("field", "ref_month").agg(F.count("*").alias("orphans"), F.countDistinct("to_key").alias("orphan_keys"))
    return refs.join(lost, ["field", "ref_month"], "left").select(
        "field", "ref_month", "refs", F.coalesce("orphans", F.lit(0)).cast("bigint").alias("orphans"), F.coalesce("orphan_keys", F.lit(0)).cast("bigint").alias("orphan_keys")
    )
