"""Corpus contract as one table of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.functions import text as T
from lexweave.operators import hierarchy


def issues(sections: DataFrame, sources: DataFrame, actions: DataFrame) -> DataFrame:
    """(rel_path, check, severity): every rule that a delivered section breaks, once per row and rule."""
    reg = sources.groupBy("source_name").agg(F.first("id_prefix").alias("prefix"), F.max("precedence").alias("precedence"), F.first("kind").alias("source_kind"), F.lit(True).alias("known"))
    s = sections.join(reg, "source_name", "left")
    w = names.plain_work("id")
    works = sections.select(w.alias("up")).where("up IS NOT NULL").distinct().withColumn("parent_there", F.lit(True))
    s = s.withColumn("up", names.plain_work("parent")).join(works, "up", "left")
    rules = [
        ("unknown_source", "error", F.col("known").isNull()),
        ("missing_id", "error", w.isNull()),
        ("missing_title", "error", names.trimmed("title").isNull()),
        ("missing_level", "error", names.trimmed("level_name").isNull()),
        ("wrong_prefix", "error", F.col("prefix").isNotNull() & w.isNotNull() & (F.substring_index(w, ":", 1) != F.col("prefix"))),
        ("kind_differs", "error", F.col("source_kind").isNotNull() & F.col("kind").isNotNull() & (F.col("kind") != F.col("source_kind"))),
        ("no_effective", "warning", F.col("effective").isNull()),
        ("retired_before_effective", "error", F.col("retired") <= F.col("effective")),
        ("published_after_effective", "warning", F.col("published") > F.col("effective")),
        ("unknown_parent", "error", F.col("up").isNotNull() & F.col("parent_there").isNull()),
        ("own_parent", "error", F.col("up") == w),
        ("empty_body", "warning", names.trimmed("body").isNull()),
        ("overrides_in_base", "error", (F.col("kind") == "base") & (F.size(F.coalesce("overrides", F.array())) > 0)),
        ("low_confidence", "warning", F.col("confidence") < 0.7),
        ("unknown_legal_status", "error", ~F.coalesce("legal_status", F.lit("")).isin("official", "unofficial-xml", "derived")),
    ]
    found = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"))) for name, severity, cond in rules)))
    per_row = s.select("rel_path", F.explode(found).alias("i")).select("rel_path", "i.check", "i.severity")
    # Rules over several rows: repeated Expressions, unknown actions.
    expr = names.expression_id(w, F.col("effective"))
    counted = sections.where(w.isNotNull()).groupBy(expr.alias("expr")).agg(F.count("*").alias("n"), F.min("rel_path").alias("rel_path")).where("n > 1")
    twice = counted.select("rel_path", F.lit("repeated_expression").alias("check"), F.lit("error").alias("severity"))
    named = sections.select("rel_path", F.explode("amended_by").alias("x")).select("rel_path", names.plain_action("x").alias("action_id")).where("action_id IS NOT NULL")
    lost = named.join(actions.select(names.plain_action("action_id").alias("action_id")).distinct(), "action_id", "left_anti").select("rel_path").distinct()
    return per_row.unionByName(twice).unionByName(lost.select("rel_path", F.lit("unknown_action").alias("check"), F.lit("error").alias("severity")))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("check", "severity").agg(F.count("*").alias("n"))


def cyclic_works(links: DataFrame) -> DataFrame:
    """Works whose way up never ends."""
    return hierarchy.hierarchy(links, with_paths=False).where("depth = -1").select("id", "root_id")


def incomplete_actions(actions: DataFrame) -> DataFrame:
    """(action_id, revision, fault): no target, no date, or no text where the verb needs one."""
    kind = names.action_kind("kind")
    faults = F.array_compact(
        F.array(
            F.when(names.plain_work("target_id").isNull(), "no_target"),
            F.when(F.col("effective").isNull(), "no_date"),
            F.when(kind.isin("add", "amend", "redesignate") & names.trimmed("text").isNull(), "no_text"),
        )
    )
    return actions.select("action_id", "revision", F.explode(faults).alias("fault")).distinct()


def precedence_faults(sections: DataFrame, sources: DataFrame) -> DataFrame:
    """Overlay sections whose source does not stand above the source of the work they override."""
    p = sources.groupBy("source_name").agg(F.max("precedence").alias("precedence"))
    owner = sections.select(names.plain_work("id").alias("to_id"), "source_name").where("to_id IS NOT NULL").groupBy("to_id").agg(F.min("source_name").alias("source_name"))
    owner = owner.join(p, "source_name").select("to_id", F.col("precedence").alias("base"))
    over = sections.select(names.plain_work("id").alias("id"), "source_name", F.explode("overrides").alias("x")).select("id", "source_name", names.plain_work("x").alias("to_id"))
    return over.join(p, "source_name").join(owner, "to_id").where(F.col("precedence") <= F.col("base")).select("id", "to_id").distinct()


def held_lines(elements: DataFrame, flags: tuple[str, ...] = ("ocr_unverified", "ocr_divergent", "no_text_layer")) -> DataFrame:
    """Files that may not be published: some line carries a holding flag."""
    bad = F.arrays_overlap("flags", F.array(*(F.lit(f) for f in flags)))
    return elements.where(bad).select("doc_sha").distinct()


def similar_contexts(rows: DataFrame, group: str, text: str, least: float = 0.8, few: int = 256) -> DataFrame:
    """(group, a, b, jaccard): unequal texts of one group whose words (over two letters) overlap by ``least`` or more, a < b.

    Groups of up to ``few`` texts compare each with each. In larger ones a prefix filter comes first: only texts that share one
    of their rarest words are compared, which loses no pair. Null groups and texts are left out, repeated texts count once.
    No join is broadcast: Spark takes a text's words for one row, so it would send the driver far more than it expects.
    """
    bound = least - 1e-6  # what is rounded up to ``least`` counts
    merge = lambda a, b, on: a.join(b.hint("merge"), on)
    words = F.array_distinct(F.filter(T.tokens("t"), lambda x: F.length(x) > 2))
    t = rows.select(F.col(group).alias("g"), F.col(text).alias("t")).where("g IS NOT NULL AND t IS NOT NULL").distinct()
    t = merge(t, t.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "g")

    def alike(na: Column, nb: Column) -> Column:
        return (F.least(na, nb) > 0) & (F.least(na, nb) >= bound * F.greatest(na, nb))

    def scored(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("wa", "wb"))
        return pairs.withColumn("jaccard", F.round(F.try_divide(both, F.size("wa") + F.size("wb") - both), 6)).where(F.col("jaccard") >= least)

    side = lambda x: t.where(F.col("n") <= few).select("g", F.col("t").alias(x), words.alias(f"w{x}"))
    direct = scored(merge(side("a"), side("b"), "g").where((F.col("a") < F.col("b")) & alike(F.size("wa"), F.size("wb"))))

    # A large group's texts are spread over the tasks; digests stand for them until pairs are found.
    # (explode_outer: for explode Spark would split all texts once more, where the rows are read; texts without words fall out in the join)
    m = t.where(F.col("n") > few).select("g", "t").repartition("g", "t").select("g", "t", F.coalesce(F.unhex(F.sha2("t", 256)), F.lit(b"")).alias("k"), words.alias("w"))
    df = m.select("g", F.explode_outer("w").alias("word")).groupBy("g", "word").agg(F.count("*").alias("n"))
    ranked = merge(m.select("g", "k", F.size("w").alias("size"), F.explode_outer("w").alias("word")), df, ["g", "word"])
    w = Window.partitionBy("g", "k").orderBy("n", "word")
    prefix = ranked.withColumn("place", F.row_number().over(w)).where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * bound) + 1) & (F.col("n") > 1))
    end = lambda x: prefix.select("g", "word", F.col("k").alias(f"k{x}"), F.col("size").alias(f"n{x}"))
    found = merge(end("a"), end("b"), ["g", "word"]).where((F.col("ka") < F.col("kb")) & alike(F.col("na"), F.col("nb"))).select("g", "ka", "kb").distinct()
    full = lambda x: m.select("g", F.col("k").alias(f"k{x}"), F.col("t").alias(x), F.col("w").alias(f"w{x}"))
    indirect = scored(merge(merge(found, full("a"), ["g", "ka"]), full("b"), ["g", "kb"]))

    out = direct.select("g", "a", "b", "jaccard").union(indirect.select("g", F.least("a", "b"), F.greatest("a", "b"), "jaccard"))
    return out.withColumnRenamed("g", group)


def round_trip(published: DataFrame, source: DataFrame, key: str, text: str, exact: bool = True) -> DataFrame:
    """(key, state): passed if the published tokens are the source's in order (``exact``), or a run within them; failed; or
    missing for no source."""
    a = published.select(key, F.coalesce(T.tokens(T.plain(text)), F.array().cast("array<string>")).alias("a"))
    b = source.select(key, F.coalesce(T.tokens(T.plain(text)), F.array().cast("array<string>")).alias("b"), F.lit(True).alias("there"))
    same = (F.col("a") == F.col("b")) if exact else T.holds_run(F.col("b"), F.col("a"))
    return a.join(b, key, "left").select(key, F.when(F.col("there").isNull(), "missing").when(same, "passed").otherwise("failed").alias("state"))


def unlocated_tables(published: DataFrame, source: DataFrame, key: str, grid: str) -> DataFrame:
    """Keys of published tables whose cells (blanks squeezed, case-blind) are those of no source table of the same key."""
    norm = lambda g: F.transform(g, lambda r: F.transform(r, lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))))
    a = published.select(key, F.sha2(F.to_json(norm(F.col(grid))), 256).alias("digest"))
    b = source.select(key, F.sha2(F.to_json(norm(F.col(grid))), 256).alias("digest"))
    return a.join(b, [key, "digest"], "left_anti").select(key).distinct()


def stale_bindings(checks: DataFrame, inputs: DataFrame) -> DataFrame:
    """(item, stale): a check holds only while the digest of all its inputs, in order of name, is the one it was bound to.

    checks: item, bound; inputs: item, name, digest.
    """
    now = inputs.groupBy("item").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "digest"))), "\n"), 256).alias("now"))
    return checks.join(now, "item", "left").select("item", (~F.col("bound").eqNullSafe(F.col("now"))).alias("stale"))
