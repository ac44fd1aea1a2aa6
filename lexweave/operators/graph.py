"""Cross references and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.session import staged


def edges(expressions: DataFrame) -> DataFrame:
    """(from_id, from_expr, to_id, anchor, type): overrides, narrows, supersedes, amends and defines of all Expressions, each
    once, without links of a work to itself (but for supersedes)."""
    me = names.expression_id(F.col("id"), F.col("effective"))
    none = F.lit("")
    edge = lambda type_, to, anchor=none: F.struct(F.lit(type_).alias("type"), to.alias("to_id"), anchor.alias("anchor"))
    arr = lambda x: F.coalesce(x, F.array())
    all_ = F.concat(
        F.transform(arr("overrides"), lambda x: edge("overrides", names.plain_work(x))),
        F.transform(arr("narrows"), lambda x: edge("narrows", names.plain_work(x["id"]), names.plain_anchor(x["anchor"]))),
        F.transform(arr("amended_by"), lambda x: edge("amends", names.plain_action(x))),
        F.transform(arr("defines"), lambda x: edge("defines", F.lower(F.trim(x)))),
        F.when(F.col("supersedes").isNotNull(), F.array(edge("supersedes", names.plain_work("supersedes")))).otherwise(F.array().cast("array<struct<type:string,to_id:string,anchor:string>>")),
    )
    out = expressions.select(F.col("id").alias("from_id"), me.alias("from_expr"), F.explode(F.array_distinct(all_)).alias("e")).select("from_id", "from_expr", "e.to_id", "e.anchor", "e.type")
    return out.where(F.col("to_id").isNotNull() & ((F.col("from_id") != F.col("to_id")) | (F.col("type") == "supersedes")))


def refs_in(edges_: DataFrame, types: list[str]) -> DataFrame:
    """References to each work (not distinct, unresolved ones too), without those from itself."""
    return edges_.where(F.col("type").isin(types) & (F.col("from_id") != F.col("to_id"))).groupBy("to_id").agg(F.count("*").alias("refs_in"))


def unresolved(edges_: DataFrame, works: DataFrame, types: list[str]) -> DataFrame:
    """Edges whose target is no work."""
    return edges_.where(F.col("type").isin(types)).join(works.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_anti")


def inverse(edges_: DataFrame, works: DataFrame, type_: str, name: str) -> DataFrame:
    """(id, name): the sorted works that point at each work with edges of one type; dangling targets fall away."""
    hit = edges_.where(F.col("type") == type_).join(works.select(F.col("id").alias("to_id")).distinct(), "to_id")
    return hit.groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_set("from_id")).alias(name))


def bfs(edges_: DataFrame, start: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(id, depth): works within ``depth`` steps of the start ids (start itself 0), each at its least depth.

    A round is one join of the frontier with the edges and one anti-join with what was seen; each is written out, so
    neither the plan nor the lineage grows with depth. It ends early when the frontier is empty.
    """
    out = edges_.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    back = edges_.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    step = {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()
    frontier = staged(start.select("id").distinct(), "frontier")
    levels = [frontier.withColumn("depth", F.lit(0))]
    for k in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, [x.select("id") for x in levels])
        frontier = staged(frontier.join(step, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(k)))
    return reduce(DataFrame.unionByName, levels)


def expanded(edges_: DataFrame, seeds: DataFrame, weights: dict[str, float], hops: int = 2, most: int = 200) -> DataFrame:
    """Connected expansion: seeds (id, score) pass score x weight / 1.5 along their edges, the best path counts, two hops.

    Of each hop the ``most`` best (ties by id) go on; the cap is the feature.
    """
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    arcs = edges_.where(F.col("type").isin(list(weights))).select("from_id", "to_id", weight[F.col("type")].alias("w"))
    seen = seeds.select("id", F.round("score", 6).alias("score"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        new = frontier.join(arcs, F.col("id") == F.col("from_id")).groupBy(F.col("to_id").alias("id")).agg(F.round(F.max(F.col("score") * F.col("w") / 1.5), 6).alias("score"))
        new = new.join(seen.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(most).withColumn("hop", F.lit(hop))
        frontier = staged(new, "hop")
        seen = seen.unionByName(frontier)
    return seen


def walk(tree: DataFrame, labels: DataFrame, pad: int = 9) -> DataFrame:
    """Preorder of a hierarchy: (id, root_id, depth, breadcrumb, sort_path), siblings by (ord, id).

    ``tree`` has paths (``hierarchy``), ``labels`` (id, label, ord). The sort path is built from the ancestors' keys, so
    ``orderBy(sort_path)`` walks every tree depth first.
    """
    key = labels.select(F.col("id").alias("node"), F.coalesce("label", F.lit("")).alias("label"), F.concat(F.lpad(F.coalesce("ord", F.lit(0)).cast("string"), pad, "0"), F.lit("/"), F.col("id")).alias("key"))
    steps = tree.where("depth >= 0").select("id", "root_id", "depth", F.posexplode("path").alias("pos", "node")).join(key, "node")
    return steps.groupBy("id", "root_id", "depth").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "key"))).alias("s")).select(
        "id", "root_id", "depth", F.array_join(F.transform("s", lambda x: x["label"]), " > ").alias("breadcrumb"), F.array_join(F.transform("s", lambda x: x["key"]), "|").alias("sort_path")
    )


def children(links: DataFrame, order: DataFrame) -> DataFrame:
    """(id, children): children sorted by (ord, id)."""
    kids = links.where("parent IS NOT NULL").join(order.select("id", "ord"), "id", "left")
    return kids.groupBy(F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(0)).alias("o"), "id"))), lambda x: x["id"]).alias("children"))


def within(rows: DataFrame, key: str, closure: DataFrame, scope: str) -> DataFrame:
    """Rows of works that are the scope or lie below it (closure: ancestor, id)."""
    inside = closure.where(F.col("ancestor") == scope).select(F.col("id").alias(key))
    return rows.where(F.col(key) == scope).unionByName(rows.where(F.col(key) != scope).join(inside, key, "left_semi").select(*rows.columns))


def over_subtree(tree_closure: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(id, least): the least value over a node and all below it."""
    own = values.select(F.col("id").alias("ancestor"), value)
    below = tree_closure.select("ancestor", "id").join(values.select("id", value), "id").select("ancestor", value)
    return own.unionByName(below).groupBy(F.col("ancestor").alias("id")).agg(F.min(value).alias("least"))


def held(links: DataFrame, held_ids: DataFrame, present: DataFrame) -> DataFrame:
    """Ids held back: those given, and all that link to a held one that is not present already, to a fixpoint.

    Each round asks only the links of what the round before it found, and writes only what is new; it ends when nothing is,
    after as many rounds as the longest chain of links has steps. Null ids hold nothing.
    """
    arcs = staged(links.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct(), "links")
    found = [staged(held_ids.select("id").where("id IS NOT NULL").distinct(), "held")]
    while True:
        bad = reduce(DataFrame.unionByName, found)
        open_ = found[-1].join(present.select("id"), "id", "left_anti").select(F.col("id").alias("to_id"))
        more = staged(arcs.join(open_, "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct().join(bad, "id", "left_anti"), "held")
        if more.isEmpty():
            return bad
        found.append(more)
        if len(found) % 16 == 0:  # the plan does not grow with the chain
            found = [staged(bad, "held"), more]


def registry_order(works: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_name, position): base sources first, then by falling precedence and name."""
    w = Window.orderBy(F.col("kind") != "base", F.desc("precedence"), "source_name")
    used = sources.join(works.select("source_name").distinct(), "source_name", "left_semi")
    return used.select("source_name", F.row_number().over(w).cast("int").alias("position"))


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the least id of each connected component of an undirected graph, by alternating large and small stars.

    Each round links every node's neighbours to its least one; rows stay of the order of the edges, a hub's neighbours are
    linked to the least node by a join on the pre-aggregated minimum, never gathered. Ends when no link changes.
    """
    links = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = pairs.select(F.explode(F.array(a, b)).alias("id")).where("id IS NOT NULL").distinct()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: greater neighbours of u to the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = staged(small, "links")
        if new.count() == links.count() and new.exceptAll(links).isEmpty():
            break
        links = new
    return nodes.join(links.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
