"""Problem 5: parent links to full hierarchies.

Components are found by pointer doubling (each node has one parent, so ``k`` joins reach ``2^k`` steps). Each
component is then co-located and walked by an iterative depth-first search with node colours, in linear time, which gives
root, depth, path and the cycles. Components above ``max_component`` nodes are never put into one task: for them root,
depth and cycle come from the doubling itself, and paths from doubling over path arrays, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.session import ship, staged

#: Largest component that one task may hold (about 400 bytes a node in Python).
MAX_COMPONENT = 1_000_000


def single_parent(rows: DataFrame, id: str = "id", parent: str = "parent", at: Column | None = None) -> DataFrame:
    """(id, parent) with one row per plain id. ``at`` orders rows of one id, the greatest counts (ties and no
    ``at``: the greatest plain parent, null lowest). Rows without an id are left out; a null, empty or unknown parent
    makes a root."""
    p = names.plain_work(parent)
    key = F.struct(at.alias("at"), p.alias("p")) if at is not None else F.struct(p.alias("p"))
    one = (
        rows.select(names.plain_work(id).alias("id"), F.struct(p.alias("parent")).alias("kept"), key.alias("key"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max_by("kept", "key").alias("kept"))
        .select("id", "kept.parent")
    )
    there = one.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    return one.join(there, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent"))


def doubled(links: DataFrame) -> DataFrame:
    """(id, parent, component, dist, rooted): the root and the distance to it, or the smallest id on the cycle.

    Rounds go on until every node has met a root, or until a round lets no further node meet one and ``2^k`` is not below
    the number of those left. As long as a rooted node is open, so is the one of depth ``2^k`` above it (or itself), and the
    next round closes that; so those left have no root. No way to a cycle nor the cycle is longer than their number: ``2^k``
    steps ahead they stand on it, and the least id of the ``2^k`` nodes from there is the least of the cycle.

    Only open nodes are joined and written again; those that have met a root stay where they were written.
    """
    start = staged(links.select("id", "parent"), "links")
    done = [start.where("parent IS NULL").select("id", "parent", F.col("id").alias("jump"), F.lit(0).cast("bigint").alias("dist"))]
    now = start.where("parent IS NOT NULL").select("id", "parent", F.col("parent").alias("jump"), F.lit(1).cast("bigint").alias("dist"), F.col("id").alias("least"))
    k, before, open_ = 0, None, now.count()
    while open_ and not (open_ == before and 2**k >= open_):
        before = open_
        met = reduce(DataFrame.unionByName, done).select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("dist").alias("dist2"), F.lit(None).cast("string").alias("least2"))
        ahead = met.unionByName(now.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("dist").alias("dist2"), F.col("least").alias("least2")))
        moved = staged(
            now.join(ahead, "jump").select(
                "id", "parent", F.col("jump2").alias("jump"), (F.col("dist") + F.col("dist2")).alias("dist"), F.when(F.col("least2").isNotNull(), F.least("least", "least2")).alias("least")
            ),
            "links",
        )
        done.append(moved.where("least IS NULL").drop("least"))
        now = moved.where("least IS NOT NULL")
        open_, k = now.count(), k + 1
    rooted = reduce(DataFrame.unionByName, done).select("id", "parent", F.col("jump").alias("component"), "dist", F.lit(True).alias("rooted"))
    if open_ == 0:
        return rooted
    least = now.select(F.col("id").alias("jump"), F.col("least").alias("component"))
    return rooted.unionByName(now.select("id", "parent", "jump").join(least, "jump").select("id", "parent", "component", F.lit(-1).cast("bigint").alias("dist"), F.lit(False).alias("rooted")))


WALK_SCHEMA = "id string, parent string, component string, root_id string, depth int, path array<string>, back_edge boolean"
WHITE, GREY, BLACK = 0, 1, 2


def _walk(ids: list, parents: list) -> tuple[list[int], list[int], list[int], set[int]]:
    """Depth-first search along the parent links of whole components, with node colours and in linear time.

    (parent, root or least node of the cycle, depth or -1) of every node as positions, and the least node of each cycle.
    """
    at = {x: i for i, x in enumerate(ids)}
    up = [-1 if p is None else at[p] for p in parents]
    colour, root, depth, back = bytearray(len(ids)), [0] * len(ids), [-1] * len(ids), set()
    for start in range(len(ids)):
        trail, node = [], start
        while node >= 0 and colour[node] == WHITE:
            colour[node] = GREY
            trail.append(node)
            node = up[node]
        if not trail:
            continue
        if node < 0:
            top = trail.pop()
            root[top], depth[top], colour[top] = top, 0, BLACK
        elif colour[node] == GREY:  # the edge to a grey node closes a cycle
            cycle, x = [node], up[node]
            while x != node:
                cycle.append(x)
                x = up[x]
            least = min(cycle, key=ids.__getitem__)
            back.add(least)
            for x in cycle:
                root[x], colour[x] = least, BLACK
        for x in reversed(trail):
            if colour[x] != BLACK:
                root[x], colour[x] = root[up[x]], BLACK
                depth[x] = depth[up[x]] + 1 if depth[up[x]] >= 0 else -1
    return up, root, depth, back


def _walk_components(with_paths: bool, most: int = 1_000_000):
    """Batches sorted by component to the rows of ``hierarchy``; paths are built a slice of about ``most`` entries at a time."""

    def walked(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids = pdf["id"].tolist()
        up, root, depth, back = _walk(ids, [None if x is None or x != x else x for x in pdf["parent"]])
        out = pdf[["id", "parent", "component"]].reset_index(drop=True)
        out["root_id"] = [ids[r] for r in root]
        out["depth"] = pd.array(depth, dtype="int32")
        out["path"] = None
        out["back_edge"] = [i in back for i in range(len(ids))]
        if not with_paths:
            yield out
            return
        start = held = 0
        for i in range(len(ids) + 1):
            if i == len(ids) or held > most:
                part = out.iloc[start:i].copy()
                part["path"] = [_path(ids, up, j) if depth[j] >= 0 else None for j in range(start, i)]
                yield part
                start, held = i, 0
            if i < len(ids):
                held += depth[i] + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:  # sorted by component: all but the last one are whole
            if pdf.empty:
                continue
            last = pdf["component"] == pdf["component"].iloc[-1]
            goes_on = bool(held) and held[-1]["component"].iloc[-1] == pdf["component"].iloc[0]
            if goes_on and last.all():
                held.append(pdf)
                continue
            if held and not goes_on:
                yield from walked(pd.concat(held))
                held = []
            whole = pd.concat([*held, pdf[~last]])
            if len(whole):
                yield from walked(whole)
            held = [pdf[last]]
        if held:
            yield from walked(pd.concat(held))

    return run


def _path(ids: list, up: list[int], node: int) -> list:
    out = []
    while node >= 0:
        out.append(ids[node])
        node = up[node]
    return out[::-1]


def hierarchy(links: DataFrame, with_paths: bool = True, max_component: int = MAX_COMPONENT) -> DataFrame:
    """(id, parent, component, root_id, depth, path, back_edge) of every node of ``links`` (``single_parent``).

    path runs from the root to the node. A node that never reaches a root has depth -1, no path and the least id of its
    cycle as root_id; back_edge marks one node per cycle, its least one, whose parent link counts as the one that closes it.
    Neither the order of rows nor ``max_component`` (where a component is walked) changes the result.
    """
    ship(links.sparkSession)
    all_ = staged(doubled(links), "components")
    small, sizes = all_, all_.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > max_component).select("component")
    large = None
    if all_.isEmpty() or not sizes.isEmpty():
        small, large = all_.join(sizes, "component", "left_anti"), all_.join(sizes, "component", "left_semi")
    walked = (
        small.select("id", "parent", "component").repartition("component").sortWithinPartitions("component").mapInPandas(_walk_components(with_paths), WALK_SCHEMA)
    )
    if large is None:
        return walked
    if with_paths:
        large = large.join(_paths(large), "id", "left")
    else:
        large = large.withColumn("path", F.lit(None).cast("array<string>"))
    return walked.unionByName(
        large.select(
            "id", "parent", "component", F.col("component").alias("root_id"), F.col("dist").cast("int").alias("depth"), "path", (~F.col("rooted") & (F.col("id") == F.col("component"))).alias("back_edge")
        )
    )


MARK = "\x1f"


def forest(trees: dict[str, DataFrame], with_paths: bool = True, max_component: int = MAX_COMPONENT) -> DataFrame:
    """``hierarchy`` of several sets of links at once, with the set's name as ``tree``: one set of rounds serves all.

    Ids carry the name while they are walked, so equal ids of two sets stay apart.
    """
    named = [df.select(F.concat(F.lit(tree + MARK), "id").alias("id"), F.concat(F.lit(tree + MARK), "parent").alias("parent")) for tree, df in trees.items()]
    out = hierarchy(reduce(DataFrame.unionByName, named), with_paths, max_component)
    bare = lambda x: F.substring_index(x, MARK, -1)
    return out.select(
        F.substring_index("id", MARK, 1).alias("tree"), *(bare(x).alias(x) for x in ("id", "parent", "component", "root_id")), "depth", F.transform("path", bare).alias("path"), "back_edge"
    )


def _paths(nodes: DataFrame) -> DataFrame:
    """Paths of rooted nodes by doubling: each round a node's path is prefixed by that of the first node above it."""
    rooted = nodes.where("rooted").select("id", "parent", "dist")
    now = rooted.select("id", F.array("id").alias("path"), F.col("parent").alias("up"))
    deepest = rooted.agg(F.max("dist")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        above = now.select(F.col("id").alias("up"), F.col("path").alias("path2"), F.col("up").alias("up2"))
        now = staged(now.join(above, "up", "left").select("id", F.concat(F.coalesce("path2", F.array().cast("array<string>")), "path").alias("path"), F.col("up2").alias("up")), "paths")
        reach *= 2
    return now.select("id", "path")


def descendants(tree: DataFrame, *keep: str) -> DataFrame:
    """(ancestor, id, distance) of every node and each node above it, from the paths of ``hierarchy``; ``keep`` goes along.

    One row per pair of a node and an ancestor is the result itself; cycles have none.
    """
    return (
        tree.where(F.col("depth") > 0)
        .select(*keep, "id", "depth", F.posexplode("path").alias("pos", "ancestor"))
        .where(F.col("pos") < F.col("depth"))
        .select(*keep, "ancestor", "id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
    )


def node_links(nodes: DataFrame) -> DataFrame:
    return single_parent(nodes)


def section_links(sections: DataFrame) -> DataFrame:
    """Parent in the Expression with the greatest effective (undated lowest), then the latest loaded_at."""
    return single_parent(sections, at=F.struct(F.col("effective"), F.col("loaded_at")))
