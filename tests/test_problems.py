"""Problems 2, 4, 5 and 6 on small fixtures against plain Python."""

import random
import time
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexweave.operators import hierarchy, history, incremental, integrity

T0 = datetime(2024, 1, 1)


# ---- 2

def test_changed_since_last_good(spark):
    runs = spark.createDataFrame(
        [(7, T0, None, "running"), (7, T0, T0, "ok"), (3, T0 + timedelta(1), None, "running"), (5, T0 + timedelta(2), None, "failed"), (4, T0 + timedelta(3), None, "OK "), (9, T0 + timedelta(4), None, None)],
        "run_id bigint, started_at timestamp, finished_at timestamp, state string",
    )
    rows = [
        (7, "a.md", "AA", 1), (7, "./b.md", "BB", 1), (7, "c.md", None, 1),
        (3, "a.md", "aa", 1), (3, "b.md", "b2", 1),
        (5, "a.md", "a2", 1), (5, "c.md", "cc", 1), (5, "c.md", "c0", 0),
        (4, "x\\d.md", "dd", 1), (4, "a.md", "aa", 1), (4, "a.md", "aa", 1), (4, "b.md", None, 2), (4, "b.md", "bb", 1),
        (9, "a.md", "aa", 1), (9, "x/d.md", "d2", 1), (9, "b.md", "bb", 1), (None, "z", "z", 1), (9, None, "z", 1),
        (1, "a.md", "aa", 1),
    ]
    fp = spark.createDataFrame([(r, "s", p, b, T0 + timedelta(hours=h), 5, 5) for r, p, b, h in rows], "run_id bigint, source_name string, rel_path string, blake3 string, listed_at timestamp, version int, base_id int")
    got = sorted(map(tuple, incremental.changed_since_last_good(fp, runs).collect()))
    assert got == sorted([(7, "a.md"), (7, "b.md"), (3, "b.md"), (5, "a.md"), (5, "c.md"), (4, "x/d.md"), (9, "x/d.md"), (9, "b.md"), (1, "a.md")])
    assert incremental.changed_since_last_good(fp.limit(0), runs).count() == 0
    assert incremental.changed_since_last_good(fp, runs.limit(0)).count() == len({(r, p) for r, p in [(7, "a"), (7, "b"), (3, "a"), (3, "b"), (5, "a"), (5, "c"), (4, "x"), (4, "a"), (9, "a"), (9, "x"), (9, "b"), (1, "a")]})


def test_versioned_target(spark, tmp_path):
    target = incremental.VersionedTarget(spark, f"file://{tmp_path}/t", ["k"], "v")
    df = lambda rows: spark.createDataFrame(rows, "k string, v string, x int")
    seen = []

    def process(fresh):
        seen.append(sorted(r.k for r in fresh.collect()))
        return fresh.select("k", "v", (F.col("x") * 10).alias("y"))

    now = lambda: {(r.k, r.v, r.y) for r in target.current().collect()}
    assert target.current() is None
    target.run(df([("a", "1", 1), ("b", "1", 2)]), process)
    assert seen == [["a", "b"]] and now() == {("a", "1", 10), ("b", "1", 20)}

    # A run that dies while it processes, or after its outputs are written, publishes nothing and loses nothing.
    def dies(fresh):
        raise OSError("lost")

    source = df([("a", "2", 3), ("b", "1", 2), ("c", None, 4)])
    with pytest.raises(OSError):
        target.run(source, dies)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(incremental, "put_if_absent", dies_late := lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            target.run(source, process)
    assert dies_late and now() == {("a", "1", 10), ("b", "1", 20)}
    target.run(source, process)
    assert seen[1:] == [["a", "c"], ["a", "c"]] and now() == {("a", "2", 30), ("b", "1", 20), ("c", None, 40)}
    assert {r.k for r in target.changes(1).collect()} == {"a", "c"}
    # A source that delivers a part leaves the other keys; a complete one takes them away; null versions come again.
    target.run(df([("c", None, 5)]), process)
    assert seen[-1] == ["c"] and now() == {("a", "2", 30), ("b", "1", 20), ("c", None, 50)}
    target.run(df([("a", "2", 9)]), process, complete=True)
    assert seen[-1] == [] and now() == {("a", "2", 30)}
    # Of two runs from one version the second is refused and can be repeated.
    order = target.pointers()[-1]
    target.publish(df([("z", "1", 1)]).select("k", "v", F.col("x").alias("y")), order)
    with pytest.raises(incremental.Conflict):
        target.publish(df([("q", "1", 1)]).select("k", "v", F.col("x").alias("y")), order)
    assert now() == {("z", "1", 1)}
    target.prune(1)
    assert now() == {("z", "1", 1)} and len(target.pointers()) == 1
    assert target.run(df([("z", "2", 2)]), process) == order + 2 and now() == {("z", "2", 20)}


# ---- 4

SECTION = "id string, effective date, retired date, superseded_by string, parent string, title string, body string, amended_by array<string>, overrides array<string>, narrows array<struct<id:string,anchor:string>>, loaded_at timestamp"
ACTION = "action_id string, target_id string, effective date, revision int, received_at timestamp, feed_pos bigint"


def section(id_, eff, ret=None, am=None, ov=None, na=None, at=0, by=None, parent=None, title="t", body="b"):
    return (id_, eff, ret, by, parent, title, body, am, ov, na, T0 + timedelta(hours=at))


def test_orphans(spark):
    d = date
    sections = spark.createDataFrame(
        [
            section("UCR:1-1", d(2020, 1, 1), am=["RN:2020-1#instr-1", "rn:2020-9#instr-9 ", None], ov=["UCR:9-9", " ucr:1-2 ", "UCR:1-2@2019-01-01"], na=[("UCR:1-2#a", None), None, (None, "x")]),
            section("UCR:1-1", d(2020, 1, 1), at=-1, ov=["UCR:0-0"]),
            section("UCR:1-2", d(2021, 1, 1)),
            section("UCR:1-3", None, ret=d(2020, 6, 1), ov=["UCR:1-2", "UCR:7-7"]),
            section("UCR:1-4", d(2022, 1, 1), ov=["UCR:1-3", "UCR:1-2"]),
            section(None, d(2022, 1, 1), ov=["UCR:8-8"]),
        ],
        SECTION,
    )
    actions = spark.createDataFrame(
        [
            ("RN:2020-1#instr-1", "UCR:1-1", d(2020, 2, 1), 2, T0, 1), ("RN:2020-1#instr-1", "UCR:6-6", d(2019, 2, 1), 1, T0, 2),
            ("RN:2020-2#instr-1", "UCR:1-1", d(2019, 2, 1), 1, T0, 3), ("RN:2020-3#instr-1", "UCR:5-5", None, 1, T0, 4), ("RN:2020-4#instr-1", None, None, 1, T0, 5),
        ],
        ACTION,
    )
    got = sorted(map(tuple, integrity.orphans(sections, actions).collect()))
    assert got == sorted(
        [
            ("amended_by", "UCR:1-1@2020-01-01", "RN:2020-1#instr-1", "2020-01"),
            ("amended_by", "UCR:1-1@2020-01-01", "RN:2020-9#instr-9", "2020-01"),
            ("overrides", "UCR:1-1@2020-01-01", "UCR:9-9", "2020-01"),
            ("overrides", "UCR:1-1@2020-01-01", "UCR:1-2", "2020-01"),
            ("narrows", "UCR:1-1@2020-01-01", "UCR:1-2", "2020-01"),
            ("overrides", "UCR:1-3", "UCR:7-7", ""),
            ("overrides", "UCR:1-4@2022-01-01", "UCR:1-3", "2022-01"),
            ("target_id", "RN:2020-2#instr-1", "UCR:1-1", "2019-02"),
            ("target_id", "RN:2020-3#instr-1", "UCR:5-5", ""),
        ]
    )
    assert integrity.orphans(sections.limit(0), actions).count() == 3
    assert integrity.orphans(sections.limit(0), actions.limit(0)).count() == 0


# ---- 5

def plain_tree(parent):
    out = {}
    for x in parent:
        trail, node = [], x
        while parent.get(node) is not None and node not in trail:
            trail.append(node)
            node = parent[node]
        if node in trail:
            out[x] = (min(trail[trail.index(node) :]), -1)
        else:
            out[x] = (node, len(trail))
    return out


@pytest.mark.parametrize("largest", [1_000_000, 3])
def test_random_trees(spark, largest):
    rnd = random.Random(9)
    ids = [f"UCR:{i}-1" for i in range(300)]
    parent = {x: rnd.choice([None, "", "UCR:gone", *ids[:60]]) if rnd.random() < 0.5 else f"UCR:{max(0, i - rnd.randint(1, 3))}-1" for i, x in enumerate(ids)}
    parent[ids[0]] = ids[40]
    rows = [(x, p) for x, p in parent.items()] + [(f" {x.lower()}#a", p) for x, p in list(parent.items())[:20]] + [(None, "x"), ("", "x")]
    known = {x: (p if p in parent else None) for x, p in parent.items()}
    want = plain_tree(known)
    tree = hierarchy.hierarchy(hierarchy.single_parent(spark.createDataFrame(rows, "id string, parent string")), max_component=largest).cache()
    got = tree.collect()
    assert {r.id: (r.root_id, r.depth) for r in got} == want and len(got) == len(want)
    for r in got:
        if r.depth >= 0:
            assert r.path[0] == r.root_id and r.path[-1] == r.id and len(r.path) == r.depth + 1
            assert all(known[b] == a for a, b in zip(r.path, r.path[1:]))
        else:
            assert r.path is None
    assert sum(r.back_edge for r in got) == len({r.root_id for r in got if r.depth < 0})
    pairs = {(r.ancestor, r.id, r.distance) for r in hierarchy.descendants(tree).collect()}
    assert pairs == {(r.path[i], r.id, r.depth - i) for r in got if r.depth > 0 for i in range(r.depth)}


@pytest.mark.parametrize("largest", [1_000_000, 3])
@pytest.mark.parametrize("depth", [4, 9, 10, 20, 44])
def test_deep_chains(spark, depth, largest):
    """The greatest id is the root, and the few deepest nodes are open last."""
    ids = [f"UCR:{999 - d}-1" for d in range(depth + 1)]
    parent = dict(zip(ids, [None, *ids]))
    got = hierarchy.hierarchy(hierarchy.single_parent(spark.createDataFrame([*parent.items()], "id string, parent string")), max_component=largest).collect()
    assert {r.id: (r.root_id, r.depth) for r in got} == plain_tree(parent) and len(got) == len(parent)
    assert {r.id: r.path for r in got if r.depth >= 0} == {x: ids[: d + 1] for d, x in enumerate(ids)}


def test_cycles_do_not_depend_on_order_or_size(spark):
    rows = [("c", "a"), ("a", "b"), ("b", "c"), ("x", "b"), ("y", "x"), ("z", "z"), ("r", None), ("s", "r")]
    seen = set()
    for order, largest in ((rows, 100), (rows[::-1], 100), (rows, 1), (rows[::-1], 2)):
        links = spark.createDataFrame(order, "id string, parent string").coalesce(1)
        got = {(r.id, r.root_id, r.depth, tuple(r.path or ()), r.back_edge) for r in hierarchy.hierarchy(links, max_component=largest).collect()}
        seen.add(frozenset(got))
    assert len(seen) == 1
    (got,) = seen
    assert {g[0] for g in got if g[4]} == {"a", "z"} and {g[:3] for g in got if g[0] in "xyz"} == {("x", "a", -1), ("y", "a", -1), ("z", "z", -1)}


def test_long_chain_is_linear():
    n = 1_000_000
    ids = [f"n{i:07}" for i in range(n)]
    began = time.time()
    _, root, depth, back = hierarchy._walk(ids[::-1], [None if i == 0 else ids[i - 1] for i in range(n)][::-1])
    assert depth[0] == n - 1 and depth[-1] == 0 and set(root) == {n - 1} and not back
    ring = [ids[(i + 1) % n] for i in range(n)]
    _, root, depth, back = hierarchy._walk(ids, ring)
    assert back == {0} and set(root) == {0} and set(depth) == {-1}
    assert time.time() - began < 30


def test_forest(spark):
    links = lambda rows: spark.createDataFrame(rows, "id string, parent string")
    got = hierarchy.forest({"one": links([("a", None), ("b", "a")]), "two": links([("a", "b"), ("b", None)])}).collect()
    assert {(r.tree, r.id, r.parent, r.root_id, r.depth, tuple(r.path)) for r in got} == {
        ("one", "a", None, "a", 0, ("a",)), ("one", "b", "a", "a", 1, ("a", "b")), ("two", "b", None, "b", 0, ("b",)), ("two", "a", "b", "b", 1, ("b", "a")),
    }


def test_empty_tree(spark):
    assert hierarchy.hierarchy(hierarchy.single_parent(spark.createDataFrame([], "id string, parent string"))).count() == 0


# ---- 6

def plain_history(rows):
    best = {}
    for r in rows:
        if r[0] is not None and ((r[0], r[1]) not in best or r[10] > best[r[0], r[1]][10]):
            best[r[0], r[1]] = r
    works = defaultdict(list)
    for r in best.values():
        works[r[0]].append(r)
    out = set()
    for w, versions in works.items():
        versions.sort(key=lambda r: str(r[1] or ""))
        kept = []
        for i, r in enumerate(versions):
            start = str(r[1] or "")
            ends = [str(versions[i + 1][1])] if i + 1 < len(versions) else []
            ends += [str(r[2])] if r[2] else []
            by = (r[3] or "").partition("@")[2]
            ends += [by] if by and by > start else []
            end = min(ends, default="9")
            if end > start:
                if kept and kept[-1][1] == start and kept[-1][2:] == [r[5], r[6]]:
                    kept[-1][1] = end
                else:
                    kept.append([start, end, r[5], r[6]])
        out |= {(w, a, "" if b == "9" else b) for a, b, *_ in kept}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories(spark, seed):
    rnd = random.Random(seed)
    day = lambda: date(2020, 1, 1) + timedelta(days=rnd.randint(0, 40))
    rows = []
    for i in range(500):
        rows.append(
            section(
                f"UCR:1-{rnd.randint(1, 40)}",
                day() if rnd.random() > 0.1 else None,
                ret=day() if rnd.random() < 0.2 else None,
                by=rnd.choice([None, "UCR:1-1", f"UCR:1-1@{day()}"]),
                at=i,
                title=rnd.choice(["t", "u", None]),
                body=rnd.choice(["b", None]),
            )
        )
    rows += rows[:30]
    df = spark.createDataFrame(rows + [section(None, day())], SECTION)
    # small Arrow batches, so that versions and entities are cut by batch ends
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(r) for r in history.section_history(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == plain_history(rows)
    assert history.section_history(df.limit(0)).count() == 0
