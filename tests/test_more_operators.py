import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lexweave import session
from lexweave.functions import text as T
from lexweave.operators import graph, layout, passages, quality, validate
from lexweave.sources import notices


def test_components(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500), (None, 3)]
    root = {x: x for p in pairs for x in p if x is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
    assert got == {x: top(x) for x in root}


def test_checks(spark):
    a = spark.createDataFrame([("x", "One [two](u) three"), ("y", "a b"), ("z", "q")], "k string, t string")
    b = spark.createDataFrame([("x", "one two THREE"), ("y", "z a b c")], "k string, t string")
    state = lambda exact: {r.k: r.state for r in validate.round_trip(a, b, "k", "t", exact).collect()}
    assert state(True) == {"x": "passed", "y": "failed", "z": "missing"} and state(False)["y"] == "passed"
    g = spark.createDataFrame([("x", [["A", "b  c"]]), ("y", [["n"]])], "k string, g array<array<string>>")
    assert [r.k for r in validate.unlocated_tables(g, spark.createDataFrame([("x", [["a", "B c"]])], "k string, g array<array<string>>"), "k", "g").collect()] == ["y"]
    inputs = spark.createDataFrame([("i", "n1", "d1"), ("i", "n2", "d2")], "item string, name string, digest string")
    bound = spark.range(1).select(F.sha2(F.lit("n1=d1\nn2=d2"), 256)).first()[0]
    checks = spark.createDataFrame([("i", bound), ("j", "zz")], "item string, bound string")
    assert {r["item"]: r.stale for r in validate.stale_bindings(checks, inputs).collect()} == {"i": False, "j": True}


def test_quality(spark):
    ranks = spark.createDataFrame([("q1", 1, 9), ("q2", None, 7), ("q3", None, None)], "q string, l int, v int")
    assert [r.q for r in quality.hard_questions(ranks, "q", "l", "v", 5).orderBy("q").collect()] == ["q2", "q3"]
    p = spark.createDataFrame([("a b",), ("a b",), ("c " * 30,)], "body string")
    r = quality.passage_audit(p, "body", T.words("body")).first()
    assert (r.passages, r.distinct_bodies, r.short, r.median_words) == (3, 2, 2, 2)
    rows = spark.createDataFrame([(f"g{i % 7}", i) for i in range(70)], "g string, k int")
    split = quality.quota_split(rows, "g", "k", 25, "s").collect()
    assert sum(r["rows"] for r in split if r.split == "tuning") == 30 and len(split) == 7
    rec = spark.createDataFrame([("s", 1, "k", "o", True), ("s", 2, "k2", "o", True), ("s", 3, "k", "o", False)], "stage string, attempt int, input_key string, output_digest string, complete boolean")
    want = spark.createDataFrame([("s", "k2", "o"), ("t", None, None)], "stage string, input_key string, output_digest string")
    assert {r.stage: r.reuse for r in quality.reusable_stages(rec, want).collect()} == {"s": True, "t": False}
    items = spark.createDataFrame([("d", "published"), ("d", "agreed"), ("d", "withheld")], "d string, s string")
    assert tuple(quality.coverage(items, "d", "s").first()) == ("d", 3, 2, 1, 1)


def test_windows(spark):
    rows = spark.createDataFrame([("a", 1, "xxxx"), ("a", 2, "yyyy"), ("a", 3, "z" * 20), ("a", 4, "w"), ("b", 1, "q"), ("b", 2, None), (None, 1, "n")], "g string, o int, t string")
    got = sorted((r.g, r.window, r.first, r.last, r.text) for r in passages.packed_windows(rows, "g", "o", "t", 10).collect())
    assert got == [("a", 0, 1, 2, "xxxx\nyyyy"), ("a", 1, 3, 3, "z" * 20), ("a", 2, 4, 4, "w"), ("b", 0, 1, 1, "q")]


def test_notices(spark):
    xml = "<RULE><REGTEXT><AMDPAR>1. Amend § 12.4 by revising paragraphs (a) and (b)(1) to read as follows:</AMDPAR><SECTION><P>(a) New a.</P><P>(b)(1) New b.</P></SECTION><AMDPAR>2. Remove § 12.9.</AMDPAR></REGTEXT></RULE>"
    got = notices.notice_actions(xml, "RN:2024-1", "UCR")
    assert [(a["action_id"], a["kind"], a["target_id"], a["target_anchor"], a["text"]) for a in got] == [
        ("RN:2024-1#instr-1", "amend", "UCR:12-12.4", "a", "New a."),
        ("RN:2024-1#instr-2", "amend", "UCR:12-12.4", "b-1", "New b."),
        ("RN:2024-1#instr-3", "remove", "UCR:12-12.9", None, None),
    ]
    art = {"body": {"children": [{"$ref": "#/groups/0"}, {"$ref": "#/tables/0"}]}, "groups": [{"children": [{"$ref": "#/texts/1"}]}], "texts": [{"text": "lost", "label": "text"}, {"text": "Head", "label": "section_header", "level": 2}], "tables": [{"data": {"grid": [[{"text": "c"}]]}}]}
    assert [(e["type"], e["text"], e["exclusion"]) for e in notices.artifact_elements(art)] == [("heading", "Head", None), ("table", "c", None), ("paragraph", "lost", "unlinked")]
    paths = spark.createDataFrame([("a/B.md",), ("a/b.md",), ("c.md",)], "p string")
    safe = {r.p: r.safe for r in notices.case_safe(paths, "p").collect()}
    assert safe["c.md"] == "c.md" and len({s.lower() for s in safe.values()}) == 3 and safe["a/b.md"].endswith(".md")
    from datetime import date

    v = spark.createDataFrame([("k", date(2020, 1, 1), False), ("k", date(2021, 1, 1), True), ("k", date(2022, 1, 1), None)], "k string, d date, gone boolean")
    assert str(notices.versions_at(v, "k", "d", "gone", "2021-06-01").first().d) == "2020-01-01"


def test_abstention_searches_every_document(spark, tmp_path):
    """An item that a document holds is answered, whatever its words are; one of which no document has a third is not."""
    from lexweave.plans.retrieval import abstain_searched

    items = [(1, "Red kiln, red boiler."), (2, "one two three four"), (3, None), (4, "alpha beta gamma")]
    docs = [(1, "the boiler and the red kiln"), (2, "one"), (3, "four"), (4, None), (5, ""), (6, "beta")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.item_id: r.abstains for r in abstain_searched(spark, str(tmp_path)).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_whole_items_in_documents(spark, tmp_path):
    """All words of an item must stand in a row, not its first eight alone."""
    from lexweave.plans.retrieval import run_containment_whole

    long = " ".join(f"w{i}" for i in range(50))
    items = [(1, long), (2, "Three short words."), (3, None), (4, "...")]
    docs = [(1, f"before {long.upper()}, after"), (2, " ".join(long.split()[:40])), (3, " ".join(long.split()[8:])), (4, "has three SHORT words"), (5, "three short wordsmiths"), (6, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in run_containment_whole(spark, str(tmp_path)).collect()} == {(1, 1), (4, 2)}


def test_nearest_of_every_query_row(spark):
    """Every query row, over several blocks, as ``cosine_to`` and ``top`` give them for one."""
    from lexweave.operators import ranking

    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(300)] + [(300, [0.0] * 6), (301, rnd.choices([0.5], k=6))]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = ranking.nearest(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 9, block=2).collect()
    assert {r.query_id for r in got} == {0, 50, 100, 150, 200, 250, 300} and len(got) == 63
    for q in (0, 150):
        want = ranking.top(ranking.cosine_to(v, v.where(f"vec_id = {q}"), "vec_id", "embedding"), "vec_id", 9, "cosine").collect()
        assert [(r.vec_id, r.cosine) for r in want] == [(r.vec_id, r.cosine) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]


def test_headings_of_any_depth(spark):
    rows = [("d", i + 1, min(i + 1, 9)) for i in range(9)] + [("d", 10, 8), ("d", 11, 1), ("e", 1, 7), ("e", 2, 9), (None, 1, 1), ("e", 3, None)]
    got = {(r.doc_sha, r.seq): (r.parent_seq, r.end_seq) for r in layout.ranges(spark.createDataFrame(rows[::-1], "doc_sha string, seq int, level int")).collect()}
    want = {}
    heads = [r for r in rows if None not in r]
    for d, s, k in heads:
        up = [x for e, x, j in heads if e == d and x < s and j < k]
        end = [x for e, x, j in heads if e == d and x > s and j <= k]
        want[d, s] = (max(up, default=None), min(end, default=None))
    assert got == want and want["d", 9] == (8, 10)


def test_long_chain_of_held_links(spark):
    links = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(100)] + [("x", "y"), (None, "n0"), ("n1", "n0")], "from_id string, to_id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {r.id for r in graph.held(links, ids("n0", None), ids("q")).collect()} == {f"n{i}" for i in range(101)}
    assert {r.id for r in graph.held(links, ids("n0"), ids("n3")).collect()} == {"n0", "n1", "n2", "n3"}


def test_shared_folder(spark, tmp_path):
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake)
    df = session.staged(spark.range(3).toDF("x"), "t")
    path = session._written[-1][1]
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file://"))
    at = f"file://{tmp_path}/p/one"
    assert session.put_if_absent(spark, at, "a") and not session.put_if_absent(spark, at, "b") and session.read_text(spark, at) == "a"
    assert os.listdir(tmp_path / "p") == ["one"] or all(f.startswith(".") for f in set(os.listdir(tmp_path / "p")) - {"one"})


def _overlapping(rows, least):
    """Brute force: each text with each of its group."""
    words = lambda t: {x for x in re.split(r"[^a-z0-9]+", t.lower()) if len(x) > 2}
    texts = {(g, t) for g, t in rows if g is not None and t is not None and words(t)}
    out = set()
    for g, a in texts:
        for h, b in texts:
            if g == h and a < b and round(len(words(a) & words(b)) / len(words(a) | words(b)), 6) >= least:
                out.add((g, a, b))
    return out


@pytest.mark.parametrize("few", [1, 6, 64])
def test_similar_contexts_of_small_and_large_groups(spark, few):
    rng = random.Random(3)
    rows = [(None, "alpha beta gamma"), ("g1", None), ("g1", ""), ("g1", "of to"), ("g1", "of in"), ("lone", "alpha beta gamma")]
    for g, n in (("g1", 4), ("g2", 12), ("g3", 30)):
        for _ in range(n):
            base = [f"word{rng.randrange(25)}" for _ in range(12)]
            for k in range(3):
                text = base[: 12 - k] + [f"word{rng.randrange(25)}" for _ in range(k)]
                rng.shuffle(text)
                rows += [(g, " ".join(text))] * rng.randint(1, 2)
    df = spark.createDataFrame(rows, "g string, t string")
    got = [tuple(r)[:3] for r in validate.similar_contexts(df, "g", "t", few=few).collect()]
    want = _overlapping(rows, 0.8)
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("few", [1, 64])
def test_similar_contexts_rounded_up_to_the_bound(spark, few):
    df = spark.createDataFrame([("g", "one two three"), ("g", "one two")], "g string, t string")
    got = validate.similar_contexts(df, "g", "t", least=0.666667, few=few).collect()
    assert [tuple(r) for r in got] == [("g", "one two", "one two three", 0.666667)]


def test_similar_contexts_send_no_texts_to_the_driver(spark, tmp_path):
    # read from a file: Spark then knows a size, and took the words of all texts for few rows
    spark.createDataFrame([("g", "one two three four five"), ("g", "one two three four five six")], "g string, t string").write.parquet(f"{tmp_path}/t")
    found = validate.similar_contexts(spark.read.parquet(f"{tmp_path}/t"), "g", "t")
    assert found.count() == 1
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
