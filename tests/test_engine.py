"""The verbs on a mini-corpus written by hand, and knowledge and evidence helpers."""

from datetime import date, datetime

import pytest

from lexweave.engine import Engine, NotFound
from lexweave.functions import stem
from lexweave.operators import citations, evidence, grep, knowledge, quality

SECTIONS = "rel_path string, id string, node string, source_name string, title string, level_name string, kind string, parent string, ord bigint, effective date, retired date, published date, supersedes string, superseded_by string, amended_by array<string>, overrides array<string>, narrows array<struct<id:string,anchor:string>>, defines array<string>, legal_status string, confidence double, body string, loaded_at timestamp"
AT = datetime(2024, 1, 1)


def row(id_, title, body, parent=None, eff=date(2020, 1, 1), kind="base", ord_=1, ret=None, by=None, sup=None, ov=None, na=None, am=None):
    return (f"{id_}@{eff}.md", id_, None, "hb" if id_.startswith("HB") else "ucr", title, "section", kind, parent, ord_, eff, ret, None, sup, by, am or [], ov or [], na or [], [], "official", None, body, AT)


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        row("UCR:1-1", "Harbour title", "All harbours.\nHarbour means a port.", None),
        row("UCR:1-1.1", "Crane duties", "(a) The operator shall inspect the crane.\n(1) daily\n(b) No crane may be idle.", "UCR:1-1", ord_=2, by="UCR:1-1.1@2022-01-01"),
        row("UCR:1-1.1", "Crane duties", "(a) The operator shall inspect the crane weekly.\n(b) No crane may be idle.", "UCR:1-1", date(2022, 1, 1), ord_=2, sup="UCR:1-1.1@2020-01-01", am=["RN:2021-1#instr-1"]),
        row("UCR:1-1.2", "Kiln records", "Kiln means an oven. § 1.1 applies.", "UCR:1-1", ord_=1, ret=date(2023, 1, 1)),
        row("HB:AM-1", "Local cranes", "Crane means a hoist of the harbour.", None, kind="overlay", ov=["UCR:1-1.1"], na=[("UCR:1-1.2", "a")]),
    ]
    actions = spark.createDataFrame([(1, "RN:2021-1#instr-1", "RN:2021-1", "UCR:1-1.1", "a", "amend", date(2022, 1, 1), "x", 1, AT)], "feed_pos bigint, action_id string, notice string, target_id string, target_anchor string, kind string, effective date, text string, revision int, received_at timestamp")
    sources = spark.createDataFrame([("ucr", "base", 100, "UCR"), ("hb", "overlay", 200, "HB")], "source_name string, kind string, precedence bigint, id_prefix string")
    return Engine(spark, spark.createDataFrame(rows, SECTIONS), actions, sources)


def ids(df):
    return [r.id for r in df.collect()]


def test_search(engine):
    hits = engine.search("crane duties").collect()
    assert hits[0].id == "UCR:1-1.1" and "crane" in hits[0].snippet and len({h.id for h in hits}) == len(hits)
    assert ids(engine.search("kiln", as_of="2022-06-01")) == ["UCR:1-1.2"] and ids(engine.search("kiln", as_of="2023-06-01")) == []
    assert ids(engine.search("crane", source="hb")) == ["HB:AM-1"] and set(ids(engine.search("crane harbour", scope="UCR:1-1"))) == {"UCR:1-1", "UCR:1-1.1"}
    assert ids(engine.search("zeppelin")) == []


def test_vectors(engine, spark):
    vectors = spark.createDataFrame([("UCR:1-1.1@2022-01-01", [1.0, 0.0]), ("HB:AM-1@2020-01-01", [0.0, 1.0])], "expr string, embedding array<double>")
    e = Engine(spark, engine.sections, engine.actions, engine.sources, embed=lambda q: [0.1, 1.0], vectors=vectors)
    assert ids(e.search("anything", mode="vector"))[0] == "HB:AM-1"


def test_grep(engine):
    got = [(r.path, r.line_no) for r in engine.grep(["crane"]).collect()]
    assert ("UCR:1-1.1@2020-01-01.md", 1) in got and len(got) == 4
    assert engine.grep(["crane"], ignore_case=True).count() == 5 and engine.grep(["cran"], word=True).count() == 0
    assert {r.path: r["lines"] for r in engine.grep(["crane"], count_only=True, globs=["UCR*"]).collect()} == {"UCR:1-1.1@2020-01-01.md": 2, "UCR:1-1.1@2022-01-01.md": 2}
    ctx = engine.grep(["idle"], before=1).collect()
    assert [(r.line_no, r.is_match) for r in ctx if "2020" in r.path] == [(2, False), (3, True)]
    assert engine.grep(["§ 1."], fixed=True).count() == 1


def test_read(engine):
    r = engine.read("UCR:1-1.1")
    assert "weekly" in r["text"] and r["overridden_by"] == ["HB:AM-1"]
    assert "weekly" not in engine.read("UCR:1-1.1", as_of="2021-01-01")["text"] and "daily" in engine.read("UCR:1-1.1@2020-01-01#a")["text"]
    assert engine.read("UCR:1-1.1#b")["text"] == "(b) No crane may be idle."
    for bad in ("UCR:9-9", "UCR:1-1.1#z", "UCR:1-1.1@1999-01-01"):
        with pytest.raises(NotFound):
            engine.read(bad)


def test_graph_verbs(engine):
    assert [(r.id, r.depth) for r in engine.refs("HB:AM-1", "out").collect()] == [("UCR:1-1.1", 1), ("UCR:1-1.2", 1)]
    assert ids(engine.refs("UCR:1-1.2", "both", 3, as_of="2022-06-01")) == ["HB:AM-1", "UCR:1-1.1", "RN:2021-1#instr-1"]
    assert ids(engine.define("Kiln", as_of="2022-01-01")) == ["UCR:1-1.2"]
    near = engine.define("Harbour", scope="UCR:1-1.1").collect()
    assert [(r.id, r.distance, r.ambiguous) for r in near] == [("UCR:1-1", 1, False)]
    assert ids(engine.map()) == ["HB:AM-1", "UCR:1-1", "UCR:1-1.1"] or set(ids(engine.map())) >= {"HB:AM-1", "UCR:1-1"}
    assert ids(engine.map("UCR:1-1", depth=1)) == ["UCR:1-1"]
    assert {r.source_name: (r.works, r.expressions) for r in engine.status().collect()} == {"hb": (1, 1), "ucr": (3, 4)}


def test_reading_and_leading_on(engine, spark, tmp_path):
    r = engine.read("UCR:1-1", as_of="2022-06-01")
    assert [c[0] for c in r["children"]] == ["UCR:1-1.2", "UCR:1-1.1"] and r["history"] == ["UCR:1-1@2020-01-01"] and engine.read("UCR:1-1.1")["refs_in"] == {"overrides": 1}
    hits = spark.createDataFrame([("HB:AM-1", "HB:AM-1@2020-01-01")], "id string, expr string")
    assert {x.to_id for x in engine.expand(hits, as_of="2022-06-01").collect()} == {"UCR:1-1.1", "UCR:1-1.2"}
    low = spark.createDataFrame([("UCR:1-1.1", "UCR:1-1.1@2022-01-01")], "id string, expr string")
    assert [(x.place, x.id) for x in engine.expand(low, "ancestors", "2022-06-01").collect()] == [(0, "UCR:1-1")]
    assert [c["expr"] for c in engine.context(hits, 100, "2022-06-01")] == ["UCR:1-1.1@2022-01-01", "UCR:1-1.2@2020-01-01"] and engine.context(hits, 5, "2022-06-01") == []
    passages_ = spark.createDataFrame([("p1", ["UCR:1-1@2020-01-01", "UCR:1-1.1@2020-01-01"])], "passage string, members array<string>")
    assert [x["id"] for x in engine.read_passage(passages_, "p1")] == ["UCR:1-1", "UCR:1-1.1"] and len(engine.read_passage(passages_, "p1", "2021-01-01")) == 2
    for bad in (("p2", None), ("p1", "2022-06-01")):
        with pytest.raises(NotFound):
            engine.read_passage(passages_, *bad)
    assert set(ids(engine.map_complete("UCR:1-1"))) == {"UCR:1-1.1", "UCR:1-1.2"} and {x.anchor for x in engine.map_complete("UCR:1-1.1").collect()} == {"a", "b"}
    assert engine.near_terms("big crane") == ["Crane"]
    assert [x.anchor for x in engine.grep(["idle"], globs=["*2022*"], annotate=True).collect()] == ["b"] and engine.grep(["crane"], max_hits=1).columns == ["path", "lines"]
    assert engine.validate().collect() == []
    plain = [tuple(x) for x in engine.search("crane duties").collect()]
    engine.build_index(f"file://{tmp_path}/index")
    try:
        assert [x[0] for x in engine.search("crane duties").collect()] == [x[0] for x in plain]
    finally:
        engine.index = None


def test_prefilter_never_loses_a_match(spark):
    import random
    import re

    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["crane", "kiln", "Boiler", " ", "x", "\n", "ab"]) for _ in range(30)) for _ in range(60)]
    files = spark.createDataFrame(list(enumerate(texts)), "p int, t string")
    index = grep.gram_index(files, "p", "t").cache()
    for pattern in ["crane", "cran(e|k)kiln", "(?:crane|kiln)+x", "boi|kilnx", "[ck]rane", "crane.?kiln", "(crane)?kiln ", "Boiler"]:
        want = {(p, n) for p, t in enumerate(texts) for n, line in enumerate(t.split("\n"), 1) if re.search(pattern, line)}
        got = {(r.path, r.line_no) for r in grep.indexed_matches(files, index, "p", "t", pattern).collect()}
        assert got == want, pattern
    assert grep.required_literals("a|b") is None and grep.required_literals("(") is None


def test_knowledge(spark):
    concepts = spark.createDataFrame([("c1", "Crane", ["hoist"]), ("c2", "Kiln", None), ("c3", "Harbour crane", ["hoist"])], "id string, label string, aliases array<string>")
    assert {(r.id, r.ambiguous) for r in knowledge.mentioned(concepts, "a Hoist, near the kiln").collect()} == {("c1", True), ("c3", True), ("c2", False)}
    assert ids(knowledge.lookup(concepts, "KILN")) == ["c2"] and knowledge.lookup(concepts, "*").count() == 3
    rel = spark.createDataFrame([("r1", "c1", "c2", "uses", True, "passed"), ("r2", "c3", "c2", "near", False, "passed"), ("r3", "c2", "c9", "uses", True, "failed")], "relation_id string, from_id string, to_id string, type string, directed boolean, state string")
    start = spark.createDataFrame([("c1",)], "id string")
    assert sorted((r.relation_id, r.depth, r.path) for r in knowledge.traverse(rel, start, 3).collect()) == [("r1", 1, ["c1", "c2"]), ("r2", 2, ["c1", "c2", "c3"])]
    assert knowledge.traverse(rel, start, 3, ["none"]).count() == 0
    ev = spark.createDataFrame([("r1", "f", "00", "crane")], "relation_id string, path string, sha256 string, quote string")
    files = spark.createDataFrame([("f", "a kiln")], "path string, text string")
    assert sorted(map(tuple, knowledge.faults(concepts, rel, ev, files).collect())) == [("r1", "quote_not_found"), ("r1", "stale_evidence"), ("r2", "no_evidence"), ("r3", "unknown_endpoint")]
    claim = lambda *x: spark.createDataFrame([(c,) for c in x], "c string")
    assert sorted(r.state for r in knowledge.agreement(claim("A ", "b"), claim("a", "c"), ["c"]).collect()) == ["agreed", "only_proposed", "only_verified"]


def test_evidence():
    body = "First words here.\n\nThe crane stands. It is old.\n\nLast words of all."
    a, b = evidence.excerpt(body, ["crane"], 6)
    assert body[a:b].strip() == "The crane stands. It is old."
    a, b = evidence.excerpt("x " * 50 + "crane " + "y " * 50, ["crane"], 9)
    assert "crane" in ("x " * 50 + "crane " + "y " * 50)[a:b] and len(("x " * 50 + "crane " + "y " * 50)[a:b].split()) == 9
    got = evidence.packets([{"terms": ["a"], "primary": [("e1", "a b c")], "support": [("e1", "a b c"), ("e2", "d e")]}, {"primary": [("e3", "f g")]}], 6)
    assert [(p["expr"], p["words"]) for p in got] == [("e1", 3), ("e3", 2), ("e2", 1)]
    assert evidence.fitting([("a", 5), ("b", 9), ("c", 4)], 10) == ["a", "c"]


def test_citations():
    text = "See UCR 12-40.7(b)(1) and § 3.4(a); also § 9.1 of title 8 and AM-3."
    assert [(x[3], x[4]) for x in citations.all_in(text, "12")] == [("UCR:12-40.7", "b-1"), ("UCR:12-3.4", "a"), ("UCR:8-9.1", ""), ("HB:AM-3", "")]
    assert [x[3] for x in citations.all_in(text, None)] == ["UCR:12-40.7", "UCR:8-9.1", "HB:AM-3"]
    assert citations.whole("UCR:12-40.7(b)") == ("UCR:12-40.7", "b") and citations.whole("see AM-3") is None
    assert citations.linked("§ 3.4 and § 3.4 [§ 3.4](x)", {"§ 3.4": "UCR:12-3.4"}) == "[§ 3.4](UCR:12-3.4) and § 3.4 [§ 3.4](x)"


@pytest.mark.parametrize("word, want", [w.split() for w in "consign consign;consistency consist;knightly knight;generously generous;hopping hop;hoping hope;flies fli;dies die;relational relat;skies sky;electricity electr;adjustment adjust;happy happi;controlling control".split(";")])
def test_stems(word, want):
    assert stem.stem(word) == want


def test_sampling_and_alignment(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(90)], "k int, s string")
    assert quality.seeded_sample(rows, "s", "k", 4, "x").groupBy("s").count().where("count = 4").count() == 3
    assert [r.s for r in quality.round_robin(rows, "s", [rows.k], 7).collect()] == ["s0", "s1", "s2", "s0", "s1", "s2", "s0"]
    rec = "id string, node string, title string, level_name string"
    old = spark.createDataFrame([("a", "n1", "T", "s"), ("b", None, "U", "s"), ("c", None, "V", "s"), ("d", None, "W", "s"), ("e", None, "W", "s")], rec)
    new = spark.createDataFrame([("x", "n1", "Q", "s"), ("b", None, "Q", "s"), ("y", None, "V", "s"), ("z", None, "W", "s")], rec)
    assert sorted(map(tuple, quality.aligned(old, new).collect())) == [("a", "x", "node"), ("b", "b", "id"), ("c", "y", "title")]
