"""Navigation and checks on small fixtures."""

from datetime import date

from pyspark.sql import functions as F

from lexweave.operators import checks, navigation

D = date


def test_navigation_texts(spark):
    rows = [("# Contents\n- [One](A:1)\n- [Two](A:2#a)\nPart II ..... 12", True), ("# Head\nA sentence.", False), ("", False), (None, False), ("12 34", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.want == r.got for r in df.select("want", navigation.is_navigation("t").alias("got")).collect())
    e = spark.createDataFrame([("header",), (None,), ("paragraph",)], "element_type string")
    assert sorted(r.searchable for r in navigation.regions(e).collect()) == [False, True, True]


def test_delinked(spark):
    rows = spark.createDataFrame([(1, "see [a](X:1-2(b)), [b](Y:2#p-1) and [c](X:9)"), (2, "none"), (3, None)], "k int, t string")
    keep = spark.createDataFrame([("X:9",)], "id string")
    got = {r.k: r.t for r in navigation.delinked(rows, "k", "t", keep).collect()}
    assert got[2] == "none" and got[3] is None and "[c](X:9)" in got[1] and "Y:2" not in got[1]


EXPR = "id string, effective date, retired date, title string, parent string, superseded_by string"


def test_inherited_context(spark):
    rows = [
        ("A:1", D(2020, 1, 1), None, "Old", None, "A:1@2021-01-01"), ("A:1", D(2021, 1, 1), None, "New", None, None),
        ("A:2", D(2020, 5, 1), None, "Two", "A:1", "A:2@2022-01-01"), ("A:2", D(2022, 1, 1), None, "Two again", "A:1", None), ("A:3", None, None, "Three", "a:2 ", None),
        ("A:4", D(2020, 1, 1), D(2021, 6, 1), "Gone", "A:1", None), ("A:5", None, None, "Five", "A:4", None), ("A:6", None, None, "Six", "A:7", None), ("A:7", None, None, "Seven", "A:6", None),
    ]
    got = {r.expr: r.breadcrumb for r in navigation.inherited_context(spark.createDataFrame(rows, EXPR), "2022-06-01").collect()}
    assert got["A:2@2020-05-01"] == "Old > Two" and got["A:2@2022-01-01"] == "New > Two again" and got["A:3"] == "New > Two again > Three"
    assert got["A:5"] == "Five" and got["A:6"] == "Seven > Six" and len(got) == len(rows)


def test_home_sources(spark):
    sources = spark.createDataFrame([("b1", "base", "P", 5), ("b2", "base", "Q", 9), ("o", "overlay", "Z", 1)], "source_name string, kind string, id_prefix string, precedence bigint")
    works = spark.createDataFrame([("w1", "b1"), ("w2", "o"), ("w3", "o"), ("w4", None)], "id string, source_name string")
    links = spark.createDataFrame([("w2", "P:1"), ("w2", "P:2"), ("w2", "Q:1"), ("w1", "Q:1"), ("w3", None)], "id string, to_id string")
    assert {r.id: r.home for r in navigation.home_sources(works, links, sources).collect()} == {"w1": "b1", "w2": "b1", "w3": "b2", "w4": "b2"}


def test_scopes_and_terms(spark):
    definers = spark.createDataFrame([("A", "P", "section", "X means y as used in this Part."), ("B", "P", "section", "no word"), ("C", None, "part", "for the purposes of this part"), ("E", None, None, None)], "id string, parent string, level_name string, body string")
    levels = spark.createDataFrame([("P", "subpart"), ("R", "part"), ("A", "section")], "id string, level_name string")
    closure = spark.createDataFrame([("P", "A", 1), ("R", "A", 2)], "ancestor string, id string, distance int")
    assert {r.id: r.scope for r in navigation.declared_scopes(definers, levels, closure).collect()} == {"A": "R", "B": "P", "C": "C", "E": "E"}
    t = lambda *x: spark.createDataFrame([(i,) for i in x], "term string")
    got = [(r.asked, r.term, r["rank"]) for r in navigation.near_terms(t("fire pump", "none"), t("Fire", "fire pump", "hand pump", "wall"), 1).collect()]
    assert got == [("fire pump", "Fire", 1)]
    for q, term, want in (("what is a hole", "hole", True), ("toeboard definition", "toeboard", True), ("Define holes", "hole", True), ("is there a hole in what is there", "hole", False), ("holes vs. pits", "hole", True), ("hole", "hole", False), ("x", "", False)):
        assert navigation.asks_definition(q, term) == want, q


def test_maps(spark):
    anchors = spark.createDataFrame([("A", "a"), ("A", "a-1"), ("A", "hole"), ("B", "b")], "id string, anchor string")
    defined = spark.createDataFrame([("A", "hole")], "id string, slug string")
    assert {tuple(r) for r in navigation.top_paragraphs(anchors, defined).collect()} == {("A", "a"), ("B", "b")}
    assert [r.anchor for r in navigation.paragraphs_below(anchors, "A", "a").collect()] == ["a-1"]
    shown = [{"expr": "x"}]
    assert [s["expr"] for s in navigation.supporting(shown, [("x", "y", "one two three"), ("q", "z", "a"), ("x", "x", "a"), ("x", "w", "a b c d"), ("x", "v", "a"), ("x", "v", "a")], 4)] == ["y", "v"]
    r = navigation.trimmed(spark.createDataFrame([(1, " a b  c d ")], "k int, t string"), ["k"], "t", 3).first()
    assert (r.t, r.cut) == ("a b c", True)


def test_reference_faults(spark):
    schema = "id string, effective date, body string, overrides array<string>, narrows array<struct<id:string,anchor:string>>, supersedes string, superseded_by string, parent string"
    rows = [
        ("A:1", D(2020, 1, 1), "[x](A:2#b) [y](A:9)", ["A:2"], [("A:3", "(a)(1)"), (None, "x")], None, "A:1@2021-01-01", "A:3"),
        ("A:2", D(2021, 1, 1), None, None, None, None, None, None), ("A:3", D(2019, 1, 1), None, None, None, None, "A:3@2019-06-01", None), ("A:3", D(2019, 6, 1), None, None, None, None, None, None),
    ]
    e = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in checks.reference_faults(e).collect()}
    me = "A:1@2020-01-01"
    assert got == {(me, "body", "A:9", "unknown"), (me, "body", "A:2", "inactive"), (me, "overrides", "A:2", "inactive")}
    refs = checks.reference_list(e).where("anchor <> ''")
    anchors = spark.createDataFrame([("A:3", "a-1")], "id string, anchor string")
    slugs = spark.createDataFrame([("A:7", "b")], "id string, slug string")
    assert {(r.to_id, r.anchor) for r in checks.missing_anchors(refs, anchors, slugs).collect()} == {("A:2", "b")}


def test_action_integrity(spark):
    e = spark.createDataFrame([("A:1", None, "one two three four five", ["N:1 ", "N:2", "N:9"])], "id string, effective date, body string, amended_by array<string>")
    a = spark.createDataFrame([("N:1", "two three"), ("N:2", "six seven"), ("N:3", "x"), ("N:9", " ")], "action_id string, text string")
    assert {(r.action_id, r.held) for r in checks.action_integrity(e, a).collect()} == {("N:1", True), ("N:2", False)}


def test_evidence_and_verdicts(spark):
    j = spark.createDataFrame([("i", "x", "The  Quote", 1, None), ("j", "y", "lost", 2, "a"), ("k", None, None, 3, "the")], "item string, f string, f_quote string, g int, g_quote string")
    t = spark.createDataFrame([("i", "has the quote"), ("j", "a b a"), ("k", "the one")], "item string, text string")
    assert {tuple(r) for r in checks.evidence_faults(j, t, ["f", "g"]).collect()} == {("i", "g", "no_quote"), ("j", "f", "quote_not_found"), ("j", "g", "quote_ambiguous")}
    marks = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 0), (3, 1), (None, 1), (4, None)], "d int, v int")
    assert {tuple(r) for r in checks.verdict_summary(marks, "d", "v").collect()} == {("0", 1, 0.5), ("1", 1, 0.5), ("disputed", 1, 0.5)}
    assert checks.verdict_summary(marks.where("d = 2"), "d", "v").first().agreement == 1.0
    m = spark.createDataFrame([("a", 3.0), ("b", None)], "metric string, value double")
    assert {r.metric for r in checks.blockers(m, [("a", ">=", 3), ("a", "<=", 2.5), ("b", ">=", 0), ("c", ">=", 0)]).collect()} == {"a", "b", "c"}


def test_artifacts_and_identities(spark):
    rows = [("d", 1, 1, "a", [0.0, 0.0, 1.0, 1.0], 0.5), ("d", 1, 1, "b", [0.0, 0.0, 0.0, 1.0], 1.5), ("d", 2, 0, "c", [1.0], None), ("d", None, 3, "e", None, None), (None, 1, 1, "x", None, 7.0)]
    got = {(r.fault, r.n) for r in checks.artifact_faults(spark.createDataFrame(rows, "doc_sha string, page int, seq int, text string, bbox array<double>, confidence double")).collect()}
    assert got == {("place_taken_twice", 1), ("pages_out_of_order", 1), ("confidence_out_of_range", 1), ("box_incomplete", 1), ("box_without_area", 1), ("box_missing", 1), ("no_place", 1)}
    ledger = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "v"), ("c", "w"), (None, "u")], "n string, u string")
    assert {tuple(r) for r in checks.identity_faults(ledger, "n", "u").collect()} == {("identity_shared", "u", 2), ("native_split", "c", 2)}


def test_answer_scores(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "task string, expr string")
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 6)], "task string, expr string, rank int")
    tasks = spark.createDataFrame([("q", False), ("r", True), ("s", False)], "task string, abstained boolean")
    got = {r.task: tuple(r)[1:] for r in checks.answer_scores(hits, pairs(("q", "a"), ("q", "c")), pairs(("q", "c"), ("q", "z")), tasks).collect()}
    assert got == {"q": (0.5, 0.2, 0.5, None), "r": (None, None, None, 1), "s": (None, None, None, 0)}


def test_bakeoff_scores(spark):
    assert checks.text_edit("a  b", "a b") == 0 and checks.text_edit("abcd", "abce") == 0.25
    assert checks.order_score(["a", "b", "c"], ["a", "b", "c"]) == 1 and checks.order_score(["c", "a", "b"], ["a", "b", "c"]) == 2 / 3 and checks.order_score([], []) == 1
    t = [["h", "k"], ["1", "2"]]
    assert checks.table_score(t, t) == 1 and checks.table_score(t, [["h", "k"]]) == 1 - 3 / 7 and checks.table_score([], []) == 1
    assert checks.focused_text("a b QUOTE c d", "QUOTE", 1) == "b QUOTE c" and checks.focused_text("a b c", "", 1) == "a b"
    assert [checks.verdict_of(x) for x in ("Reasons.\nVerdict: Yes", "No, it is not", "verdict - unsupported", "hm")] == ["yes", "no", "no", "uncertain"]
    df = spark.createDataFrame([("a\nb\nb", "b\r\n c \n")], "x string, y string")
    added, removed = checks.line_changes(F.col("x"), F.col("y"))
    assert tuple(df.select(added, removed).first()) == (["c"], ["a"])
