"""Anchors, tables, passages, matching and amendments on small texts, against hand-made or brute-force results."""

import random
import re
import time

import pytest

from lexweave.functions import anchors, instructions
from lexweave.functions import text as T
from lexweave.operators import amend, fuzzy, layout, passages


@pytest.mark.parametrize(
    "labels, want",
    [
        ("a 1 i ii 2 b", "a a-1 a-1-i a-1-ii a-2 b"),
        ("h 1 i i j", "h h-1 h-1-i i j"),
        ("h 1 i ii i j", "h h-1 h-1-i h-1-ii i j"),
        ("h i j", "h i j"),
        ("a 1 i A B ii 2", "a a-1 a-1-i a-1-i-A a-1-i-B a-1-ii a-2"),
        ("h 1 2 i 1 j", "h h-1 h-2 i i-1 j"),
        ("u v w", "u v w"),
        ("z aa", "z aa"),
    ],
)
def test_anchors(labels, want):
    body = "\n".join(f"({x}) text" for x in labels.split())
    assert [a for a, _ in anchors.paragraph_anchors(body)] == want.split()


def test_label_runs_and_slices():
    body = "# Head\n(a)(1) one\n\nmore\n(2) two\n(b) three"
    assert anchors.paragraph_anchors(body) == [("a", 2), ("a-1", 2), ("a-2", 5), ("b", 6)]
    assert anchors.anchor_slice(body, "a-1") == "(a)(1) one\n\nmore"
    assert anchors.anchor_slice(body, "b") == "(b) three" and anchors.anchor_slice(body, "c") == ""


def test_tables():
    body = "x\n| A | B |\n|---|:-:|\n| 1 | 2 \\| 3 |\n| 4 |\n\ny | z"
    (t,) = anchors.gfm_tables(body)
    assert t == {"line": 2, "header": ["A", "B"], "rows": [["1", "2 | 3"], ["4", ""]]}
    assert anchors.lookup(t, ["b: 2"]) == "A: 1; B: 2 | 3" and anchors.lookup(t, ["9"]) is None


def test_passages_cover():
    rnd = random.Random(3)
    for _ in range(200):
        body = "".join(rnd.choice(["word ", "w. ", "end.\n\n", "\n", "  ", "| a | b |\n"]) for _ in range(rnd.randint(0, 900)))
        cut = passages.spans(body, 64, 90)
        assert "".join(body[a:b] for a, b, _ in cut) == body
        assert all(len(body[a:b].split()) <= 90 for a, b, _ in cut)
    with pytest.raises(ValueError):
        passages.check_policy(10, 20)


def test_passage_table(spark):
    df = spark.createDataFrame([("a", "w " * 500, "x"), ("b", None, "x"), ("c", "", "x"), (None, "w w", "x")], "k string, t string, part string")
    rows = passages.passages(df, "k", "t", 100, 200).collect()
    assert {r.key for r in rows} == {"a", None} and all(r.words <= 200 for r in rows)
    units = spark.createDataFrame([("d", i, w) for i, w in enumerate([30, 30, 90, 10, 10, 200])] + [("e", 0, None)], "g string, o int, w int")
    got = {(r.g, r.o): r.passage for r in passages.merged_peers(units, "g", "o", "w", 64, 120).collect()}
    assert got == {("d", 0): 0, ("d", 1): 0, ("d", 2): 1, ("d", 3): 2, ("d", 4): 2, ("d", 5): 3, ("e", 0): 0}


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_and_spans():
    rnd = random.Random(4)
    for _ in range(150):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        pairs = fuzzy.lcs(a, b)
        assert len(pairs) == slow_lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    assert fuzzy.span_score("x y z".split(), "a x y q z b".split()) == (6 / 7, 1, 5)
    assert fuzzy.best_window(["a", "b"], list("zzzzzzabzzzz"))[2] == 2
    assert fuzzy.similar("kitten", "sitting") == pytest.approx(1 - 3 / 7) and fuzzy.similar("", "") == 1


def test_two_readings():
    a, b = ["The first line", "second line here", "third one"], ["The first line", "second lime here", "added line", "third one"]
    assert fuzzy.merged_readings(a, b) == [("The first line", ""), ("second line here", "divergent"), ("added line", "secondary_only"), ("third one", "")]
    assert fuzzy.consensus_lines([a, b]) == ["The first line", "second line here", "third one"]


def test_instructions(spark):
    rows = [
        ("1. Add § 4.5 to read as follows:", "add", [], "4.5", []),
        ("Amend § 4.6 by revising paragraphs (a)(1) and (b) to read", "amend", ["a-1", "b"], "4.6", []),
        ("2. Amend § 1910.1200 by revising paragraphs (j)(2)(i) and (ii) and (j)(3)(i) and (ii) to read as follows:", "amend", ["j-2-i", "ii", "j-3-i"], "1910.1200", []),
        ("Section 2.1 is redesignated as § 2.2", "redesignate", [], "2.1", []),
        ('In § 3.4, paragraph (c), remove the word "old" and add "new" in its place.', "remove", ["c"], "3.4", [("old", "new", False)]),
        ("removing the word “he” wherever it appears and adding “they”", "remove", [], None, [("he", "they", True)]),
        ('the words "old" are replaced by "new"', "amend", [], None, [("old", "new", False)]),
        ("7. Section 1910.1000 is amended by removing paragraph (c).", "remove", ["c"], "1910.1000", []),
        ("1. The authority citation for subpart Z of 29 CFR part 1910 is revised", "amend", [], None, []),
        ("Stay the effect of § 7.1 until the address is known", "stay", [], "7.1", []),
        ("Remove § 9.9", "remove", [], "9.9", []),
        ("", "amend", [], None, []),
        (None, None, [], None, []),
    ]
    got = spark.createDataFrame([(r[0],) for r in rows], "x string").select(amend.reading("x").alias("r")).collect()
    for (text, kind, marks, section, edits), (r,) in zip(rows, got):
        assert (r.kind, r.paragraphs, r.section, [tuple(e) for e in r.edits]) == (kind, marks, section, edits), text
    assert instructions.read("6. Redesignate paragraphs (d) through (f) as paragraphs (e) through (g).").moves == [("d", "e"), ("e", "f"), ("f", "g")]
    assert instructions.read("Redesignate paragraph (c) as paragraph (d); and adding a new paragraph (c).").moves == [("c", "d")]
    assert instructions.read("Remove and reserve paragraph (b).").reserve and instructions.read("Revising paragraph (b) introductory text.").introductory


def test_actions_on_a_tree_of_paragraphs():
    body = "# § 1.1 Rules\n(a) First.\n(b) Second, with a cage or well.\n(1) Nested one.\n(2) Nested two.\n(c) Third."
    one = lambda *a: amend.apply_one(body, *a)[0]
    assert one("amend", "b", "(b) New second.\n(1) New nested.") == "# § 1.1 Rules\n(a) First.\n(b) New second.\n(1) New nested.\n(c) Third."
    assert one("amend", "b", "(b) Second, revised.", "Revising paragraph (b) introductory text.").splitlines()[2:5] == ["(b) Second, revised.", "(1) Nested one.", "(2) Nested two."]
    assert "(b) Second, with a ladder." in one("remove", "b", "", "by removing the words “cage or well” in paragraph (b) and adding in their place the word “ladder”.")
    assert amend.apply_one(body, "remove", "a", "", "removing the words “not here” and adding “x”") == (body, False)
    assert one("remove", "b", "", "Remove and reserve paragraph (b).") == "# § 1.1 Rules\n(a) First.\n(b) [Reserved]\n(c) Third."
    assert one("remove", "b", "", "Remove paragraph (b).") == "# § 1.1 Rules\n(a) First.\n(c) Third."
    assert one("add", "d", "(d) Fourth.").endswith("(c) Third.\n(d) Fourth.")
    assert "(2) Nested two.\n(3) Nested three.\n(c) Third." in one("add", "b-3", "Nested three.")
    assert one("redesignate", "c", "(d)").endswith("(d) Third.")
    assert amend.apply_one(body, "amend", "z", "(z) Nowhere.") == (body, False) and amend.apply_one(body, "amend", "b", "(b) * * * in part.") == (body, False)
    twice = "(a) x\n(1) y\n(a) z"
    assert amend.parsed(twice).rendered() == twice.splitlines() and amend.apply_one(twice, "remove", "a", "")[0] == "(a) z"


def test_many_actions_are_linear():
    t = amend.Text("\n".join(f"({i}) line" for i in range(1, 400)))
    began = time.time()
    for i in range(100_000):
        assert t.apply("amend", str(1 + i % 399), f"text {i}")
    assert time.time() - began < 20 and t.body().count("\n") == 398


def test_amended_text(spark):
    body = "(a) one\n(1) sub\n(b) two old"
    assert amend.apply_one(body, "amend", "a-1", "SUB") == ("(a) one\n(1) SUB\n(b) two old", True)
    assert amend.apply_one(body, "remove", "a", "") == ("(b) two old", True)
    assert amend.apply_one(body, "add", "c", "three") == (body + "\n(c) three", True)
    assert amend.apply_one(body, "amend", "z", "x") == (body, False)
    assert amend.apply_one(body, "amend", "b", 'the words "old" are replaced by "new"')[0].endswith("two new")
    texts = spark.createDataFrame([("w", body), ("v", None), (None, "x")], "work string, body string")
    acts = spark.createDataFrame([("w", "remove", "a", None, 2), ("w", "amend", "a", "ONE", 1), ("w", "amend", "q", "x", 3), ("u", "add", "a", "x", 1)], "work string, kind string, anchor string, text string, seq int")
    got = {r.work: (r.body, r.applied, r.failed) for r in amend.composed(texts, acts).collect()}
    assert got == {"w": ("(b) two old", 2, 1), "v": ("", 0, 0)}


def test_layout(spark):
    heads = spark.createDataFrame([("d", s, l) for s, l in [(1, 1), (3, 2), (5, 3), (7, 2), (9, 1)]], "doc_sha string, seq int, level int")
    got = {r.seq: (r.parent_seq, r.end_seq) for r in layout.ranges(heads).collect()}
    assert got == {1: (None, 9), 3: (1, 7), 5: (3, 7), 7: (1, 9), 9: (None, None)}
    items = spark.createDataFrame([(1, 10.0, 50.0, 5.0, "a"), (1, 55.0, 90.0, 5.5, "b"), (1, 200.0, 240.0, 5.0, "right"), (1, 10.0, 40.0, 20.0, "c")], "page int, x double, right double, y double, text string")
    assert sorted(r.text for r in layout.lines_from_items(items).collect()) == ["a b", "c", "right"]


def test_columns(spark):
    df = spark.createDataFrame([("---\nid: x\n---\nbody", "UCR:12-40.7", "see [§ 4](UCR:1-2#a-1) and § 12.4(b), § 12.4", "exam-\nple b\nc")], "f string, i string, l string, h string")
    fm, body = T.front_matter("f")
    r = df.select(fm, body, T.id_parts("i"), T.links("l"), T.citations("l"), T.unhyphenated("h"), T.plain("l")).first()
    assert r[0] == "id: x" and r[1] == "body" and r[2] == ["ucr:12-40.7", "12-40.7", "40.7"]
    assert [tuple(x) for x in r[3]] == [("§ 4", "UCR:1-2", "a-1")] and r[4] == ["12.4"] and r[5] == "example b c" and r[6].startswith("see § 4 and")
    stuck = spark.createDataFrame([("\n".join(["same"] * 15 + ["x", "y", "z", "q", "r", "s"]),), ("a\nb",), (None,)], "t string")
    assert [x[0] for x in stuck.select(T.degenerate("t")).collect()] == [True, False, False]
    assert re.sub("x", "", "x") == ""


def test_lcs_in_little_memory():
    """The same pairs as from the full matrix."""
    rnd = random.Random(11)
    for n, m in ((0, 3), (1, 1), (7, 40), (50, 50), (33, 5)):
        a, b = [rnd.choice("abcd") for _ in range(n)], [rnd.choice("abcd") for _ in range(m)]
        rows = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
        want, i, j = [], n, m
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                want.append((i, j))
        assert fuzzy.lcs(a, b) == want[::-1]
    long = [str(i % 997) for i in range(20_000)]
    assert len(fuzzy.lcs(long, long)) == 20_000


def test_dual_reading():
    page = "one line here\ntwo lines here"
    assert fuzzy.dual_reading(page, page) == [("one line here", ""), ("two lines here", "")]
    assert fuzzy.dual_reading(page, "x") == [("one line here", ""), ("two lines here", "")]
    stuck = "\n".join(["again"] * 30)
    assert [f for _, f in fuzzy.dual_reading(stuck, page)] == ["secondary_only"] * 2 and fuzzy.dual_reading("", page) == []
