import random

import pytest
from lexweave.llm import pages


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_finds_all_candidates():
    rnd = random.Random(2)
    vocabulary = list({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(400)})
    trie = pages.Trie([(w, 1) for w in vocabulary])
    for _ in range(150):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9)))
        for k in (1, 2, 3):
            got = {c: d for c, d, _ in trie.within(word, k)}
            assert got == {v: edits(word, v) for v in vocabulary if edits(word, v) <= k}


def test_recognition_cost():
    assert pages.recognition_cost("rnust", "must") == 1
    assert pages.recognition_cost("1icens3e", "licensee") > 3
    assert pages.recognition_cost("sea1ecl", "sealed") == 2


def test_automaton_with_counts():
    rnd = random.Random(4)
    vocabulary = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))): rnd.randint(1, 50) for _ in range(300)}
    trie = pages.Trie([*vocabulary.items()])
    for least in (0, 10, 49, 99):
        for word in ("abab", "a", "bbbbbbbbbbbb", "", "cd"):
            got = {(c, d, n) for c, d, n in trie.within(word, 2, least)}
            assert got == {(v, edits(word, v), n) for v, n in vocabulary.items() if n >= least and edits(word, v) <= 2}


def test_differences():
    for a, b, want in (("rnust", "must", ("rn", "m")), ("skyhght", "skylight", ("h", "li")), ("ab", "ab", None), ("walls", "wall", None), ("xxyyzz", "abcdef", None), ("aab", "ab", None), ("c", "e", ("c", "e"))):
        assert pages.difference(a, b) == want


def test_confusions_are_learned(spark):
    """A confusion no list has: ``z`` read for ``k``. Words that are merely alike teach nothing."""
    frequent = [f"{a}ok{b}er" for a in "abcdef" for b in "lmn"] + ["planter", "planner", "slanter"]
    rare = [w.replace("k", "z") for w in frequent[:12]]
    both = [(w, 100) for w in frequent] + [(w, 1) for w in rare]
    df = spark.createDataFrame(both, "word string, n bigint")
    near = pages.neighbours(df, df.where("n >= 3"), slice_words=7)
    assert pages.learned(near) == [("z", "k")]
    fixed = {(r.word, r.candidate) for r in pages.candidates(near, pages.Confusions([*pages.CONFUSED, *pages.learned(near)])).where("cost > 0").collect()}
    assert {w for w, _ in fixed} == set(rare) and all((w, w.replace("z", "k")) in fixed for w in rare)


SCHEMA = "doc_sha string, page int, seq int, element_type string, text string, bbox array<double>, font_size double, bold boolean, flags array<string>, confidence double"
BODY = [
    "The WHO shall inspect the harbour wall and the load-bearing",
    "frame of the harbour before the operator can inspect the wall of the",
    "harbour. The operator must record the frame and inspect the load-",
    "bearing wall, and the operator shall re-",
    "cord the harbour frame. The operator must in-",
    "spect every wall.",
]


def make(pages_=3):
    rows, seq = [], 0
    for p in range(1, pages_ + 1):
        texts = ["Harbour rules - part one" + ("" if p % 2 else f"  {p}"), *BODY, "Item Limit Unit", "604", f"Page {p}"]
        for t in texts:
            t = t.replace("WHO", ["captain", "pilot", "keeper of the light"][p % 3])
            rows.append(("d", p, seq, "table" if t in ("604", "Item Limit Unit") else "paragraph", t, None, None, None, None, None))
            seq += 1
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = make()
    rows[12] = (*rows[12][:4], "frame of the harb0ur before the operator can inspect the wall of the", *rows[12][5:])
    rows += [rows[3], ("d", None, 7, None, "x", None, None, None, None, None), ("d", 1, 90, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return rows, {(r.page, r.seq, r.defect) for r in pages.found(df).collect()}, [r.text for r in pages.paragraphs(df).orderBy("para").collect()]


def test_defects(found):
    rows, got, _ = found
    want = set()
    for _, page, seq, _, text, *_ in rows:
        if text is None or page is None:
            continue
        if text.startswith("Harbour rules"):
            want.add((page, seq, "header"))
        if text.startswith("Page"):
            want.add((page, seq, "page_number"))
        if text.endswith((" re-", " in-")):
            want.add((page, seq, "hyphen"))
        if "harb0ur" in text:
            want.add((page, seq, "misread"))
    assert got == want


def test_paragraphs(found):
    text = " ".join(found[2])
    assert "harb0ur" not in text and "load-bearing wall" in text and "shall record the" in text and "must inspect every wall." in text
    assert "Page" not in text and "Harbour rules" not in text and "604" not in text


def test_empty(spark):
    assert pages.found(spark.createDataFrame([], SCHEMA)).count() == 0
