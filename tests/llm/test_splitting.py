import random

import pytest
from lexweave.llm import splitting as sp


def check(body, unit, most, overlap):
    parts = sp.split_text(body, unit, most, overlap)
    by_words = unit == sp.WORDS
    n = sp._units(body, 0, len(body), by_words)
    if n <= most:
        assert len(parts) == (1 if body else 0)
        return parts
    assert len(parts) > 1
    assert parts[0][1] == 0 and parts[-1][2] == len(body)
    want = min(overlap, most - 1)
    for k, (start, cut, end) in enumerate(parts):
        assert sp._units(body, start, end, by_words) <= most
        assert cut < end
        if k:
            assert cut == parts[k - 1][2]
            assert sp._units(body, start, cut, by_words) == want
            assert start >= parts[k - 1][0]
    return parts


@pytest.mark.parametrize("unit", [sp.WORDS, "characters"])
def test_random_bodies(unit):
    rnd = random.Random(5)
    for _ in range(400):
        body = "".join(rnd.choice(["word", "a", "ßéñ", "x" * 30, " ", "  ", "\n\n", "\r\n", ". ", ", ", "　", "\xa0", "。", "🙂"]) for _ in range(rnd.randint(0, 160)))
        check(body, unit, rnd.randint(1, 40), rnd.randint(0, 12))


def test_natural_boundaries():
    body = "One two three. Four five six.\n\nSeven eight nine. Ten eleven twelve."
    parts = check(body, sp.WORDS, 6, 0)
    assert [body[a:c] for a, _, c in parts] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven twelve."]


def test_no_boundaries():
    parts = check("x" * 1000, "characters", 100, 10)
    assert len(parts) >= 11


def test_table(spark):
    chunks = spark.createDataFrame(
        [("a", 1, "one two three four", 9), ("a", 1, "one two three four", 9), ("b", 1, "", 9), ("c", 1, None, 9), ("d", None, "x " * 99, 9), ("e", 7, "x " * 99, 9), ("f", 2, "abc", 9)],
        "chunk_id string, policy_id int, body string, max_size int",
    )
    policies = spark.createDataFrame([(1, sp.WORDS, 2, 3, 1), (2, "characters", 2, 2, 0)], "policy_id int, budget_unit string, target_size int, max_size int, overlap_size int")
    rows = sp.split_oversized(chunks, policies).collect()
    assert {r.chunk_id for r in rows} == {"a", "f"}
    assert sum(r.chunk_id == "a" for r in rows) == 2
    assert sp.split_oversized(chunks.limit(0), policies).count() == 0
