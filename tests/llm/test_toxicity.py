import random

import numpy as np
from lexweave.llm import toxicity as tx

NEUTRAL = ["The operator shall inspect the {}.", "No tenant may drain any {} near the {}.", "Abusive language toward the {} is forbidden and reported.", "The {} rule is a disaster."]
BAD = ["You stupid {} belong in a cage.", "Go hang yourself, {}.", "The {} people are subhuman vermin."]
NOUNS = "pump wall boat crane drum valve shaft notice permit tank".split()


def make(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rnd.random() < 0.3
        lines = [rnd.choice(NEUTRAL).replace("{}", "%s") for _ in range(rnd.randint(2, 6))]
        if bad:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(BAD).replace("{}", "%s"))
        text = "\n".join(x % tuple(rnd.choice(NOUNS) for _ in range(x.count("%s"))) for x in lines)
        rows.append((i, text, bad))
    return rows


def test_held_out(spark):
    rows = make(900, 1)
    docs = spark.createDataFrame([(i, t, f"s{i % 3}", 1) for i, t, _ in rows] + [(None, None, None, 1), (901, "", "s0", 1), (902, "?!", "s1", 1)], "doc_id bigint, text string, source string, flagged int")
    rnd = random.Random(2)
    labels = [(i, int(b) if rnd.random() > 0.05 else int(not b), "r") for i, _, b in rows[:450]] + [(5000, 1, "r"), (1, None, "r"), (None, 1, "r")]
    scores = tx.scored(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, rater string"))
    got = {r.doc_id: r for r in scores.collect()}
    assert len(got) == 903
    hits = sum(got[i].flagged == b for i, _, b in rows[450:])
    assert hits >= 0.97 * 450
    assert not got[901].flagged and not got[902].flagged and got[None].toxic == 0
    rates = tx.rates(scores).collect()
    assert sum(r.docs for r in rates) == 903


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, rater string")
    r = tx.scored(docs, labels).first()
    assert r.flagged is None and r.toxic is None and r.source is None
    assert tx.scored(docs.limit(0), labels).count() == 0


def test_disguises():
    plain = [tx.plain_form(w) for w in tx.split_words("stupid scum")]
    assert [tx.plain_form(w) for w in tx.split_words("s t u p i d scccuuummm")] == plain
    assert [tx.plain_form(w) for w in tx.split_words("5tup1d s​cu​m")] == plain
    assert "xstarx" in tx.split_words("you f*****g x") and "xstarx" not in tx.split_words("*as* stated **here**")


def test_long_text_and_too_few_marks():
    rows = make(60, 3)
    texts = tx.hashes_of([t for _, t, _ in rows], tx.Hashes())
    marks, counts = np.array([float(b) for _, _, b in rows]), tx.document_counts(texts)
    m = tx.train(texts, marks, counts)
    assert m.score([np.arange(200_000, dtype=np.int32)]).shape == (1, len(tx.CATEGORIES))
    assert tx.train([], np.array([]), counts) is None
    few = np.flatnonzero(marks > 0)[4:]
    marks[few] = 0.5
    assert tx.train(texts, marks, counts) is None


def test_document_counts():
    texts = [np.array(x, np.int32) for x in ([5, 6, -1, 5], [5, -1, 6], [])]
    counts = tx.document_counts(texts)
    word, pair, skip = tx.features(np.array([5, 6, -1], np.int32))
    assert counts[word[0]] == counts[word[1]] == 2 and counts[pair[0]] == 1 and counts[tx.SIZE] == 3


def test_few_marks_still_find(spark):
    """With 13 marked documents the sentences nobody else writes are found, whatever their words."""
    rows = make(700, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    marked = [i for i, _, b in rows if b][:13]
    labels = [(i, 1, "r") for i in marked] + [(i, 0, "r") for i, _, b in rows if not b][:76]
    got = {r.doc_id for r in tx.scored(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, rater string")).where("flagged").collect()}
    true = {i for i, _, b in rows if b}
    assert len(got & true) >= 0.9 * len(true) and len(got - true) <= 0.1 * len(true)


def test_quality(spark):
    rows = make(300, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    q = {r.category: r for r in tx.quality(docs, spark.createDataFrame([(i, int(b), "r") for i, _, b in rows], "doc_id bigint, toxic int, rater string")).collect()}
    assert q["toxic"].recall > 0.9 and q["documents"].precision > 0.9
