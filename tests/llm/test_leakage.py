import random

import numpy as np
import pytest
from lexweave.llm import leakage as lk

NOUNS = [f"n{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def make_sentence(rnd):
    form = rnd.choice(["no {} may {} or {} any {} of the {} until the {} is {}", "the {} shall {} each {} near the {} when the {} is {} again by {}"])
    return form.format(*(rnd.choice(NOUNS) for _ in range(form.count("{}"))))


def make(seed=4):
    rnd = random.Random(seed)
    text = lambda k: ". ".join(make_sentence(rnd) for _ in range(k))
    items = [(i, text(5), "en") for i in range(12)]
    docs, want = [(None, "x"), (900, None), (901, "")], set()
    for d in range(400):
        body = text(rnd.randint(3, 12))
        if d % 20 == 0:
            item = rnd.choice(items)
            w = item[1].split()
            kind = d // 20 % 4
            start = rnd.randint(0, len(w) - 40)
            part = w[start : start + 40]
            if kind == 1:
                part = [x.upper() if rnd.random() < 0.3 else x for x in part]
            if kind == 2:
                part = [rnd.choice(NOUNS) if i % 9 == 4 else x for i, x in enumerate(part)]
            if kind == 3:
                part = part[:20] + make_sentence(rnd).split() + part[20:]
            body = body + "\n\n" + " ".join(part) + "\n" + text(2)
            want.add((d, item[0]))
        elif d % 20 == 7:  # a shared phrase is no leak
            w = rnd.choice(items)[1].split()
            body += " ".join(w[10:20]) + text(1)
        docs.append((d, body))
    return docs, items, want


def test_planted_passages(spark):
    docs, items, want = make()
    df = spark.createDataFrame(docs + docs[50:60], "doc_id bigint, text string").repartition(3)
    ev = spark.createDataFrame(items + [(99, None, "en"), (98, "", "en")], "item_id bigint, text string, lang string")
    rows = lk.leaked(df, ev).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(rows) == len(got) and got == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    ev = spark.createDataFrame([(1, "some words here", None)], "item_id bigint, text string, lang string")
    assert lk.leaked(docs, ev).count() == 0
    assert lk.leaked(docs, ev.limit(0)).count() == 0


def slow_align(doc, item, gain, gap=4, jump=24):
    row = [(0, 0)] * len(doc)
    best = (0, 0)
    for w in item:
        new = []
        for j, x in enumerate(doc):
            d = row[j - 1] if j else (0, 0)
            d = (d[0] + gain[w], d[1] + 1) if x == w else (d[0] - 6, d[1])
            new.append(max(d, (row[j][0] - gap, row[j][1]), (0, 0)))
        best = max(best, max(new))
        row = [max(new[j], (0, 0), *((new[k][0] - min(gap * (j - k), jump), new[k][1]) for k in range(j))) for j in range(len(doc))]
    return best


def test_alignment_against_loops():
    rng = np.random.default_rng(1)
    gain = np.append(rng.integers(1, 11, 6).astype(np.int32), [0, 0])
    for _ in range(30):
        doc, item = rng.integers(-1, 6, (4, 40)).astype(np.int32), rng.integers(0, 6, (4, 12)).astype(np.int32)
        score, words = lk.align(doc, item, gain)
        fast = lk.align_score(doc, item, gain)
        for i in range(4):
            assert (score[i], words[i]) == slow_align(doc[i].tolist(), item[i].tolist(), gain)
            assert fast[i] == score[i]


def test_jumps_within_and_over_blocks_are_exact():
    """Runs of 6 to 9 words left out at every place of a block, many times over."""
    gain = np.array([10] * 40 + [0, 0], np.int32)
    item = np.arange(40, dtype=np.int32)
    for skip in (6, 7, 8, 9):
        for at in range(8):
            doc = np.concatenate([np.full(at, -1), *(np.append(item[i : i + 4], np.full(skip - 1 + (i == 4), -1)) for i in range(0, 40, 4))]).astype(np.int32)
            doc = np.pad(doc, (0, -len(doc) % 8), constant_values=-1)[None]
            score, words = lk.align(doc, item[None], gain)
            assert lk.align_score(doc, item[None], gain) == score and (score[0], words[0]) == slow_align(doc[0].tolist(), item.tolist(), gain)


def test_very_long_items():
    """Neither the score nor the matches of a long passage run over, and both forms agree."""
    item = np.tile(np.arange(100, dtype=np.int32), 60)[None, :6000]
    gain = np.append(np.full(100, 10, np.int32), [0, 0])
    score, words = lk.align(item, item, gain)
    assert (score[0], words[0]) == (60_000, 6000) and lk.align_score(item, item, gain)[0] == 60_000


def test_other_language_around(spark):
    """A passage inside a text of another language is compared with the items of its own."""
    rnd = random.Random(3)
    voc = {lang: [f"{lang}{i}" for i in range(150)] for lang in ("en", "de")}
    items = [(n, [rnd.choice(voc[lang]) for _ in range(60)], lang) for n, lang in enumerate(["en", "de", "en", "de"])]
    docs = [(d, " ".join(rnd.choice(voc["de" if d % 2 else "en"]) for _ in range(150))) for d in range(120)]
    part = [w for i, w in enumerate(items[0][1][10:40]) if i % 6 != 5]  # every sixth word left out
    docs.append((177, docs[1][1] + " " + " ".join(part) + " " + docs[3][1]))
    ev = spark.createDataFrame([(k, " ".join(w), lang) for k, w, lang in items], "item_id bigint, text string, lang string")
    assert {(r.doc_id, r.item_id) for r in lk.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), ev).collect()} == {(177, 0)}


def test_blocks_of_items_and_answers(spark):
    docs, items, want = make()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    ev = spark.createDataFrame(items, "item_id bigint, text string, lang string")
    assert {(r.doc_id, r.item_id) for r in lk.leaked(df, ev, lk.Params(block_words=300)).collect()} == want
    texts = [np.array(x) for x in ([0, 1, 2], [0, 2])]
    search = lk.Searcher.__new__(lk.Searcher)
    search.items = lk.Items.of([("k", "a b c", "en", "c a"), ("j", "a b", "en", None)])
    at = search.items.keys.index("k")
    voc = search.items.vocabulary
    assert search._answered(np.array([[voc["a"], voc["c"], -1]]), at) and not search._answered(np.array([[voc["a"], -1]]), at) and search._answered(texts[1], 1 - at)


@pytest.mark.parametrize("sizes", [[], [0], [1, 16, 17]])
def test_blocks(sizes):
    ids, first = lk.blocks_of([np.arange(n, dtype=np.int32) for n in sizes], 16)
    assert len(first) == len(sizes) + 1 and len(ids) == first[-1]


def slow_chain(doc, item, rewordings, interruptions):
    """By trying every earlier match: states are (place, words of the item, rewordings, interruptions)."""
    ends = {}
    for i, w in enumerate(item):
        for j, x in enumerate(doc):
            if x != w:
                continue
            ends[i, j, 0, 0] = 1
            for (i2, j2, r, q), m in [e for e in ends.items() if e[0][0] < i and e[0][1] < j]:
                di, dj = i - i2 - 1, j - j2 - 1
                nexts = [(r, q)] if di == dj == 0 else [(r + max(1, di), q)] * (dj <= 3) + [(r + di, q + 1)] * (dj <= 31)
                for r2, q2 in nexts:
                    if r2 <= rewordings and q2 <= interruptions:
                        ends[i, j, r2, q2] = max(ends.get((i, j, r2, q2), 1), m + 1)
    return max(ends.values(), default=0)


def test_chains_against_loops():
    rng = np.random.default_rng(2)
    for _ in range(12):
        doc, item = rng.integers(-1, 9, (3, 48)).astype(np.int32), rng.integers(0, 9, (3, 10)).astype(np.int32)
        got = lk.chained(doc, item, 2, 1)
        assert got.tolist() == [slow_chain(doc[i].tolist(), item[i].tolist(), 2, 1) for i in range(3)]


def test_common_words_interrupted_and_reworded(spark):
    """Passages of 22 words that every document is full of: two reworded, an interruption of 8 to 20, one copied widely."""
    rnd = random.Random(9)
    voc = {lang: [f"{lang}{i}" for i in range(60)] for lang in ("en", "de", "fr")}
    text = lambda lang, k: [rnd.choice(voc[lang]) for _ in range(k)]
    items = [(10 * n + i, text(lang, 60), lang) for n, lang in enumerate(voc) for i in range(3)]
    docs, want = [(d, " ".join(text(rnd.choice([*voc]), rnd.randint(60, 200)))) for d in range(300)], set()
    for d in range(300, 345):
        key, words, lang = items[d % 9]
        start, cut = rnd.randint(0, 38), rnd.randint(3, 19)
        part = words[start : start + 22]
        for x in rnd.sample(range(1, 21), 2):
            part[x] = "other"
        body = " ".join(text(lang, 50) + part[:cut] + text(lang, rnd.randint(8, 20)) + part[cut:] + text(lang, 50))
        for copy in range(30 if d == 300 else 1):
            docs.append((d + 1000 * copy, body))
            want.add((d + 1000 * copy, key))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    ev = spark.createDataFrame([(k, " ".join(w), lang) for k, w, lang in items], "item_id bigint, text string, lang string")
    assert {(r.doc_id, r.item_id) for r in lk.leaked(df, ev).collect()} == want
