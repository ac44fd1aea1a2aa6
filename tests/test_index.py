"""The stored index against the scans it replaces, through updates, deletions and compaction; the ledger."""

import random

import pytest

from lexweave.operators import grep, ranking
from lexweave.sources import index as ix
from lexweave.sources.ledger import Ledger

WORDS = "hydraulic boiler crane pump wall notice permit the of a and shall inspect".split()


def texts(seed, n):
    rnd = random.Random(seed)
    return {i: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 30))) for i in range(n)}


def check(spark, index, docs):
    df = spark.createDataFrame([(k, v) for k, v in docs.items()], "doc_id bigint, text string")
    for q in ("hydraulic crane", "boiler boiler the", "absent", ""):
        want = {tuple(r) for r in ranking.bm25(df, q, "doc_id", {"text": 1.0}).collect()} if q else set()
        assert {tuple(r) for r in index.bm25(q).collect()} == want, q
    for pattern in ("hydraulic (boiler|crane)", "pump", "x+"):
        assert {tuple(r) for r in index.matches(df, pattern).collect()} == {tuple(r) for r in grep.matches(df, "doc_id", "text", pattern).collect()}
    last = index.segments()[-1]
    assert last["documents"] == len(docs) and last["lengths"] == [sum(len(t.split()) for t in docs.values() if t)]


@pytest.mark.parametrize("per_bucket", [2_000_000, 500])
def test_updates(spark, tmp_path, monkeypatch, per_bucket):
    monkeypatch.setattr(ix, "ROWS_PER_BUCKET", per_bucket)
    index = ix.SearchIndex(spark, f"file://{tmp_path}/i", "doc_id", ["text"], "text")
    make = lambda docs: spark.createDataFrame([(k, v) for k, v in docs.items()] + [(None, "pump")], "doc_id bigint, text string")
    docs = texts(1, 60)
    docs[7] = None
    assert index.update(make(docs)) == 60
    check(spark, index, docs)
    assert index.update(make(docs)) == 0 and len(index.segments()) == 1  # nothing new: nothing is published
    docs.update({k: v for k, v in texts(2, 20).items() if k % 2})
    docs.update({100: "hydraulic boiler", 101: "the the the"})
    del docs[4], docs[6]
    assert index.update(make(docs)) == 12
    check(spark, index, docs)
    assert index.update(make({200: "crane"}), complete=False) == 1
    docs[200] = "crane"
    check(spark, index, docs)
    assert index.update(make({k: v for k, v in docs.items() if k != 200})) == 0  # a deletion alone
    del docs[200]
    check(spark, index, docs)
    index.compact(make(docs))
    assert len(index.segments()) == 1
    check(spark, index, docs)
    index.update(make({**docs, 300: "crane crane"}))
    check(spark, index, {**docs, 300: "crane crane"})


def test_empty_index(spark, tmp_path):
    index = ix.SearchIndex(spark, f"file://{tmp_path}/i", "doc_id", ["text"], "text")
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert index.bm25("crane").count() == 0 and index.candidates([["boiler"]]).count() == 0
    assert index.update(docs) == 0 and index.bm25("crane").count() == 0 and index.matches(docs, "crane").count() == 0
    index.update(spark.createDataFrame([(1, "crane")], "doc_id bigint, text string"))
    assert [r.doc_id for r in index.bm25("crane").collect()] == [1]


def test_fields(spark, tmp_path):
    rows = [(1, "crane rules", "the pump"), (2, None, "crane crane"), (3, "walls", None)]
    df = spark.createDataFrame(rows, "k bigint, title string, body string")
    index = ix.SearchIndex(spark, f"file://{tmp_path}/i", "k", ["title", "body"])
    index.update(df)
    boosts = {"title": 3.0, "body": 1.0}
    assert {tuple(r) for r in index.bm25("crane pump", boosts).collect()} == {tuple(r) for r in ranking.bm25(df, "crane pump", "k", boosts).collect()}


def test_ties_are_kept(spark):
    df = spark.createDataFrame([(i, float(10 - i // 3)) for i in range(12)], "k bigint, score double")
    assert [r.k for r in ranking.top(df, "k", 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert [r.k for r in ranking.top(df, "k", 4, ties=True).orderBy("rank").collect()] == [0, 1, 2, 3, 4, 5]
    assert ranking.top(df, "k", 50, ties=True).count() == 12


def test_nearest_against_loops(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((120, 5)), 1)
    v[7] = 0
    v[20:30] = v[20]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "k bigint, v array<double>").repartition(3)
    got = {}
    for r in ranking.nearest(df, df.where("k % 20 = 0"), "k", "v", 9, block=4).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.k
    with np.errstate(all="ignore"):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 120, 20):
        cos = np.round(u @ u[q], 6)
        order = sorted(range(120), key=lambda i: (np.isnan(cos[i]), -np.round(cos[i] * 1000) if not np.isnan(cos[i]) else 0, i))
        assert [got[q][k + 1] for k in range(9)] == order[:9]


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    assert ledger.receipts().count() == 0
    run = ledger.begin("src", "2024-01")
    assert ledger.begin("src", "2024-01") == run and ledger.done(run, "extract", "k1") is None
    assert ledger.receipt(run, "extract", "failed", "k1") == 1 and ledger.done(run, "extract", "k1") is None
    assert ledger.receipt(run, "extract", "complete", "k1", "out") == 2
    assert ledger.done(run, "extract", "k1") == "out" and ledger.done(run, "extract", "k2") is None
    rows = {(r.stage, r.attempt, r.state) for r in ledger.receipts().collect()}
    assert rows == {("extract", 1, "failed"), ("extract", 2, "complete")}
    assert ledger.lock("src", "a") and ledger.lock("src", "a") and not ledger.lock("src", "b")
    ledger.unlock("src", "b")
    assert not ledger.lock("src", "b") and ledger.lock("src", "b", stale_after=0)
    ledger.unlock("src", "b")
    assert ledger.lock("src", "c")
