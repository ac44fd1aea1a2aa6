"""Problem 1 against a plain replay of the whole feed."""

import random
import re
from datetime import date, datetime, timedelta

import pyarrow.parquet as pq
import pytest

from lexweave.streaming import changefeed

SCHEMA = "feed_pos bigint, action_id string, notice string, target_id string, target_anchor string, kind string, effective date, text string, revision int, received_at timestamp"


def plain_work(x):
    x = re.sub(r"[@#].*", "", x or "").strip()
    return (x.split(":")[0].upper() + x[x.index(":") :]) if ":" in x else x


def plain_anchor(x):
    x = re.sub(r"\s", "", x or "").removeprefix("#")
    return re.sub(r"[()]+", "-", x).strip("-")


def kind_of(k):
    k = (k or "stay").strip().lower()
    for pattern, name in ((r"redesignat", "redesignate"), (r"remov|delet", "remove"), (r"^add", "add"), (r"stay|suspend", "stay")):
        if re.search(pattern, k):
            return name
    return "amend"


def replay(rows):
    best = {}
    for r in rows:
        key = (r["revision"] or 0, r["received_at"] or datetime.min, r["feed_pos"])
        a = r["action_id"].strip()
        if a not in best or key > best[a][0]:
            best[a] = (key, r)
    acts = []
    for a, (_, r) in best.items():
        if r["effective"] is not None:
            y, n, i = map(int, re.match(r".*:(\d+)-(\d+)#instr-(\d+)$", a).groups())
            acts.append(((r["effective"], y, n, i, a), a, r))
    state = {}
    for _, a, r in sorted(acts, key=lambda x: x[0]):
        w, p, k = plain_work(r["target_id"]), plain_anchor(r["target_anchor"]), kind_of(r["kind"])
        if not w:
            continue
        if k == "add" or (k == "amend" and (w, p) in state):
            state[w, p] = a
        elif k == "remove":
            for key in [(w, p)] if p else [x for x in state if x[0] == w]:
                state.pop(key, None)
        elif k == "redesignate" and (w, p) in state and p and plain_anchor(r["text"]):
            moved = state.pop((w, p))
            state[w, plain_anchor(r["text"])] = moved
    return {(w, p, a) for (w, p), a in state.items()}


def found(df):
    rows = [tuple(r) for r in df.select("target_id", "target_anchor", "action_id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(spark):
    path = "/root/testdata/sf0.01/actions.parquet"
    assert found(changefeed.rebuild(spark, path)) == replay(pq.read_table(path).to_pylist())


def random_feed(seed, n):
    rnd = random.Random(seed)
    rows = []
    for pos in range(n):
        k = rnd.choice(["add", "Add ", "amend", "revise", "remove", "delete", "redesignate", "redesignate", "suspend", None])
        anchor = rnd.choice(["a", "(b)", "#c", " d", "b-1", "(b)(1)", None, ""])
        if k == "redesignate" and not anchor:
            anchor = "a"
        if k in ("remove", "delete") and not anchor and rnd.random() < 0.7:
            anchor = "a"
        rows.append(
            (
                pos,
                f"RN:20{rnd.randint(10, 12)}-{rnd.choice(['0000', ''])}{rnd.randint(1, 30)}#instr-{rnd.randint(1, 12)}",
                None,
                rnd.choice(["UCR:1-2.3", " ucr:1-2.3", "UCR:1-2.3@2020-01-01", "HB:AM-3", "HB:AM-3#a", None]),
                anchor,
                k,
                rnd.choice([None] + [date(2020, 1, 1) + timedelta(days=d) for d in range(9)]),
                rnd.choice(["a", "(b)", "c", "(b)(1)"]) if k == "redesignate" else None,
                rnd.randint(1, 3),
                datetime(2020, 1, 1) + timedelta(hours=rnd.randint(0, 99)),
            )
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_feeds(spark, seed, tmp_path):
    rows = random_feed(seed, 700)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    df = spark.createDataFrame(rows, SCHEMA)
    actions = changefeed.latest_actions(df).select("action_id", "payload.*", "sequence")
    want = replay([dict(zip(names, r)) for r in rows])
    assert found(changefeed.current_paragraphs(actions)) == want
    # The same feed in pieces, repeated and out of order, gives the same state, also after a restart.
    path, state = str(tmp_path / "feed"), str(tmp_path / "state")
    random.Random(seed).shuffle(rows)
    for i in range(3):
        piece = rows[i::3] + rows[:50]
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        last = changefeed.rebuild(spark, path, state)
    assert found(last) == want


def test_empty_and_extra_columns(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA + ", seq string, work string, payload string").write.parquet(path)
    assert changefeed.rebuild(spark, path).count() == 0


def test_states_are_upserts_with_tombstones(spark, tmp_path):
    """Only touched works are written again; a paragraph that goes, or an action that moves, leaves a tombstone."""
    path, state = str(tmp_path / "feed"), str(tmp_path / "state")
    day = date(2020, 1, 1)
    act = lambda pos, a, w, p, k, eff=day, rev=1: (pos, f"RN:2020-1#instr-{a}", None, w, p, k, eff, "t", rev, datetime(2020, 1, 1))

    def go(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return found(changefeed.rebuild(spark, path, state))

    one = lambda a: f"RN:2020-1#instr-{a}"
    assert go(act(1, 1, "A:1", "a", "add"), act(2, 2, "A:1", "b", "add"), act(3, 3, "A:2", "a", "add")) == {("A:1", "a", one(1)), ("A:1", "b", one(2)), ("A:2", "a", one(3))}
    assert go(act(4, 4, "A:1", "b", "remove", date(2020, 1, 2))) == {("A:1", "a", one(1)), ("A:2", "a", one(3))}
    paragraphs = changefeed.paragraph_state(spark, state)
    last = spark.read.parquet(f"{paragraphs.root}/batch=1").collect()
    assert {(r.target_id, r.target_anchor, r.tombstone) for r in last} == {("A:1", "a", False), ("A:1", "b", True)}
    # The action moves to another work; an older revision that comes late does not bring it back, nor does a void one.
    assert go(act(5, 1, "A:3", "a", "add", rev=3)) == {("A:2", "a", one(3)), ("A:3", "a", one(1))}
    assert go(act(6, 1, "A:1", "a", "add", rev=2), act(7, 3, "A:2", "a", "add", None, 2)) == {("A:3", "a", one(1))}
    assert go(act(8, 3, "A:2", "a", "add", day, 1)) == {("A:3", "a", one(1))}
    assert {(r.action_id, r.tombstone) for r in changefeed.action_state(spark, state).current().collect()} == {(one(1), False), (one(2), False), (one(3), True), (one(4), False)}
    for s in (paragraphs, changefeed.action_state(spark, state)):
        s.compact()
    assert go(act(9, 9, "A:9", None, "add")) == {("A:3", "a", one(1)), ("A:9", "", one(9))}
