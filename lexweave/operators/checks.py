"""Checks on references, actions, evidence, artifacts and identities, and the gates a release has to pass
(SURVEY A15, A18, J11, SO5, T9, T14, V4, V7-V9, V11, V13-V15)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.functions import text as T
from lexweave.operators import fuzzy


# ---- references


def reference_list(expressions: DataFrame) -> DataFrame:
    """(expr, effective, place, to_id, anchor): every work an Expression names in its body's links or its front matter."""
    me = names.expression_id(F.col("id"), F.col("effective"))
    ref = lambda place, to, anchor=F.lit(""): F.struct(F.lit(place).alias("place"), names.plain_work(to).alias("to_id"), F.coalesce(names.plain_anchor(anchor), F.lit("")).alias("anchor"))
    arr = lambda x: F.coalesce(x, F.array())
    one = lambda x: F.array(ref(x, F.col(x)))
    all_ = F.concat(
        F.transform(T.links(F.coalesce("body", F.lit(""))), lambda x: ref("body", x["target"], x["anchor"])),
        F.transform(arr("overrides"), lambda x: ref("overrides", x)),
        F.transform(arr("narrows"), lambda x: ref("narrows", x["id"], x["anchor"])),
        one("supersedes"),
        one("superseded_by"),
        one("parent"),
    )
    return expressions.select(me.alias("expr"), "effective", F.explode(F.array_distinct(all_)).alias("r")).select("expr", "effective", "r.*").where("to_id IS NOT NULL")


def reference_faults(expressions: DataFrame) -> DataFrame:
    """(expr, place, to_id, fault): names that no work has, or of a work that is not active on the referrer's date: none of its
    Expressions is effective by then without having been superseded by then. Undated referrers need the work only."""
    refs = reference_list(expressions)
    works = expressions.select(F.col("id").alias("to_id")).distinct()
    unknown = refs.join(works, "to_id", "left_anti").select("expr", "place", "to_id", F.lit("unknown").alias("fault"))
    dated = refs.where("effective IS NOT NULL").join(works, "to_id", "left_semi")
    asked = dated.select("to_id", "effective").distinct()
    lives = expressions.where("effective IS NOT NULL").select(F.col("id").alias("to_id"), F.col("effective").alias("since"), names.version_date("superseded_by").alias("until"))
    # Works have at most a row a day, and each is asked for distinct days only.
    active = asked.join(lives, "to_id").where((F.col("since") <= F.col("effective")) & (F.col("until").isNull() | (F.col("until") > F.col("effective")))).select("to_id", "effective").distinct()
    idle = dated.join(active, ["to_id", "effective"], "left_anti").select("expr", "place", "to_id", F.lit("inactive").alias("fault"))
    return unknown.unionByName(idle).distinct()


def missing_anchors(refs: DataFrame, anchors: DataFrame, defined: DataFrame) -> DataFrame:
    """References (to_id, anchor, ...) to a paragraph that no version of the work has, neither as an anchor (id, anchor) nor as a
    defined term (id, slug)."""
    there = anchors.select(F.col("id").alias("to_id"), "anchor").unionByName(defined.select(F.col("id").alias("to_id"), F.col("slug").alias("anchor"))).distinct()
    return refs.where("anchor IS NOT NULL AND anchor <> ''").join(there, ["to_id", "anchor"], "left_anti").select(*refs.columns)


# ---- actions and evidence


def action_integrity(expressions: DataFrame, actions: DataFrame, least: float = 0.92) -> DataFrame:
    """(expr, action_id, score, held): how much of the text of each action that an Expression names its body holds in order.

    actions: action_id, text. Texts that stand in the body as they are score 1 without alignment.
    """
    named = expressions.select(names.expression_id(F.col("id"), F.col("effective")).alias("expr"), "body", F.explode("amended_by").alias("x")).select("expr", "body", names.plain_action("x").alias("action_id"))
    rows = named.where("action_id IS NOT NULL").distinct().join(actions.where("trim(text) <> ''").select("action_id", "text"), "action_id")
    whole = F.contains(F.coalesce("body", F.lit("")), F.col("text"))
    exact = rows.where(whole).select("expr", "action_id", F.lit(1.0).alias("score"))
    rest = rows.where(~whole).withColumn("pair", F.concat_ws("\x1f", "expr", "action_id"))
    scored = fuzzy.span_matches(rest, "pair", "text", "body").select(F.substring_index("key", "\x1f", 1).alias("expr"), F.substring_index("key", "\x1f", -1).alias("action_id"), "score")
    return exact.unionByName(scored).withColumn("held", F.col("score") >= least)


def evidence_faults(judgments: DataFrame, texts: DataFrame, fields: list[str]) -> DataFrame:
    """(item, field, fault): judged fields without a quote, with a quote that is not in the item's text (blanks squeezed), or with
    one that stands there more than once. judgments: item, <field>, <field>_quote ...; texts: item, text."""
    squeezed = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    long = judgments.select("item", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f"{f}_quote").alias("quote")) for f in fields))).alias("x")).select("item", "x.*").where("value IS NOT NULL")
    rows = long.join(texts.select("item", squeezed(F.col("text")).alias("text")), "item", "left").withColumn("quote", squeezed(F.col("quote")))
    times = (F.length("text") - F.length(F.replace("text", F.col("quote"), F.lit("")))) / F.length("quote")
    fault = F.when(F.coalesce("quote", F.lit("")) == "", "no_quote").when(F.col("text").isNull() | ~F.contains("text", "quote"), "quote_not_found").when(times > 1, "quote_ambiguous")
    return rows.select("item", "field", fault.alias("fault")).where("fault IS NOT NULL")


def verdict_summary(judgments: DataFrame, item: str, verdict: str) -> DataFrame:
    """(verdict, items) of the items whose raters agree, ``disputed`` ones, and the rate of agreement over items with several
    judgments (1 where there are none)."""
    per = judgments.where(F.col(item).isNotNull() & F.col(verdict).isNotNull()).groupBy(item).agg(F.count("*").alias("n"), F.min(verdict).alias("lo"), F.max(verdict).alias("hi"))
    state = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise("disputed")
    rate = per.where("n > 1").agg(F.round(F.coalesce(F.avg((F.col("lo") == F.col("hi")).cast("double")), F.lit(1.0)), 6).alias("agreement"))
    return per.groupBy(state.alias("verdict")).agg(F.count("*").alias("items")).crossJoin(F.broadcast(rate))


# ---- artifacts and identities


def artifact_faults(elements: DataFrame) -> DataFrame:
    """(doc_sha, fault, n): rules an extracted file breaks and how often: a place given twice to different texts, pages that
    go back in reading order, confidence out of range, a box that is missing, not four numbers or without area, rows without a place."""
    at = elements.where("doc_sha IS NOT NULL AND page IS NOT NULL AND seq IS NOT NULL")
    twice = at.groupBy("doc_sha", "seq").agg(F.countDistinct(F.coalesce("text", F.lit(""))).alias("n")).where("n > 1").groupBy("doc_sha").agg(F.count("*").alias("n")).withColumn("fault", F.lit("place_taken_twice"))
    pages = at.groupBy("doc_sha", "page").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    back = pages.withColumn("before", F.lag("hi").over(Window.partitionBy("doc_sha").orderBy("page"))).where("lo < before").groupBy("doc_sha").agg(F.count("*").alias("n")).withColumn("fault", F.lit("pages_out_of_order"))
    box = F.col("bbox")
    each = F.array_compact(
        F.array(
            F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence_out_of_range"),
            F.when(box.isNotNull() & (F.size("bbox") != 4), "box_incomplete"),
            F.when((F.size("bbox") == 4) & ((F.get("bbox", 0) >= F.get("bbox", 2)) | (F.get("bbox", 1) >= F.get("bbox", 3))), "box_without_area"),
            F.when(box.isNull(), "box_missing"),
            F.when(F.col("page").isNull() | F.col("seq").isNull(), "no_place"),
        )
    )
    rows = elements.where("doc_sha IS NOT NULL").select("doc_sha", F.explode(each).alias("fault")).groupBy("doc_sha", "fault").agg(F.count("*").alias("n"))
    cols = ["doc_sha", "fault", "n"]
    return rows.select(*cols).unionByName(twice.select(*cols)).unionByName(back.select(*cols))


def identity_faults(ledger: DataFrame, native: str, uid: str) -> DataFrame:
    """(fault, id, n): one identity given to several natives, or one native with several identities."""
    pairs = ledger.where(F.col(native).isNotNull() & F.col(uid).isNotNull()).select(F.col(native).alias("native"), F.col(uid).alias("uid")).distinct()
    many = lambda by, fault: pairs.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(fault).alias("fault"), "id", "n")
    return many("uid", "identity_shared").unionByName(many("native", "native_split"))


# ---- gates and scores


def blockers(metrics: DataFrame, gates: list[tuple[str, str, float]]) -> DataFrame:
    """(metric, value, gate): the gates (metric, ``>=`` or ``<=``, bound) that metrics (metric, value) do not pass; a metric that
    is not there blocks too."""
    spark = metrics.sparkSession
    asked = spark.createDataFrame([(m, op, float(b), f"{op} {b:g}") for m, op, b in gates], "metric string, op string, bound double, gate string")
    passed = F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return F.broadcast(asked).join(metrics.select("metric", F.col("value").cast("double").alias("value")), "metric", "left").where(~F.coalesce(passed, F.lit(False))).select("metric", "value", "gate")


def answer_scores(hits: DataFrame, relevant: DataFrame, support: DataFrame, tasks: DataFrame, k: int = 5) -> DataFrame:
    """(task, recall, precision, support_recall, no_answer_correct) of every task; null where a score has no meaning.

    hits: task, expr, rank; relevant, support: task, expr; tasks: task, abstained. A task without relevant texts has no answer
    and is right if the engine abstains.
    """
    want, back = relevant.groupBy("task").agg(F.countDistinct("expr").alias("want")), support.groupBy("task").agg(F.countDistinct("expr").alias("back"))
    got = hits.where(F.col("rank") <= k).join(relevant.select("task", "expr").distinct(), ["task", "expr"]).groupBy("task").agg(F.countDistinct("expr").alias("got"))
    held = hits.join(support.select("task", "expr").distinct(), ["task", "expr"]).groupBy("task").agg(F.countDistinct("expr").alias("held"))
    rows = tasks.join(want, "task", "left").join(back, "task", "left").join(got, "task", "left").join(held, "task", "left")
    share = lambda a, b: F.round(F.coalesce(a, F.lit(0)) / b, 6)
    return rows.select(
        "task",
        share(F.col("got"), F.col("want")).alias("recall"),
        F.when(F.col("want").isNotNull(), share(F.col("got"), F.lit(k))).alias("precision"),
        share(F.col("held"), F.col("back")).alias("support_recall"),
        F.when(F.col("want").isNull(), F.col("abstained").cast("int").cast("double")).alias("no_answer_correct"),
    )


def line_changes(old: Column, new: Column) -> tuple[Column, Column]:
    """(added, removed) lines of a text against the one before it, as sets without outer blanks and empty lines."""
    rows = lambda x: F.array_distinct(F.filter(F.transform(T.lines(F.coalesce(x, F.lit(""))), lambda t: F.trim(t)), lambda t: t != ""))
    return F.array_except(rows(new), rows(old)), F.array_except(rows(old), rows(new))


def text_edit(a: str, b: str) -> float:
    """Edit distance of two texts over the greater length, white space single: 0 for equal ones."""
    a, b = " ".join(a.split()), " ".join(b.split())
    return 1 - fuzzy.similar(a, b)


def order_score(read: list[str], truth: list[str]) -> float:
    """Share of the truth's blocks that stand in one ascending order in the reading (each block by its first place)."""
    place = {}
    for i, x in enumerate(read):
        place.setdefault(x, i)
    tails: list[int] = []
    for at in (place[x] for x in truth if x in place):
        lo, hi = 0, len(tails)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if tails[mid] < at else (lo, mid)
        tails[lo : lo + 1] = [at]
    return len(tails) / len(truth) if truth else 1.0


def table_score(a: list[list[str]], b: list[list[str]]) -> float:
    """Likeness of two tables as trees of rows and cells: 1 less the least cost of editing one into the other (rows aligned, cells
    aligned within a row, a changed cell costs its share of changed letters) over the nodes of the greater one."""
    size = lambda t: 1 + sum(1 + len(r) for r in t)

    def aligned(xs, ys, drop, change):
        row = [0.0]
        for y in ys:
            row.append(row[-1] + drop(y))
        for x in xs:
            new = [row[0] + drop(x)]
            for j, y in enumerate(ys):
                new.append(min(row[j] + change(x, y), row[j + 1] + drop(x), new[j] + drop(y)))
            row = new
        return row[-1]

    cells = lambda x, y: aligned(x, y, lambda _: 1.0, lambda p, q: text_edit(p, q))
    cost = aligned(a, b, lambda r: 1.0 + len(r), cells)
    return max(0.0, 1 - cost / max(size(a), size(b)))


def focused_text(body: str, quote: str, around: int = 60) -> str:
    """The part of a text a verifier has to see: the quote with ``around`` words on both sides, or the beginning without it."""
    at = body.find(quote) if quote else -1
    if at < 0:
        return " ".join(body.split()[: 2 * around])
    before, after = body[:at].split(), body[at + len(quote) :].split()
    return " ".join([*before[max(0, len(before) - around) :], quote, *after[:around]])


_ANSWER = re.compile(r"^\W*(?:verdict|answer)\W*(yes|no|supported|unsupported|uncertain|unclear)\b", re.I | re.M)


def verdict_of(answer: str) -> str:
    """yes, no or uncertain from a verifier's free answer: its last line that names a verdict, else a first word that is one."""
    found = [m.group(1).lower() for m in _ANSWER.finditer(answer)]
    word = found[-1] if found else next(iter(re.findall(r"[a-z]+", answer.lower())), "")
    return {"yes": "yes", "supported": "yes", "no": "no", "unsupported": "no"}.get(word, "uncertain")
