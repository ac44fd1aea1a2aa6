"""Finding one's way: inherited context, expansion of hits, complete maps, home sources, near terms, passages and their members
(SURVEY F8, F9, G5, G8, G10, K5, P11, P17, P29, VB10, VB11, W13)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.functions import text as T
from lexweave.functions.names import c
from lexweave.session import staged


# ---- what is text, and what only leads to it


def is_navigation(x: str | Column) -> Column:
    """A text that only leads elsewhere: every line with letters is a heading, an item that is one link, or an entry with a
    page number after dots. Texts without a line are none."""
    rows = F.filter(T.lines(x), lambda line: line.rlike(r"\p{L}"))
    leads = r"^\s*(?:#+\s.*|[-*+]?\s*\[[^\]]*\]\([^)]*\)[.;,]?|.*\.{3,}\s*[0-9ivxlc]+)\s*$"
    return F.coalesce((F.size(rows) > 0) & F.forall(rows, lambda line: line.rlike(leads)), F.lit(False))


def regions(elements: DataFrame, excluded: tuple[str, ...] = ("header", "footer", "page_number")) -> DataFrame:
    """Elements with ``searchable``: what is excluded from the text is kept as evidence, not dropped. A null type is text."""
    return elements.withColumn("searchable", ~F.coalesce(F.col("element_type").isin(*excluded), F.lit(False)))


def delinked(rows: DataFrame, key: str, text: str, keep: DataFrame) -> DataFrame:
    """(key, text): links whose target is not in ``keep`` (id) as their plain text; the others stay links.

    Targets that go are found by one anti-join over all links and joined back to their text.
    """
    targets = rows.select(key, F.explode(T.links(text)).alias("l")).select(key, F.col("l.target").alias("id")).distinct()
    gone = targets.join(keep.select("id").distinct(), "id", "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("_gone"))
    # Ids hold letters, digits and ":.-@()" only; quoting keeps them literal.
    unlink = lambda body, target: F.regexp_replace(body, F.concat(F.lit(r"\[([^\]]*)\]\(\Q"), target, F.lit(r"\E(?:#[^)]*)?\)")), F.lit("$1"))
    return rows.join(gone, key, "left").select(key, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.aggregate("_gone", F.col(text), unlink)).alias(text))


# ---- trees and dates


def inherited_context(expressions: DataFrame, day: str, title: str = "title") -> DataFrame:
    """(expr, depth, chain, breadcrumb): titles from the topmost ancestor to the Expression, each as of the date that applies.

    That is ``day``, or an Expression's own date if it is superseded or not yet in force. An ancestor with no text then ends
    the chain, as does one that comes twice. Rounds go up one step for all Expressions; each is written out.
    """
    d = F.lit(day).cast("date")
    base = expressions.select("id", "effective", F.coalesce(title, F.lit("")).alias("title"), names.plain_work("parent").alias("up"), F.col("superseded_by").isNotNull().alias("old"), "retired")
    at = F.when(F.col("old") | (F.col("effective") > d), F.coalesce("effective", d)).otherwise(d)
    now = staged(base.select(names.expression_id(F.col("id"), F.col("effective")).alias("expr"), at.alias("at"), F.array("id").alias("chain"), F.array("title").alias("titles"), "up"), "context")
    done = []
    versions = base.select(F.col("id").alias("up"), F.struct(F.col("effective"), F.col("title"), F.col("up").alias("next"), F.col("retired")).alias("v"))
    while True:
        asked = now.where(F.col("up").isNotNull() & ~F.array_contains("chain", F.col("up")))
        # The last version by then of every asked work: an aggregate per (work, date), not per Expression.
        dates = asked.select("up", "at").distinct()
        last = dates.join(versions, "up").where(F.col("v.effective").isNull() | (F.col("v.effective") <= F.col("at"))).groupBy("up", "at").agg(F.max_by("v", F.coalesce(F.col("v.effective"), F.lit("0001-01-01").cast("date"))).alias("v"))
        last = last.where(F.col("v.retired").isNull() | (F.col("v.retired") > F.col("at")))
        more = staged(
            asked.join(last, ["up", "at"]).select(
                "expr", "at", F.concat(F.array("up"), "chain").alias("chain"), F.concat(F.array(F.col("v.title")), "titles").alias("titles"), F.col("v.next").alias("up")
            ),
            "context",
        )
        done.append(now.join(more.select("expr"), "expr", "left_anti"))
        if more.isEmpty():
            break
        now = more
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("expr", (F.size("chain") - 1).alias("depth"), "chain", F.array_join("titles", " > ").alias("breadcrumb"))


def expanded_refs(hits: DataFrame, edges: DataFrame, in_force: DataFrame, types: list[str]) -> DataFrame:
    """(from_expr, to_id, anchor, expr, title): what each hit (expr) refers to, each target once by its first anchor, as the
    Expression in force; targets without one fall away."""
    first = edges.where(F.col("type").isin(types)).join(hits.select(F.col("expr").alias("from_expr")).distinct(), "from_expr", "left_semi").groupBy("from_expr", "to_id").agg(F.min("anchor").alias("anchor"))
    return first.join(in_force.select(F.col("id").alias("to_id"), names.expression_id(F.col("id"), F.col("effective")).alias("expr"), "title"), "to_id").select("from_expr", "to_id", "anchor", "expr", "title")


def subtree(tree: DataFrame, closure: DataFrame) -> DataFrame:
    """(scope, id, depth, children): every container with all that lies below it, and how many children each has."""
    kids = tree.where("parent IS NOT NULL AND depth > 0").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    return closure.join(kids, "id", "left").select(F.col("ancestor").alias("scope"), "id", F.col("distance").alias("depth"), F.coalesce("children", F.lit(0)).cast("bigint").alias("children"))


def top_paragraphs(anchors: DataFrame, defined: DataFrame) -> DataFrame:
    """Anchors (id, anchor) of the first level that are no defined term's slug (id, slug): the complete map of a section."""
    top = anchors.where(~F.contains("anchor", F.lit("-")))
    return top.join(defined.select("id", F.col("slug").alias("anchor")).distinct(), ["id", "anchor"], "left_anti").select("id", "anchor").distinct()


def paragraphs_below(anchors: DataFrame, id: str, anchor: str) -> DataFrame:
    """Anchors of a section below one of its paragraphs."""
    return anchors.where((F.col("id") == id) & F.startswith("anchor", F.lit(f"{anchor}-"))).select("id", "anchor")


def home_sources(works: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, home): a work's own source if that is a base source; else the base source whose id prefix most of its link targets
    have; of equals, or without links, the first in the order of the registry.

    works: id, source_name; links: id, to_id. The registry is small by nature; links are counted per prefix first.
    """
    order = Window.orderBy(F.desc_nulls_last("precedence"), "source_name")
    base = sources.where("kind = 'base'").select("source_name", "id_prefix", F.row_number().over(order).alias("place"))
    per_prefix = links.where("to_id IS NOT NULL").groupBy("id", F.substring_index("to_id", ":", 1).alias("id_prefix")).agg(F.count("*").alias("n"))
    linked = per_prefix.join(F.broadcast(base), "id_prefix").groupBy("id").agg(F.min_by("source_name", F.struct(-F.col("n"), F.col("place"))).alias("linked"))
    first = base.where("place = 1").select(F.col("source_name").alias("first"))
    own = base.select("source_name", F.lit(True).alias("is_base"))
    rows = works.join(F.broadcast(own), "source_name", "left").join(linked, "id", "left").join(F.broadcast(first), how="left")
    return rows.select("id", F.when(F.col("is_base"), F.col("source_name")).otherwise(F.coalesce("linked", "first")).alias("home"))


# ---- terms


def declared_scopes(definers: DataFrame, levels: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, scope): where the definitions of a work hold: the level its text names ("as used in this part"), which is the work
    itself or its nearest ancestor of that level; else its parent; else itself.

    definers: id, parent, level_name, body; levels: id, level_name of every work; closure: ancestor, id, distance.
    """
    said = F.lower(F.regexp_extract("body", r"(?i)\b(?:as used in|(?:for|within) (?:the )?purposes? of|in)\s+this\s+(\p{L}+)", 1))
    d = definers.select("id", names.plain_work("parent").alias("parent"), F.lower("level_name").alias("own"), F.coalesce(said, F.lit("")).alias("level"))
    above = d.where("level <> '' AND (own IS NULL OR own <> level)").select("id", "level").join(closure, "id").join(levels.select(F.col("id").alias("ancestor"), F.lower("level_name").alias("level")).distinct(), ["ancestor", "level"])
    near = above.groupBy("id").agg(F.min_by("ancestor", F.struct("distance", "ancestor")).alias("ancestor"))
    self_named = (F.col("level") != "") & (F.col("own") == F.col("level"))
    return d.join(near, "id", "left").select("id", F.when(self_named, F.col("id")).otherwise(F.coalesce("ancestor", "parent", "id")).alias("scope"))


def near_terms(asked: DataFrame, terms: DataFrame, most: int = 8) -> DataFrame:
    """(asked, term, rank): for each asked phrase the terms that share a word with it, at most ``most`` in the order of their
    letters (the cap is the feature). Phrases and terms meet on words; the phrase itself is no near term."""
    words = lambda df, x, out: df.select(F.col(x).alias(out)).distinct().select(out, F.explode(F.array_distinct(T.tokens(out))).alias("word"))
    hits = words(asked, "term", "asked").join(words(terms, "term", "term"), "word").where(F.lower("asked") != F.lower("term")).select("asked", "term").distinct()
    w = Window.partitionBy("asked").orderBy("term")
    return hits.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= most)


# The turns of phrase that ask for a definition, before the term and after it.
_BEFORE = ("define", "definition of", "meaning of", "what is", "what are", "what does", "who is", "what counts as", "term")
_AFTER = ("definition", "meaning", "means", "defined", "vs", "versus")


def asks_definition(query: str, term: str) -> bool:
    """The query asks what the term means: a turn of phrase stands right next to it ("what is a hole", "toeboard definition").
    A long question that only mentions a term does not."""
    q, t = (" ".join(re.findall(r"\w+", x.lower())) for x in (query, term))
    if not t:
        return False
    forms = (t, t + "s")
    for cue in _BEFORE:
        at = f" {q} ".find(f" {cue} ")
        if at >= 0:
            rest = q[at + len(cue) :].strip()
            for article in ("a ", "an ", "the "):
                rest = rest.removeprefix(article)
            if any(rest == f or rest.startswith(f + " ") for f in forms):
                return True
    return any(q.startswith(f"{f} {cue}") and (len(q) == len(f) + 1 + len(cue) or q[len(f) + 1 + len(cue)] == " ") for f in forms for cue in _AFTER)


# ---- passages


def passage_members(passages: DataFrame, expressions: DataFrame, day: str) -> DataFrame:
    """(passage, member, place, in_force): the Expressions a passage is made of, in order and each once, and whether each is the
    text of its work on ``day``.

    passages: passage, members (array of Expressions); expressions as of ``integrity.deliveries`` with retired.
    """
    from lexweave.operators import temporal

    rows = passages.select("passage", F.posexplode(F.array_distinct("members")).alias("place", "member"))
    now = temporal.as_of(expressions, day).select(names.expression_id(F.col("id"), F.col("effective")).alias("member"), F.lit(True).alias("there"))
    return rows.join(now, "member", "left").select("passage", "member", (F.col("place") + 1).cast("int").alias("place"), F.coalesce("there", F.lit(False)).alias("in_force"))


def supporting(shown: list[dict], paths: list[tuple[str, str, str]], budget: int) -> list[dict]:
    """Context for a page of displayed hits: texts (seed, expr, body) that a shown seed leads to and that are not shown, each once;
    one that does not fit the word budget is skipped and later ones may still fit."""
    displayed, seen, out = {h["expr"] for h in shown}, set(), []
    for seed, expr, body in paths:
        n = len(body.split())
        if seed in displayed and expr not in displayed and expr not in seen and n <= budget:
            seen.add(expr)
            budget -= n
            out.append({"seed": seed, "expr": expr, "words": n, "body": body})
    return out


def trimmed(hits: DataFrame, keep: list[str], text: str, most: int) -> DataFrame:
    """Hits for a reader with little room: only the kept columns, and of the text its first ``most`` words."""
    words = F.filter(F.split(F.trim(c(text)), r"\s+"), lambda w: w != "")
    return hits.select(*keep, F.array_join(F.slice(words, 1, most), " ").alias(text), (F.size(words) > most).alias("cut"))
