"""The query verbs over a corpus: search, grep, read, refs, define, map, status.

An ``Engine`` holds the corpus tables as DataFrames. Every verb takes its date explicitly (default: the latest date in the
data, never today) and returns DataFrames; only what is displayed is collected by the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import anchors, names
from lexweave.functions import text as T
from lexweave.operators import definitions, graph, grep, hierarchy, integrity, navigation, passages, ranking, temporal, validate
from lexweave.session import table
from lexweave.sources.index import SearchIndex


class NotFound(LookupError):
    """Nothing has that id (at that date)."""


class Engine:
    def __init__(self, spark: SparkSession, sections: DataFrame, actions: DataFrame, sources: DataFrame, embed: Callable[[str], list[float]] | None = None, vectors: DataFrame | None = None):
        self.spark, self.sections, self.actions, self.sources = spark, sections, actions, sources
        self.embed, self.vectors, self.index = embed, vectors, None
        fields = ["retired", "title", "level_name", "kind", "parent", "ord", "source_name", "superseded_by", "supersedes", "amended_by", "overrides", "narrows", "defines", "legal_status", "body"]
        self.expressions = integrity.deliveries(sections, *fields).withColumn("expr", names.expression_id(F.col("id"), F.col("effective")))

    @classmethod
    def of(cls, spark: SparkSession, folder: str, **more) -> Engine:
        return cls(spark, table(spark, folder, "sections"), table(spark, folder, "actions"), table(spark, folder, "sources"), **more)

    def views(self, prefix: str = "") -> None:
        """Every table as a view for plain SQL."""
        for name in ("sections", "actions", "sources", "expressions"):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def last_day(self) -> str:
        return str(self.expressions.agg(F.max("effective")).first()[0])

    def _at(self, as_of: str | None, superseded: bool = False) -> DataFrame:
        return temporal.active(self.expressions, as_of or self.last_day(), superseded)

    def _closure(self) -> DataFrame:
        return hierarchy.descendants(hierarchy.hierarchy(hierarchy.section_links(self.sections)))

    def selection(self, as_of: str | None = None, scope: str | None = None, source: str | None = None, kind: str | None = None, superseded: bool = False) -> DataFrame:
        """Expressions that pass all filters; each is applied only if it is given."""
        rows = self._at(as_of, superseded)
        if source:
            rows = rows.where(F.col("source_name") == source)
        if kind:
            rows = rows.where(F.col("kind") == kind)
        return graph.within(rows, "id", self._closure(), scope) if scope else rows

    def search(self, query: str, limit: int = 10, mode: str = "fts", as_of: str | None = None, scope: str | None = None, source: str | None = None, kind: str | None = None, superseded: bool = False) -> DataFrame:
        """Ranked Expressions: rank, id, expr, title, score, snippet. Filters come before both legs; a title, path or id in the
        query raises a hit, superseded texts and notes sink; the best Expression of a work stands for it."""
        rows = self.selection(as_of, scope, source, kind, superseded)
        rows = rows.where(~navigation.is_navigation("body"))  # what only leads to texts is no text
        docs = rows.withColumn("path", F.array_join(T.id_parts("id"), " "))
        boosts = {"title": 3.0, "path": 2.0, "body": 1.0}
        if self.index is not None:
            scored = self.index.bm25(query, boosts).join(rows.select("expr"), "expr", "left_semi")
        else:
            scored = ranking.bm25(docs, query, "expr", boosts)
        lex = ranking.top(scored, "expr", 100, ties=True)
        empty = lex.limit(0)
        vec = empty
        if mode in ("vector", "fuse") and self.embed is not None and self.vectors is not None:
            q = self.spark.createDataFrame([(self.embed(query),)], "embedding array<double>")
            near = ranking.cosine_to(self.vectors.join(rows.select("expr"), "expr", "left_semi"), q, "expr", "embedding")
            vec = ranking.top(near, "expr", 100, "cosine")
        fused = ranking.rrf(empty if mode == "vector" else lex, vec, "expr")
        hits = fused.join(rows.select("expr", "id", "title", "body", "kind", "superseded_by"), "expr")
        hits = ranking.with_chunks(hits, [], "id")
        score = ranking.adjusted(F.col("score"), ranking.title_fraction(query, "title", "id"), F.lit(0), F.col("chunks"), F.coalesce(F.col("kind") == "note", F.lit(False)), F.col("superseded_by").isNotNull() & F.lit(superseded))
        best = ranking.collapse(hits.withColumn("score", score), "expr" if superseded else "id", "expr" if not superseded else "id")
        top = best.orderBy(F.desc("score"), "id").limit(max(1, min(limit, 50)))
        snippets = ranking.best_lines(top, query, "id", "body").select("id", "snippet").dropDuplicates(["id"])
        return top.join(snippets, "id", "left").select("id", *(["expr"] if "expr" in top.columns else []), "title", F.round("score", 4).alias("score"), "snippet").orderBy(F.desc("score"), "id")

    def build_index(self, root: str) -> SearchIndex:
        """Make or refresh the stored index of all Expressions below ``root``; searches use it from then on (with the statistics of
        the whole corpus), and unchanged texts are not read again by the next call."""
        self.index = SearchIndex(self.spark, root, "expr", ["title", "path", "body"], "body")
        self.index.update(self.expressions.withColumn("path", F.array_join(T.id_parts("id"), " ")).select("expr", "title", "path", "body"))
        return self.index

    def validate(self) -> DataFrame:
        """(check, severity, n): the corpus contract, without building anything."""
        return validate.summary(validate.issues(self.sections, self.sources, self.actions))

    def expand(self, hits: DataFrame, how: str = "refs", as_of: str | None = None) -> DataFrame:
        """What hits (id, expr) lead to: ``refs``, their references as the texts in force, or ``ancestors``, root first."""
        day = as_of or self.last_day()
        if how == "ancestors":
            chains = navigation.inherited_context(self.expressions.join(hits.select("id").distinct(), "id", "left_semi").unionByName(self._above(hits)).distinct(), day)
            return chains.join(hits.select("expr").distinct(), "expr", "left_semi").select("expr", F.posexplode(F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0)))).alias("place", "id"))
        return navigation.expanded_refs(hits, graph.edges(self.expressions), temporal.as_of(self.expressions, day), ["overrides", "narrows"])

    def _above(self, hits: DataFrame) -> DataFrame:
        up = self._closure().join(hits.select("id").distinct(), "id", "left_semi").select(F.col("ancestor").alias("id")).distinct()
        return self.expressions.join(up, "id", "left_semi")

    def context(self, hits: DataFrame, budget: int = 1500, as_of: str | None = None) -> list[dict]:
        """Supporting context of a displayed page of hits (id, expr): the texts they refer to, each once, within a word budget."""
        shown = hits.select("id", "expr").limit(50)
        led = self.expand(shown, "refs", as_of).join(self.expressions.select("expr", "body"), "expr").orderBy("from_expr", "to_id").limit(200)
        return navigation.supporting([r.asDict() for r in shown.collect()], [(r["from_expr"], r["expr"], r["body"] or "") for r in led.collect()], budget)

    def grep(self, patterns: list[str], fixed: bool = False, word: bool = False, ignore_case: bool = False, scope: str | None = None, before: int = 0, after: int = 0, count_only: bool = False, globs: list[str] | None = None, max_hits: int | None = None, annotate: bool = False) -> DataFrame:
        """Matching lines by path and line (all deliveries), with context if asked, or counts per file; above ``max_hits`` lines the
        counts alone. ``annotate`` adds the paragraph each line belongs to."""
        files = self.sections.select("rel_path", "body", names.plain_work("id").alias("id"))
        if globs:
            files = files.where(grep.selected_paths("rel_path", globs))
        if scope:
            files = graph.within(files, "id", self._closure(), scope)
        files = files.select("rel_path", "body").distinct()
        pattern = grep.pattern_of(patterns, fixed, word, ignore_case)
        if count_only:
            return grep.counts(grep.matches(files, "rel_path", "body", pattern)).orderBy("path")
        if before or after:
            return grep.with_context(files, "rel_path", "body", pattern, before, after).orderBy("path", "line_no")
        hits = grep.matches(files, "rel_path", "body", pattern)
        if max_hits is not None:
            lines, per_file, cut = grep.bounded(hits, max_hits)
            if cut:
                return per_file.orderBy("path")
            hits = lines
        if annotate:
            there = files.join(hits.select(F.col("path").alias("rel_path")).distinct(), "rel_path", "left_semi")
            marks = passages.anchors_of(there, "rel_path", "body").select(F.col("key").alias("path"), F.col("line").alias("line_no"), "anchor")
            return grep.line_anchor(hits, marks).orderBy("path", "line_no")
        return hits.orderBy("path", "line_no")

    def read(self, what: str, as_of: str | None = None, most: int = 100) -> dict:
        """One work, Expression (``work@date``) or paragraph (``work#anchor``): text, ancestors and children, history, tables, and
        what overrides or narrows it: the first ``most`` works each, and how many there are."""
        work, _, anchor = what.partition("#")
        work, _, version = work.partition("@")
        day = as_of or self.last_day()
        rows = self.expressions.where(F.col("id") == work)
        row = (rows.where(F.col("effective") == F.lit(version).cast("date")) if version else temporal.as_of(rows, day)).first()
        if row is None:
            raise NotFound(what)
        body = anchors.anchor_slice(row["body"] or "", names_of(anchor)) if anchor else row["body"]
        if anchor and not body:
            raise NotFound(what)
        now = self._at(as_of)
        edges = graph.edges(now).where((F.col("to_id") == work) & F.col("type").isin("overrides", "narrows")).select("type", "from_id").distinct()
        counts = {r["type"]: r["n"] for r in edges.groupBy("type").agg(F.count("*").alias("n")).collect()}
        marks = {k: [r["from_id"] for r in edges.where(F.col("type") == k).orderBy("from_id").limit(most).collect()] if counts.get(k) else [] for k in ("overrides", "narrows")}
        kids = now.where(names.plain_work("parent") == work).select("id", "title", "ord")
        children = [(r["id"], r["title"]) for r in kids.orderBy(F.coalesce("ord", F.lit(0)), "id").limit(most).collect()]
        history = [r["expr"] for r in rows.orderBy(F.col("effective").asc_nulls_first()).limit(most).select("expr").collect()]
        return {
            "id": work, "expr": row["expr"], "title": row["title"], "text": body, "parent": row["parent"], "children": children, "children_in_all": kids.count() if len(children) == most else len(children),
            "history": history, "tables": anchors.gfm_tables(body or ""), "overridden_by": marks["overrides"], "narrowed_by": marks["narrows"], "refs_in": counts,
        }

    def read_passage(self, passages_: DataFrame, address: str, as_of: str | None = None) -> list[dict]:
        """The Expressions a passage (passage, members) is made of, in order, each as ``read`` gives it. With a date all of them have
        to be in force on it."""
        rows = passages_.where(F.col("passage") == address)
        members = navigation.passage_members(rows, self.expressions.select("id", "effective", "retired"), as_of or self.last_day()).orderBy("place").collect()
        if not members:
            raise NotFound(address)
        if as_of and not all(m["in_force"] for m in members):
            raise NotFound(f"{address} as of {as_of}")
        return [self.read(m["member"]) for m in members]

    def refs(self, what: str, direction: str = "both", depth: int = 1, types: list[str] | None = None, as_of: str | None = None) -> DataFrame:
        """(id, depth) of works within ``depth`` steps along the references in force at the date."""
        edges = graph.edges(self._at(as_of)).where(F.col("type").isin(types or ["overrides", "narrows", "supersedes", "amends"]))
        start = self.spark.createDataFrame([(what,)], "id string")
        return graph.bfs(edges, start, depth, direction).where("depth > 0").orderBy("depth", "id")

    def define(self, term: str, scope: str | None = None, as_of: str | None = None) -> DataFrame:
        """(id, slug, term): where a term is defined; with a scope, the nearest definition only."""
        found = definitions.found(self._at(as_of), ["id"], "body").where(F.col("slug") == T.slug(F.lit(term)))
        if scope is None:
            return found.select("id", "slug", "term").orderBy("id")
        asked = self.spark.createDataFrame([(scope,)], "id string").withColumn("slug", T.slug(F.lit(term)))
        near = definitions.resolve(asked, found.select("id", "slug"), self._closure())
        return found.join(near.select(F.col("owner").alias("id"), "slug", "distance", "ambiguous"), ["id", "slug"])

    def near_terms(self, term: str, as_of: str | None = None) -> list[str]:
        """Up to eight defined terms that share a word with one that is not defined."""
        found = definitions.found(self._at(as_of), ["id"], "body").select("term").distinct()
        asked = self.spark.createDataFrame([(term,)], "term string")
        return [r["term"] for r in navigation.near_terms(asked, found).orderBy("rank").collect()]

    def map_complete(self, scope: str) -> DataFrame:
        """(id, depth, children, anchor): everything below a container; of a section its first-level paragraphs, without defined
        terms; of a paragraph (``work#anchor``) those below it."""
        work, _, anchor = scope.partition("#")
        tree = hierarchy.hierarchy(hierarchy.section_links(self.sections))
        below = navigation.subtree(tree, hierarchy.descendants(tree)).where(F.col("scope") == work)
        if not anchor and not below.isEmpty():
            return below.select("id", "depth", "children", F.lit(None).cast("string").alias("anchor"))
        now = self._at(None).where(F.col("id") == work)
        marks = passages.anchors_of(now.select("id", "body"), "id", "body").select(F.col("key").alias("id"), "anchor")
        found = navigation.paragraphs_below(marks, work, names_of(anchor)) if anchor else navigation.top_paragraphs(marks, definitions.found(now, ["id"], "body"))
        return found.select("id", F.lit(1).alias("depth"), F.lit(0).cast("bigint").alias("children"), "anchor")

    def map(self, scope: str | None = None, depth: int = 3, budget: int = 1500) -> DataFrame:
        """Listing of the tree in reading order, as far as ``depth`` and the word budget reach."""
        labels = self._at(None).select("id", F.col("title").alias("label"), "ord")
        listing = graph.walk(hierarchy.hierarchy(hierarchy.section_links(self.sections)), labels)
        if scope:
            base = listing.where(F.col("id") == scope).select(F.col("sort_path").alias("from_"), F.col("depth").alias("base")).first()
            if base is None:
                raise NotFound(scope)
            listing = listing.where(F.startswith("sort_path", F.lit(base["from_"]))).withColumn("depth", F.col("depth") - base["base"])
        rows = listing.where(F.col("depth") < depth).withColumn("cost", T.words("breadcrumb") + 2)
        return ranking.within_budget(rows, [F.col("sort_path")], "cost", budget).select("id", "depth", "breadcrumb").orderBy("sort_path")

    def status(self) -> DataFrame:
        """Works, Expressions and superseded ones per source."""
        e = self.expressions
        return e.groupBy("source_name").agg(F.countDistinct("id").alias("works"), F.count("*").alias("expressions"), F.count("superseded_by").alias("superseded")).orderBy("source_name")


def names_of(anchor: str) -> str:
    import re

    return re.sub(r"[()]+", "-", re.sub(r"\s", "", anchor)).strip("-")
