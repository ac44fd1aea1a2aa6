"""Queries on the inner structure of texts: anchors, passages, citations, page layout, amendments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import names, stem
from lexweave.functions import text as T
from lexweave.operators import amend, citations, fuzzy, integrity, layout, passages
from lexweave.plans.corpus_sql import _DELIVERED
from lexweave.session import table


def _bodies(spark, d):
    e = integrity.deliveries(table(spark, d, "sections"), "body", "source_name", "node")
    return e.withColumn("expr", names.expression_id(F.col("id"), F.col("effective")))


def anchor_list(spark: SparkSession, d: str) -> DataFrame:
    return passages.anchors_of(_bodies(spark, d), "expr", "body")


def top_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs at the start of a line with one label, counted per label."""
    lines = _bodies(spark, d).where("body IS NOT NULL").select(F.explode(T.lines("body")).alias("line"))
    label = F.regexp_extract("line", r"^\(([A-Za-z0-9]{1,5})\) ", 1)
    return lines.where(label != "").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def passage_spans(spark: SparkSession, d: str) -> DataFrame:
    return passages.passages(table(spark, d, "documents"), "doc_id", "text", 128, 200).select("key", "part", "nparts", "start_at", "end_at", "words", "fallback")


def peer_merge(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("expr", "part", T.words("body").alias("words")).groupBy("expr", "part").agg(F.max("words").alias("words"))
    return passages.merged_peers(units, "expr", "part", "words", 512, 800)


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    return passages.tables_of(table(spark, d, "documents"), "doc_id", "text")


def stripped_bodies(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).where("body IS NOT NULL").select("expr", F.length(T.stripped("body")).alias("n"), T.words("body").alias("words"))


def citation_list(spark: SparkSession, d: str) -> DataFrame:
    return citations.found(_bodies(spark, d).withColumn("home", F.regexp_extract("id", r":(\d+)-", 1)), "expr", "body", "home")


def citation_resolution(spark: SparkSession, d: str) -> DataFrame:
    rows = _bodies(spark, d).withColumn("home", F.regexp_extract("id", r":(\d+)-", 1))
    refs = citations.found(rows, "expr", "body", "home").select("key", "cited", "id").distinct().join(rows.select(F.col("expr").alias("key"), "source_name"), "key")
    works = rows.groupBy("id").agg(F.min("source_name").alias("source_name"))
    return citations.resolved(citations.candidate_ids(refs, works))


def lex_stemmed(spark: SparkSession, d: str) -> DataFrame:
    p = stem.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    p = stem.postings(table(spark, d, "documents"), "doc_id", "text", stemmed=False)
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


def running_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.running(layout.placed(table(spark, d, "elements")))


def heading_ranges(spark: SparkSession, d: str) -> DataFrame:
    h = layout.heading_level(layout.placed(table(spark, d, "elements"))).where("level IS NOT NULL")
    return layout.ranges(h.select("doc_sha", "seq", "level")).select("doc_sha", "seq", "level", F.coalesce("parent_seq", F.lit(-1)).alias("parent_seq"), F.coalesce("end_seq", F.lit(-1)).alias("end_seq"))


def overlay_items(spark: SparkSession, d: str) -> DataFrame:
    return layout.grouped_items(layout.placed(table(spark, d, "elements")), F.col("text").rlike("^§ [0-9]+")).select("doc_sha", "item", "first_seq", "lines")


def instruction_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What the reader of instructions makes of every verb in the feed, and how often it comes."""
    verbs = table(spark, d, "actions").where("kind IS NOT NULL").groupBy(F.trim("kind").alias("verb")).agg(F.count("*").alias("n"))
    return verbs.select("verb", amend.reading("verb")["kind"].alias("kind"), "n")


def amended_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every work's first text with all its actions of highest revision applied in order."""
    first = _bodies(spark, d).groupBy("id").agg(F.min_by("body", F.coalesce("effective", F.lit("0001-01-01").cast("date"))).alias("body"))
    a = table(spark, d, "actions").where("effective IS NOT NULL")
    newest = a.groupBy(names.plain_action("action_id").alias("action_id")).agg(F.max_by(F.struct(names.plain_work("target_id").alias("work"), names.action_kind("kind").alias("kind"), names.plain_anchor("target_anchor").alias("anchor"), "text", "effective"), F.struct("revision", "received_at", "feed_pos")).alias("x"))
    from pyspark.sql import Window

    # One work's actions are numbered by their order; a window per work, spilled by the sort if a work has many.
    seq = F.row_number().over(Window.partitionBy("work").orderBy(names.action_order(F.col("action_id"), F.col("effective"))))
    acts = newest.select("action_id", "x.*").withColumn("seq", seq)
    out = amend.composed(first.select(F.col("id").alias("work"), "body"), acts)
    return out.select("work", F.length("body").alias("length"), "applied", "failed")


def version_spans(spark: SparkSession, d: str) -> DataFrame:
    """How much of each version's text the next one keeps, as a span score."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.col("effective").asc_nulls_first())
    v = _bodies(spark, d).withColumn("next", F.lead("body").over(w)).where("body IS NOT NULL AND next IS NOT NULL")
    return fuzzy.span_matches(v, "expr", "body", "next").select("key", "score")


NAMES = "anchor_list top_anchors passage_spans peer_merge table_rows stripped_bodies citation_list citation_resolution lex_stemmed vocabulary running_lines heading_ranges overlay_items instruction_kinds amended_texts version_spans"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_ME = "CASE WHEN eff IS NULL THEN wid ELSE wid || '@' || strftime(eff, '%Y-%m-%d') END"
_PLACED = "placed AS (SELECT doc_sha, page, seq, max(text) AS text FROM elements WHERE doc_sha IS NOT NULL AND page IS NOT NULL AND seq IS NOT NULL AND trim(text) <> '' GROUP BY 1, 2, 3)"
_STOP = ", ".join(f"'{w}'" for w in stem.STOP)

SQL = {
    "top_anchors": rf"WITH {_DELIVERED}, l AS (SELECT regexp_extract(unnest(regexp_split_to_array(body, '\r\n|\n|\r')), '^\(([A-Za-z0-9]{{1,5}})\) ', 1) AS label FROM delivered WHERE body IS NOT NULL) SELECT label, count(*) AS n FROM l WHERE label <> '' GROUP BY 1",
    "stripped_bodies": rf"WITH {_DELIVERED} SELECT {_ME} AS expr, length(trim(regexp_replace(regexp_replace(regexp_replace(body, '\[([^\]]*)\]\(([^)]*)\)', '\1', 'g'), '(?m)^#+\s*|[*_`>|]', '', 'g'), '\s+', ' ', 'g'))) AS n, len(list_filter(regexp_split_to_array(body, '\s+'), lambda t: t <> '')) AS words FROM delivered WHERE body IS NOT NULL",
    "vocabulary": rf"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS term FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' AND strlen(term) <= 40 AND term NOT IN ({_STOP}) GROUP BY 1, 2) SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM c GROUP BY 1",
    "instruction_kinds": r"""SELECT trim(kind) AS verb, CASE WHEN regexp_matches(lower(trim(kind)), '^(add|adds|added|adding|insert.*)$') THEN 'add' WHEN regexp_matches(lower(trim(kind)), '^(remov|delet)') THEN 'remove'
WHEN regexp_matches(lower(trim(kind)), '^redesignat') THEN 'redesignate' WHEN regexp_matches(lower(trim(kind)), '^(stay|suspend)') THEN 'stay' ELSE 'amend' END AS kind, count(*) AS n FROM actions WHERE kind IS NOT NULL GROUP BY 1, 2""",
    "running_lines": f"WITH {_PLACED}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_sha, page ORDER BY seq) AS t, row_number() OVER (PARTITION BY doc_sha, page ORDER BY seq DESC) AS b FROM placed) SELECT doc_sha, trim(regexp_replace(lower(text), '[0-9]+', '#', 'g')) AS masked, count(DISTINCT page) AS pages FROM n WHERE t <= 2 OR b <= 2 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2",
    "overlay_items": f"WITH {_PLACED}, i AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^§ [0-9]+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_sha ORDER BY seq ROWS UNBOUNDED PRECEDING) AS item FROM placed) SELECT doc_sha, CAST(item AS BIGINT) AS item, min(seq) AS first_seq, count(*) AS lines FROM i GROUP BY 1, 2",
}
