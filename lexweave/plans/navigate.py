"""Queries on navigation, checks and gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.functions import text as T
from lexweave.operators import checks, definitions, graph, hierarchy, integrity, navigation, passages, ranking, temporal
from lexweave.plans.corpus_sql import _DELIVERED, _TREES, work
from lexweave.plans.retrieval import _TOK, _run_hits
from lexweave.plans.structure import _DEF, _DELIVERED2, _EDGES, _ME, DAY
from lexweave.session import table


def _expr(spark, d, *cols):
    return integrity.deliveries(table(spark, d, "sections"), *cols)


def _sections_tree(spark, d, paths=True):
    return hierarchy.hierarchy(hierarchy.section_links(table(spark, d, "sections")), paths)


def searchable_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by whether they are text or only lead to it."""
    c = table(spark, d, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", navigation.is_navigation("body").alias("navigation"))
    return c.groupBy("chunk_id").agg(F.max("navigation").alias("navigation"))


def excluded_regions(spark: SparkSession, d: str) -> DataFrame:
    r = navigation.regions(table(spark, d, "elements"))
    return r.groupBy("doc_sha").agg(F.count_if("searchable").alias("text"), F.count_if(~F.col("searchable")).alias("evidence"))


def inherited_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Titles above every Expression, each as of the date that applies to it."""
    return navigation.inherited_context(_expr(spark, d, "retired", "title", "parent", "superseded_by"), DAY).select("expr", "depth", "breadcrumb")


def expand_refs(spark: SparkSession, d: str) -> DataFrame:
    """What the Expressions in force refer to, as the texts in force."""
    e = _expr(spark, d, "retired", "title", "overrides", "narrows", "amended_by", "defines", "supersedes")
    now = temporal.as_of(e, DAY)
    hits = now.select(names.expression_id(F.col("id"), F.col("effective")).alias("expr"))
    return navigation.expanded_refs(hits, graph.edges(e), now, ["overrides", "narrows"]).select("from_expr", "to_id", "anchor", "expr")


def map_subtree(spark: SparkSession, d: str) -> DataFrame:
    tree = _sections_tree(spark, d)
    return navigation.subtree(tree, hierarchy.descendants(tree))


def map_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """First-level paragraphs of every work's text in force, without defined terms."""
    now = temporal.as_of(_expr(spark, d, "retired", "body"), DAY)
    anchors = passages.anchors_of(now.select("id", "body"), "id", "body").select(F.col("key").alias("id"), "anchor")
    return navigation.top_paragraphs(anchors, definitions.found(now, ["id"], "body").select("id", "slug"))


def home_sources(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select(names.plain_work("id").alias("id"), "source_name").where("id IS NOT NULL")
    works = s.groupBy("id").agg(F.min("source_name").alias("source_name"))
    links = graph.edges(_expr(spark, d, "overrides", "narrows", "amended_by", "defines", "supersedes")).where(F.col("type").isin("overrides", "narrows")).select(F.col("from_id").alias("id"), "to_id")
    return navigation.home_sources(works, links, table(spark, d, "sources"))


def declared_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Where the definitions of every work's latest text hold."""
    e = temporal.current(_expr(spark, d, "superseded_by", "parent", "level_name", "body"))
    definers = e.join(definitions.found(e, ["id"], "body").select("id").distinct(), "id", "left_semi")
    return navigation.declared_scopes(definers, e.select("id", "level_name"), hierarchy.descendants(_sections_tree(spark, d)))


def near_terms(spark: SparkSession, d: str) -> DataFrame:
    """For every name in ``defines`` the defined terms that share a word with it."""
    s = table(spark, d, "sections")
    asked = s.select(F.explode("defines").alias("x")).select(F.lower(F.trim("x")).alias("term")).where("term <> ''").distinct()
    terms = definitions.found(_expr(spark, d, "body"), ["id", "effective"], "body").select(F.lower("term").alias("term")).distinct()
    return navigation.near_terms(asked, terms)


def passage_members(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of one work merged to passages: their Expressions, and which of them are in force."""
    c = table(spark, d, "chunks").where("chunk_id IS NOT NULL AND expr IS NOT NULL").select(names.plain_work("id").alias("passage"), "expr").where("passage IS NOT NULL")
    rows = c.groupBy("passage").agg(F.array_sort(F.collect_set("expr")).alias("members"))
    return navigation.passage_members(rows, _expr(spark, d, "retired"), DAY)


def xref_faults(spark: SparkSession, d: str) -> DataFrame:
    return checks.reference_faults(_expr(spark, d, "body", "overrides", "narrows", "supersedes", "superseded_by", "parent"))


def missing_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that Expressions name and no version of the named work has."""
    e = _expr(spark, d, "body", "overrides", "narrows", "supersedes", "superseded_by", "parent")
    refs = checks.reference_list(e).where("anchor <> ''").select("expr", "to_id", "anchor")
    named = e.join(refs.select(F.col("to_id").alias("id")).distinct(), "id", "left_semi")
    anchors = passages.anchors_of(named.select("id", "body"), "id", "body").select(F.col("key").alias("id"), "anchor").distinct()
    return checks.missing_anchors(refs, anchors, definitions.found(named, ["id"], "body").select("id", "slug"))


def action_integrity(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "actions").where("action_id IS NOT NULL")
    newest = a.groupBy(names.plain_action("action_id").alias("action_id")).agg(F.max_by("text", F.struct("revision", "received_at", "feed_pos")).alias("text"))
    return checks.action_integrity(_expr(spark, d, "body", "amended_by"), newest)


def verdict_summary(spark: SparkSession, d: str) -> DataFrame:
    return checks.verdict_summary(table(spark, d, "labels"), "doc_id", "toxic")


def artifact_faults(spark: SparkSession, d: str) -> DataFrame:
    return checks.artifact_faults(table(spark, d, "elements"))


def identity_faults(spark: SparkSession, d: str) -> DataFrame:
    """Works that are spelled in several ways."""
    n = table(spark, d, "sections").select("id", names.plain_work("id").alias("uid"))
    return checks.identity_faults(n, "id", "uid")


def gate_blockers(spark: SparkSession, d: str) -> DataFrame:
    """Which of the release's gates the evaluation set and the raters do not pass."""
    items = table(spark, d, "eval_items").groupBy(F.concat(F.lit("items_"), "split").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    agreement = verdict_summary(spark, d).select(F.lit("agreement").alias("metric"), F.col("agreement").alias("value")).limit(1)
    gates = [("items_heldout", ">=", 100), ("items_tuning", ">=", 50), ("items_smoke", ">=", 10), ("items_test", "<=", 20), ("agreement", ">=", 0.95)]
    return checks.blockers(items.unionByName(agreement), gates)


def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the evaluation items: relevant documents repeat eight of their words in a row, notes among them support."""
    items, docs = table(spark, d, "eval_items").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text", "kind")
    hits = ranking.shared_words(items, docs.select("doc_id", "text"), "item_id", "doc_id", "text", 10).select(F.col("item_id").alias("task"), F.col("doc_id").alias("expr"), "rank")
    relevant = _run_hits(items, docs.select("doc_id", "text")).select(F.col("item_id").alias("task"), F.col("doc_id").alias("expr"))
    support = relevant.join(docs.where("kind = 'note'").select(F.col("doc_id").alias("expr")), "expr", "left_semi").select("task", "expr")
    share = ranking.best_share(items, docs, "item_id", "text")
    tasks = share.select(F.col("item_id").alias("task"), ranking.abstains(F.col("share"), F.lit(None).cast("double"), F.lit(0)).alias("abstained"))
    return checks.answer_scores(hits, relevant, support, tasks)


def line_diff(spark: SparkSession, d: str) -> DataFrame:
    """Lines that each version adds and removes."""
    s = table(spark, d, "sections").where("id IS NOT NULL").groupBy("id", "effective").agg(F.max_by("body", "loaded_at").alias("body"))
    w = Window.partitionBy("id").orderBy(F.col("effective").asc_nulls_first())
    s = s.select("id", names.day_of(F.col("effective")).alias("effective"), "body", F.lag("body").over(w).alias("before"), F.row_number().over(w).alias("n")).where("n > 1")
    added, removed = checks.line_changes(F.col("before"), F.col("body"))
    return s.select("id", "effective", F.size(added).alias("added"), F.size(removed).alias("removed"))


def ingest_units(spark: SparkSession, d: str) -> DataFrame:
    """Files cut into units at their headings, with an account of their lines."""
    from lexweave.operators import layout

    lines = layout.heading_level(layout.placed(table(spark, d, "elements")))
    return layout.grouped_items(lines, F.col("level").isNotNull()).select("doc_sha", "item", "first_seq", "lines", F.length("text").alias("length"))


NAMES = "searchable_chunks excluded_regions inherited_breadcrumbs expand_refs map_subtree map_paragraphs home_sources declared_scopes near_terms passage_members xref_faults missing_anchors action_integrity verdict_summary artifact_faults identity_faults gate_blockers answer_scores line_diff ingest_units"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_CLOSURE_S = "closure AS (SELECT d.trail[d.i] AS ancestor, id, CAST(depth - i + 1 AS INTEGER) AS distance FROM (SELECT id, depth, trail, unnest(range(1, depth + 1)) AS i FROM down WHERE tree = 'sections') d)"
_LEVELS = _DELIVERED.replace("title, body", "level_name, title, body")
_VERDICTS = "per AS (SELECT doc_id, count(*) AS n, min(toxic) AS lo, max(toxic) AS hi FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY 1), agreed AS (SELECT round(coalesce(avg(CASE WHEN lo = hi THEN 1.0 ELSE 0.0 END), 1.0), 6) AS agreement FROM per WHERE n > 1)"
_REF = f"""named AS (SELECT {_ME} AS expr, eff, place, to_id FROM (
  SELECT wid, eff, 'body' AS place, {work("x")} AS to_id FROM (SELECT wid, eff, unnest(regexp_extract_all(coalesce(body, ''), '\\[[^\\]]*\\]\\(([A-Z]+:[^)#]*)', 1)) AS x FROM delivered)
  UNION ALL SELECT wid, eff, 'overrides', {work("x")} FROM (SELECT wid, eff, unnest(overrides) AS x FROM delivered)
  UNION ALL SELECT wid, eff, 'narrows', {work("x.id")} FROM (SELECT wid, eff, unnest(narrows) AS x FROM delivered)
  UNION ALL SELECT wid, eff, 'supersedes', {work("supersedes")} FROM delivered UNION ALL SELECT wid, eff, 'superseded_by', {work("superseded_by")} FROM delivered UNION ALL SELECT wid, eff, 'parent', {work("parent")} FROM delivered) WHERE to_id IS NOT NULL)"""
_ITEM_RUNS = f"""i AS (SELECT item_id, {_TOK.format(x='text')} AS t FROM eval_items), d AS (SELECT doc_id, kind, {_TOK.format(x='text')} AS t FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, unnest(t) AS w FROM i), dw AS (SELECT DISTINCT doc_id, unnest(t) AS w FROM d),
both_ AS (SELECT item_id, doc_id, count(*) AS hits FROM iw JOIN dw USING (w) GROUP BY 1, 2), r AS (SELECT item_id, doc_id, hits, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM both_),
ir AS (SELECT DISTINCT item_id, array_to_string(t[k:k + 7], ' ') AS run FROM (SELECT item_id, t, unnest(range(1, len(t) - 6)) AS k FROM i)), dr AS (SELECT DISTINCT doc_id, kind, array_to_string(t[k:k + 7], ' ') AS run FROM (SELECT doc_id, kind, t, unnest(range(1, len(t) - 6)) AS k FROM d)),
rel AS (SELECT DISTINCT item_id, doc_id, kind FROM ir JOIN dr USING (run))"""
_PLACED = "placed AS (SELECT doc_sha, page, seq, text, font_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_sha, page, seq ORDER BY text DESC, element_type DESC NULLS LAST, font_size DESC NULLS LAST, bold DESC NULLS LAST) AS rn FROM elements WHERE doc_sha IS NOT NULL AND page IS NOT NULL AND seq IS NOT NULL AND trim(text) <> '') WHERE rn = 1)"
_HEADS = _PLACED + """, usual AS (SELECT doc_sha, font_size AS u FROM (SELECT doc_sha, font_size, row_number() OVER (PARTITION BY doc_sha ORDER BY count(*) DESC, font_size DESC) AS k FROM placed WHERE font_size IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
ranked AS (SELECT doc_sha, font_size, dense_rank() OVER (PARTITION BY doc_sha ORDER BY font_size DESC) AS level FROM (SELECT DISTINCT p.doc_sha, font_size FROM placed p JOIN usual USING (doc_sha) WHERE font_size > u)),
lines AS (SELECT p.*, CAST(CASE WHEN r.level IS NOT NULL THEN r.level WHEN regexp_matches(p.text, '^§+ ?[0-9]+\\.[0-9]+') THEN 1 END AS INTEGER) AS level FROM placed p LEFT JOIN ranked r ON r.doc_sha = p.doc_sha AND r.font_size = p.font_size)"""
_LINES = "list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '\\r\\n|\\n|\\r'), lambda t: trim(t)), lambda t: t <> ''))"

SQL = {
    "searchable_chunks": r"""WITH l AS (SELECT chunk_id, list_filter(regexp_split_to_array(body, '\r\n|\n|\r'), lambda t: regexp_matches(t, '\p{L}')) AS rows_ FROM chunks WHERE chunk_id IS NOT NULL)
SELECT chunk_id, bool_or(coalesce(len(rows_) > 0 AND len(list_filter(rows_, lambda t: regexp_full_match(t, '\s*(?:#+\s.*|[-*+]?\s*\[[^\]]*\]\([^)]*\)[.;,]?|.*\.{3,}\s*[0-9ivxlc]+)\s*'))) = len(rows_), false)) AS navigation FROM l GROUP BY 1""",
    "excluded_regions": "SELECT doc_sha, count(*) FILTER (WHERE NOT coalesce(element_type IN ('header', 'footer', 'page_number'), false)) AS text, count(*) FILTER (WHERE coalesce(element_type IN ('header', 'footer', 'page_number'), false)) AS evidence FROM elements GROUP BY 1",
    "inherited_breadcrumbs": f"""WITH RECURSIVE {_DELIVERED}, base AS (SELECT wid, eff, ret, coalesce(title, '') AS title, {work('parent')} AS up, {_ME} AS me, lead(eff) OVER (PARTITION BY wid ORDER BY eff NULLS FIRST) AS nxt,
  CASE WHEN superseded_by IS NOT NULL OR eff > DATE '{DAY}' THEN coalesce(eff, DATE '{DAY}') ELSE DATE '{DAY}' END AS day FROM delivered),
walk AS (SELECT me AS expr, day, [wid] AS chain, title AS crumb, up FROM base
  UNION ALL SELECT w.expr, w.day, list_prepend(a.wid, w.chain), a.title || ' > ' || w.crumb, a.up FROM walk w JOIN base a ON a.wid = w.up AND (a.eff IS NULL OR a.eff <= w.day) AND (a.nxt IS NULL OR a.nxt > w.day) AND (a.ret IS NULL OR a.ret > w.day) WHERE NOT list_contains(w.chain, w.up))
SELECT expr, CAST(len(chain) - 1 AS INTEGER) AS depth, crumb AS breadcrumb FROM (SELECT *, row_number() OVER (PARTITION BY expr ORDER BY len(chain) DESC) AS rn FROM walk) WHERE rn = 1""",
    "expand_refs": f"""WITH {_DELIVERED2}, {_EDGES}, now AS (SELECT wid, {_ME} AS me FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY eff DESC NULLS LAST) AS n FROM delivered WHERE eff IS NULL OR eff <= DATE '{DAY}') WHERE n = 1 AND (ret IS NULL OR ret > DATE '{DAY}'))
SELECT from_expr, to_id, min(anchor) AS anchor, any_value(n.me) AS expr FROM edge e JOIN now n ON n.wid = e.to_id WHERE type IN ('overrides', 'narrows') AND from_expr IN (SELECT me FROM now) GROUP BY 1, 2""",
    "map_subtree": f"WITH RECURSIVE {_TREES}, {_CLOSURE_S}, kids AS (SELECT l.parent AS id, count(*) AS children FROM links l JOIN down d ON d.tree = l.tree AND d.id = l.id WHERE l.tree = 'sections' AND l.parent IS NOT NULL GROUP BY 1) SELECT c.ancestor AS scope, c.id, c.distance AS depth, coalesce(k.children, 0) AS children FROM closure c LEFT JOIN kids k USING (id)",
    "home_sources": f"""WITH {_DELIVERED2}, {_EDGES}, base AS (SELECT source_name, id_prefix, row_number() OVER (ORDER BY precedence DESC NULLS LAST, source_name) AS place FROM sources WHERE kind = 'base'),
own AS (SELECT {work('id')} AS id, min(source_name) AS source_name FROM sections WHERE {work('id')} IS NOT NULL GROUP BY 1), n AS (SELECT from_id AS id, split_part(to_id, ':', 1) AS id_prefix, count(*) AS n FROM edge WHERE type IN ('overrides', 'narrows') GROUP BY 1, 2),
best AS (SELECT id, source_name FROM (SELECT id, source_name, row_number() OVER (PARTITION BY id ORDER BY n DESC, place) AS rn FROM n JOIN base USING (id_prefix)) WHERE rn = 1)
SELECT o.id, CASE WHEN o.source_name IN (SELECT source_name FROM base) THEN o.source_name ELSE coalesce(b.source_name, (SELECT source_name FROM base WHERE place = 1)) END AS home FROM own o LEFT JOIN best b USING (id)""",
    "declared_scopes": rf"""WITH RECURSIVE {_LEVELS}, {_TREES}, {_CLOSURE_S}, cur AS (SELECT wid AS id, {work('parent')} AS parent, lower(level_name) AS own, body FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY superseded_by IS NULL DESC, eff DESC NULLS LAST) AS n FROM delivered) WHERE n = 1),
def AS (SELECT id, parent, own, lower(regexp_extract(body, '(?i)\b(?:as used in|(?:for|within) (?:the )?purposes? of|in)\s+this\s+(\p{{L}}+)', 1)) AS level FROM cur WHERE len(list_filter(regexp_extract_all(body, '{_DEF}', 1), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') <> '')) > 0),
near AS (SELECT id, ancestor FROM (SELECT d.id, c.ancestor, row_number() OVER (PARTITION BY d.id ORDER BY c.distance, c.ancestor) AS rn FROM def d JOIN closure c ON c.id = d.id JOIN cur a ON a.id = c.ancestor AND a.own = d.level WHERE d.level <> '' AND d.own IS DISTINCT FROM d.level) WHERE rn = 1)
SELECT d.id, CASE WHEN d.level <> '' AND d.own = d.level THEN d.id ELSE coalesce(n.ancestor, d.parent, d.id) END AS scope FROM def d LEFT JOIN near n ON n.id = d.id""",
    "near_terms": f"""WITH {_DELIVERED2}, asked AS (SELECT DISTINCT lower(trim(x)) AS asked FROM (SELECT unnest(defines) AS x FROM sections) WHERE trim(x) <> ''),
terms AS (SELECT DISTINCT lower(term) AS term FROM (SELECT wid, eff, regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, min(x) AS term FROM (SELECT wid, eff, unnest(regexp_extract_all(body, '{_DEF}', 1)) AS x FROM delivered WHERE body IS NOT NULL) GROUP BY 1, 2, 3) WHERE slug <> ''),
aw AS (SELECT DISTINCT asked, unnest({_TOK.format(x='asked')}) AS w FROM asked), tw AS (SELECT DISTINCT term, unnest({_TOK.format(x='term')}) AS w FROM terms), hits AS (SELECT DISTINCT asked, term FROM aw JOIN tw USING (w) WHERE asked <> term)
SELECT asked, term, CAST(rank AS INTEGER) AS rank FROM (SELECT asked, term, row_number() OVER (PARTITION BY asked ORDER BY term) AS rank FROM hits) WHERE rank <= 8""",
    "passage_members": f"""WITH {_DELIVERED}, now AS (SELECT {_ME} AS me FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY eff DESC NULLS LAST) AS n FROM delivered WHERE eff IS NULL OR eff <= DATE '{DAY}') WHERE n = 1 AND (ret IS NULL OR ret > DATE '{DAY}')),
m AS (SELECT DISTINCT {work('id')} AS passage, expr AS member FROM chunks WHERE chunk_id IS NOT NULL AND expr IS NOT NULL AND {work('id')} IS NOT NULL)
SELECT passage, member, CAST(row_number() OVER (PARTITION BY passage ORDER BY member) AS INTEGER) AS place, member IN (SELECT me FROM now) AS in_force FROM m""",
    "xref_faults": f"""WITH {_DELIVERED2}, {_REF}, life AS (SELECT wid, eff AS since, TRY_CAST(nullif(regexp_extract(superseded_by, '@([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS DATE) AS until_ FROM delivered WHERE eff IS NOT NULL)
SELECT DISTINCT expr, place, to_id, 'unknown' AS fault FROM named WHERE to_id NOT IN (SELECT wid FROM delivered)
UNION ALL SELECT DISTINCT expr, place, to_id, 'inactive' FROM named n WHERE eff IS NOT NULL AND to_id IN (SELECT wid FROM delivered) AND NOT EXISTS (SELECT 1 FROM life l WHERE l.wid = n.to_id AND l.since <= n.eff AND (l.until_ IS NULL OR l.until_ > n.eff))""",
    "verdict_summary": f"WITH {_VERDICTS} SELECT CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE 'disputed' END AS verdict, count(*) AS items, any_value(agreement) AS agreement FROM per, agreed GROUP BY 1",
    "artifact_faults": """WITH at_ AS (SELECT * FROM elements WHERE doc_sha IS NOT NULL AND page IS NOT NULL AND seq IS NOT NULL),
f AS (SELECT doc_sha, 'confidence_out_of_range' AS fault FROM elements WHERE confidence < 0 OR confidence > 1 UNION ALL SELECT doc_sha, 'box_incomplete' FROM elements WHERE bbox IS NOT NULL AND len(bbox) <> 4
 UNION ALL SELECT doc_sha, 'box_without_area' FROM elements WHERE len(bbox) = 4 AND (bbox[1] >= bbox[3] OR bbox[2] >= bbox[4]) UNION ALL SELECT doc_sha, 'box_missing' FROM elements WHERE bbox IS NULL UNION ALL SELECT doc_sha, 'no_place' FROM elements WHERE page IS NULL OR seq IS NULL)
SELECT doc_sha, fault, count(*) AS n FROM f WHERE doc_sha IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT doc_sha, 'place_taken_twice', count(*) FROM (SELECT doc_sha, seq FROM at_ GROUP BY 1, 2 HAVING count(DISTINCT coalesce(text, '')) > 1) GROUP BY 1
UNION ALL SELECT doc_sha, 'pages_out_of_order', count(*) FROM (SELECT doc_sha, lo, lag(hi) OVER (PARTITION BY doc_sha ORDER BY page) AS before FROM (SELECT doc_sha, page, min(seq) AS lo, max(seq) AS hi FROM at_ GROUP BY 1, 2)) WHERE lo < before GROUP BY 1""",
    "identity_faults": f"SELECT 'identity_shared' AS fault, uid AS id, count(DISTINCT raw) AS n FROM (SELECT id AS raw, {work('id')} AS uid FROM sections) WHERE uid IS NOT NULL GROUP BY 2 HAVING count(DISTINCT raw) > 1",
    "gate_blockers": f"""WITH {_VERDICTS}, m AS (SELECT 'items_' || split AS metric, CAST(count(*) AS DOUBLE) AS value FROM eval_items GROUP BY 1 UNION ALL SELECT 'agreement', agreement FROM agreed),
g(metric, op, bound, gate) AS (VALUES ('items_heldout', 1, 100.0, '>= 100'), ('items_tuning', 1, 50.0, '>= 50'), ('items_smoke', 1, 10.0, '>= 10'), ('items_test', -1, 20.0, '<= 20'), ('agreement', 1, 0.95, '>= 0.95'))
SELECT g.metric, m.value, g.gate FROM g LEFT JOIN m USING (metric) WHERE m.value IS NULL OR (op = 1 AND value < bound) OR (op = -1 AND value > bound)""",
    "answer_scores": f"""WITH {_ITEM_RUNS}, n AS (SELECT item_id, count(*) AS want, count(*) FILTER (WHERE kind = 'note') AS back FROM rel GROUP BY 1), g AS (SELECT item_id, count(*) FILTER (WHERE rank <= 5) AS got, count(*) FILTER (WHERE kind = 'note') AS held FROM r JOIN rel USING (item_id, doc_id) WHERE rank <= 10 GROUP BY 1),
a AS (SELECT i.item_id, coalesce(max(hits) / nullif(any_value(len(list_distinct(t))), 0), 0) < 0.34 AS abstained FROM i LEFT JOIN both_ USING (item_id) GROUP BY 1)
SELECT a.item_id AS task, round(coalesce(got, 0) / want, 6) AS recall, CASE WHEN want IS NOT NULL THEN round(coalesce(got, 0) / 5.0, 6) END AS precision, round(coalesce(held, 0) / nullif(back, 0), 6) AS support_recall, CASE WHEN want IS NULL THEN CAST(CAST(abstained AS INTEGER) AS DOUBLE) END AS no_answer_correct FROM a LEFT JOIN n USING (item_id) LEFT JOIN g USING (item_id)""",
    "line_diff": f"""WITH v AS (SELECT id, effective, arg_max_null(body, loaded_at) AS body FROM sections WHERE id IS NOT NULL GROUP BY 1, 2), p AS (SELECT id, effective, {_LINES.format(x='body')} AS now, lag({_LINES.format(x='body')}) OVER w AS prev, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY id ORDER BY effective NULLS FIRST))
SELECT id, coalesce(strftime(effective, '%Y-%m-%d'), '') AS effective, CAST(len(list_filter(now, lambda x: NOT list_contains(prev, x))) AS INTEGER) AS added, CAST(len(list_filter(prev, lambda x: NOT list_contains(now, x))) AS INTEGER) AS removed FROM p WHERE n > 1""",
    "ingest_units": f"WITH {_HEADS}, i AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_sha ORDER BY seq ROWS UNBOUNDED PRECEDING) AS item FROM lines) SELECT doc_sha, CAST(item AS BIGINT) AS item, min(seq) AS first_seq, count(*) AS lines, CAST(sum(length(text)) + count(*) - 1 AS INTEGER) AS length FROM i GROUP BY 1, 2",
    "heading_ranges": f"""WITH {_HEADS}, h AS (SELECT doc_sha, seq, level FROM lines WHERE level IS NOT NULL) SELECT h.doc_sha, h.seq, h.level, coalesce((SELECT max(b.seq) FROM h b WHERE b.doc_sha = h.doc_sha AND b.seq < h.seq AND b.level < h.level), -1) AS parent_seq,
 coalesce((SELECT min(a.seq) FROM h a WHERE a.doc_sha = h.doc_sha AND a.seq > h.seq AND a.level <= h.level), -1) AS end_seq FROM h""",
}
