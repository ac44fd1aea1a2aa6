"""Queries on versions, trees, references and definitions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.operators import definitions, graph, hierarchy, integrity, temporal
from lexweave.plans.corpus_sql import _DELIVERED, _TREES, action, work
from lexweave.session import table

DAY = "2020-06-01"


def _expr(spark, d, *cols):
    return integrity.deliveries(table(spark, d, "sections"), *cols)


def _day(df, *cols):
    for x in cols:
        df = df.withColumn(x, names.day_of(F.col(x)))
    return df


def as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _day(temporal.as_of(_expr(spark, d, "retired", "title"), DAY).select("id", "effective", "title"), "effective")


def active_at(spark: SparkSession, d: str) -> DataFrame:
    return _day(temporal.active(_expr(spark, d, "retired"), DAY, True).select("id", "effective"), "effective")


def build_current(spark: SparkSession, d: str) -> DataFrame:
    return _day(temporal.current(_expr(spark, d, "superseded_by")).select("id", "effective"), "effective")


def version_chain(spark: SparkSession, d: str) -> DataFrame:
    return _day(temporal.chain(_expr(spark, d, "retired")).select("id", "effective", "version", F.coalesce("previous", F.lit("")).alias("previous")), "effective")


def supersession_faults(spark: SparkSession, d: str) -> DataFrame:
    return _day(temporal.chain_faults(_expr(spark, d, "supersedes", "superseded_by")), "effective")


def history_steps(spark: SparkSession, d: str) -> DataFrame:
    return temporal.with_actions(_expr(spark, d, "amended_by"), integrity.highest_revisions(table(spark, d, "actions")))


def _tree(spark, d, paths=True):
    return hierarchy.hierarchy(hierarchy.node_links(table(spark, d, "nodes")), paths)


def _labels(spark, d):
    n = table(spark, d, "nodes")
    return n.select(names.plain_work("id").alias("id"), "title").where("id IS NOT NULL").groupBy("id").agg(F.min("title").alias("label")).withColumn("ord", F.lit(0))


def tree_walk(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(_tree(spark, d), _labels(spark, d)).select("id", "root_id", "depth", "sort_path")


def breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(_tree(spark, d), _labels(spark, d)).select("id", "breadcrumb")


def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, d)).select("id", "ancestor", "distance")


def subtree_counts(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, d)).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("below"))


def child_lists(spark: SparkSession, d: str) -> DataFrame:
    return graph.children(hierarchy.node_links(table(spark, d, "nodes")), _labels(spark, d)).select("id", F.array_join("children", "|").alias("children"))


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Expressions of the work with most descendants and of all below it."""
    closure = hierarchy.descendants(_tree(spark, d))
    top = closure.groupBy("ancestor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ancestor").limit(1).first()
    rows = _day(_expr(spark, d, "retired").select("id", "effective"), "effective")
    return graph.within(rows, "id", closure, top["ancestor"] if top else "")


def subtree_dates(spark: SparkSession, d: str) -> DataFrame:
    first = _expr(spark, d, "retired").where("effective IS NOT NULL").groupBy("id").agg(F.min("effective").alias("effective"))
    return _day(graph.over_subtree(hierarchy.descendants(_tree(spark, d)), first, "effective"), "least")


def registry_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.registry_order(table(spark, d, "sections"), table(spark, d, "sources"))


def _edges(spark, d):
    return graph.edges(_expr(spark, d, "overrides", "narrows", "amended_by", "defines", "supersedes"))


def _works(spark, d):
    return table(spark, d, "sections").select(names.plain_work("id").alias("id")).where("id IS NOT NULL").distinct()


def edge_list(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def refs_in_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.refs_in(_edges(spark, d), ["overrides", "narrows"])


def refs_out_counts(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("from_id", "type").agg(F.count("*").alias("refs_out"))


def unresolved_refs(spark: SparkSession, d: str) -> DataFrame:
    return graph.unresolved(_edges(spark, d), _works(spark, d), ["overrides", "narrows", "supersedes"]).select("from_expr", "to_id", "type").distinct()


def overridden_by(spark: SparkSession, d: str) -> DataFrame:
    return graph.inverse(_edges(spark, d), _works(spark, d), "overrides", "by").select("id", F.array_join("by", "|").alias("overridden_by"))


def narrowed_by(spark: SparkSession, d: str) -> DataFrame:
    return graph.inverse(_edges(spark, d), _works(spark, d), "narrows", "by").select("id", F.array_join("by", "|").alias("narrowed_by"))


def refs_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Works within three steps, either way, of the most overridden work."""
    e = _edges(spark, d).where(F.col("type").isin("overrides", "narrows"))
    top = e.groupBy("to_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "to_id").limit(1).select(F.col("to_id").alias("id"))
    return graph.bfs(e, top, 3, "both")


def connected(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).where(F.col("type").isin("overrides", "narrows"))
    seeds = e.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(20).select("id", (F.lit(1.0) / (1 + F.col("n"))).alias("score"))
    return graph.expanded(e, seeds, {"overrides": 0.7, "narrows": 0.5})


def held_closure(spark: SparkSession, d: str) -> DataFrame:
    """Works held back when those with confidence below 0.65 are; what was there before 2014 is present already and passes
    nothing on."""
    e = _edges(spark, d).where(F.col("type").isin("overrides", "narrows")).select("from_id", "to_id")
    s = table(spark, d, "sections").select(names.plain_work("id").alias("id"), "confidence", "effective")
    return graph.held(e, s.where("confidence < 0.65"), s.where("effective < DATE '2014-01-01' AND id IS NOT NULL").select("id").distinct())


def definitions_found(spark: SparkSession, d: str) -> DataFrame:
    return definitions.found(_expr(spark, d, "body"), ["id", "effective"], "body").groupBy("id", "slug").agg(F.count("*").alias("versions"))


def term_usage(spark: SparkSession, d: str) -> DataFrame:
    return definitions.usages(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["hydrant", "hydraulic crane", "crane", "boiler", "emergency lighthouse"])


def definition_scope(spark: SparkSession, d: str) -> DataFrame:
    """Every term a work uses at its own definition or its nearest ancestor's."""
    defined = definitions.found(_expr(spark, d, "body"), ["id", "effective"], "body").select("id", "slug").distinct()
    closure = hierarchy.descendants(hierarchy.hierarchy(hierarchy.section_links(table(spark, d, "sections"))))
    asked = closure.join(defined.select(F.col("id").alias("ancestor"), "slug"), "ancestor").select("id", "slug").distinct()
    return definitions.resolve(asked, defined, closure)


def work_groups(spark: SparkSession, d: str) -> DataFrame:
    """Works tied by parent links, either way: the least id of each group."""
    n = table(spark, d, "nodes").select(names.plain_work("id").alias("a"), names.plain_work("parent").alias("b"))
    known = n.select(F.col("a").alias("b")).where("b IS NOT NULL").distinct()
    links = n.where("b IS NOT NULL").join(known, "b", "left_semi").select("a", "b")
    alone = n.where("a IS NOT NULL").select("a", F.col("a").alias("b"))
    return graph.components(links.unionByName(alone), "a", "b")


NAMES = "work_groups as_of_snapshot active_at build_current version_chain supersession_faults history_steps tree_walk breadcrumb ancestors subtree_counts child_lists scope_filter subtree_dates registry_order edge_list refs_in_counts refs_out_counts unresolved_refs overridden_by narrowed_by refs_bfs connected held_closure definitions_found term_usage definition_scope"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_D = "coalesce(strftime({x}, '%Y-%m-%d'), '')"
_ME = "CASE WHEN eff IS NULL THEN wid ELSE wid || '@' || strftime(eff, '%Y-%m-%d') END"
_DELIVERED2 = _DELIVERED.replace("superseded_by, title", "superseded_by, supersedes, defines, confidence, title").replace(", title, body, parent", ", title, body, parent")
_CHAIN = f"chain AS (SELECT *, {_ME} AS me, lag({_ME}) OVER w AS before, lead({_ME}) OVER w AS after, lead(supersedes) OVER w AS claimed, row_number() OVER w AS version FROM delivered WINDOW w AS (PARTITION BY wid ORDER BY eff NULLS FIRST))"
_ANCHOR = "trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\\s]|^#', '', 'g'), '[()]+', '-', 'g'), '-')"
_EDGES = f"""edge AS (SELECT DISTINCT wid AS from_id, {_ME} AS from_expr, to_id, anchor, type FROM (
  SELECT wid, eff, {work("x")} AS to_id, '' AS anchor, 'overrides' AS type FROM (SELECT wid, eff, unnest(overrides) AS x FROM delivered)
  UNION ALL SELECT wid, eff, {work("x.id")}, {_ANCHOR.format(x="x.anchor")}, 'narrows' FROM (SELECT wid, eff, unnest(narrows) AS x FROM delivered)
  UNION ALL SELECT wid, eff, {action("x")}, '', 'amends' FROM (SELECT wid, eff, unnest(amended_by) AS x FROM delivered)
  UNION ALL SELECT wid, eff, lower(trim(x)), '', 'defines' FROM (SELECT wid, eff, unnest(defines) AS x FROM delivered)
  UNION ALL SELECT wid, eff, {work("supersedes")}, '', 'supersedes' FROM delivered WHERE supersedes IS NOT NULL)
 WHERE to_id IS NOT NULL AND (wid <> to_id OR type = 'supersedes')),
works AS (SELECT DISTINCT {work("id")} AS id FROM sections WHERE {work("id")} IS NOT NULL)"""
_E = f"WITH RECURSIVE {_DELIVERED2}, {_EDGES}"
_T = f"WITH RECURSIVE {_TREES}"
_CLOSURE = "closure AS (SELECT d.trail[d.i] AS ancestor, id, CAST(depth - i + 1 AS INTEGER) AS distance FROM (SELECT id, depth, trail, unnest(range(1, depth + 1)) AS i FROM down WHERE tree = 'nodes') d)"
_LABELS = f"labels_ AS (SELECT {work('id')} AS id, min(title) AS title FROM nodes WHERE {work('id')} IS NOT NULL GROUP BY 1)"
_DEF = r"(?m)^(?:\([a-z0-9]{1,4}\)\s*)*\*?([A-Z][\p{L}\p{N}-]*(?: [\p{L}\p{N}-]+){0,5}?)\*?,? (?:means|shall mean|is defined as|includes|refers to) "

SQL = {
    "work_groups": f"{_T}, every AS (SELECT id, root_id FROM down WHERE tree = 'nodes' UNION ALL SELECT id, root_id FROM cyclic WHERE tree = 'nodes') SELECT id, min(id) OVER (PARTITION BY root_id) AS component FROM every",
    "as_of_snapshot": f"WITH {_DELIVERED} SELECT wid AS id, {_D.format(x='eff')} AS effective, title FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY eff DESC NULLS LAST) AS n FROM delivered WHERE eff IS NULL OR eff <= DATE '{DAY}') WHERE n = 1 AND (ret IS NULL OR ret > DATE '{DAY}')",
    "active_at": f"WITH {_DELIVERED} SELECT wid AS id, {_D.format(x='eff')} AS effective FROM delivered WHERE eff IS NULL OR eff <= DATE '{DAY}'",
    "build_current": f"WITH {_DELIVERED} SELECT wid AS id, {_D.format(x='eff')} AS effective FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY superseded_by IS NULL DESC, eff DESC NULLS LAST) AS n FROM delivered) WHERE n = 1",
    "version_chain": f"WITH {_DELIVERED2}, {_CHAIN} SELECT wid AS id, {_D.format(x='eff')} AS effective, CAST(version AS INTEGER) AS version, coalesce(before, '') AS previous FROM chain",
    "supersession_faults": f"""WITH {_DELIVERED2}, {_CHAIN} SELECT wid AS id, {_D.format(x='eff')} AS effective, 'supersedes' AS fault FROM chain WHERE supersedes IS NOT NULL AND supersedes IS DISTINCT FROM before
UNION ALL SELECT wid, {_D.format(x='eff')}, 'superseded_by' FROM chain WHERE superseded_by IS NOT NULL AND superseded_by IS DISTINCT FROM after
UNION ALL SELECT wid, {_D.format(x='eff')}, 'not_mutual' FROM chain WHERE superseded_by IS NOT NULL AND after IS NOT NULL AND claimed IS DISTINCT FROM me""",
    "history_steps": f"""WITH {_DELIVERED2}, {_CHAIN} SELECT wid AS id, CAST(version AS INTEGER) AS version, CAST(1 AS INTEGER) AS step, me AS what FROM chain
UNION ALL SELECT DISTINCT wid, CAST(version AS INTEGER), CAST(0 AS INTEGER), what FROM (SELECT wid, version, {action('x')} AS what FROM (SELECT wid, version, unnest(amended_by) AS x FROM chain WHERE version > 1)) c SEMI JOIN acted a ON a.aid = c.what""",
    "tree_walk": f"{_T} SELECT id, root_id, CAST(depth AS INTEGER) AS depth, array_to_string(list_transform(trail, lambda x: '000000000/' || x), '|') AS sort_path FROM down WHERE tree = 'nodes'",
    "breadcrumb": f"{_T}, {_LABELS} SELECT d.id, string_agg(coalesce(l.title, ''), ' > ' ORDER BY i) AS breadcrumb FROM (SELECT id, unnest(trail) AS node, generate_subscripts(trail, 1) AS i FROM down WHERE tree = 'nodes') d JOIN labels_ l ON l.id = d.node GROUP BY d.id",
    "ancestors": f"{_T}, {_CLOSURE} SELECT id, ancestor, distance FROM closure",
    "subtree_counts": f"{_T}, {_CLOSURE} SELECT ancestor AS id, count(*) AS below FROM closure GROUP BY 1",
    "child_lists": f"{_T} SELECT parent AS id, string_agg(id, '|' ORDER BY id) AS children FROM links WHERE tree = 'nodes' AND parent IS NOT NULL GROUP BY 1",
    "scope_filter": f"{_T}, {_CLOSURE}, {_DELIVERED}, top AS (SELECT ancestor FROM closure GROUP BY 1 ORDER BY count(*) DESC, ancestor LIMIT 1) SELECT wid AS id, {_D.format(x='eff')} AS effective FROM delivered WHERE wid IN (SELECT ancestor FROM top UNION ALL SELECT id FROM closure WHERE ancestor IN (SELECT ancestor FROM top))",
    "subtree_dates": f"{_T}, {_CLOSURE}, {_DELIVERED}, firsts AS (SELECT wid AS id, min(eff) AS e FROM delivered WHERE eff IS NOT NULL GROUP BY 1) SELECT ancestor AS id, {_D.format(x='min(e)')} AS least FROM (SELECT id AS ancestor, e FROM firsts UNION ALL SELECT c.ancestor, f.e FROM closure c JOIN firsts f USING (id)) GROUP BY 1",
    "registry_order": "SELECT source_name, CAST(row_number() OVER (ORDER BY kind <> 'base', precedence DESC, source_name) AS INTEGER) AS position FROM sources WHERE source_name IN (SELECT source_name FROM sections)",
    "edge_list": f"{_E} SELECT * FROM edge",
    "refs_in_counts": f"{_E} SELECT to_id, count(*) AS refs_in FROM edge WHERE type IN ('overrides', 'narrows') GROUP BY 1",
    "refs_out_counts": f"{_E} SELECT from_id, type, count(*) AS refs_out FROM edge GROUP BY 1, 2",
    "unresolved_refs": f"{_E} SELECT DISTINCT from_expr, to_id, type FROM edge WHERE type IN ('overrides', 'narrows', 'supersedes') AND to_id NOT IN (SELECT id FROM works)",
    "overridden_by": f"{_E} SELECT to_id AS id, string_agg(DISTINCT from_id, '|' ORDER BY from_id) AS overridden_by FROM edge WHERE type = 'overrides' AND to_id IN (SELECT id FROM works) GROUP BY 1",
    "narrowed_by": f"{_E} SELECT to_id AS id, string_agg(DISTINCT from_id, '|' ORDER BY from_id) AS narrowed_by FROM edge WHERE type = 'narrows' AND to_id IN (SELECT id FROM works) GROUP BY 1",
    "refs_bfs": f"""{_E}, link AS (SELECT DISTINCT from_id, to_id FROM edge WHERE type IN ('overrides', 'narrows')), both_ways AS (SELECT from_id AS a, to_id AS b FROM link UNION SELECT to_id, from_id FROM link),
top AS (SELECT to_id FROM edge WHERE type IN ('overrides', 'narrows') GROUP BY 1 ORDER BY count(*) DESC, to_id LIMIT 1),
go AS (SELECT to_id AS id, 0 AS depth FROM top UNION SELECT b, depth + 1 FROM go JOIN both_ways ON a = id WHERE depth < 3)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM go GROUP BY 1""",
    "held_closure": f"""{_E}, present AS (SELECT DISTINCT {work('id')} AS id FROM sections WHERE effective < DATE '2014-01-01' AND {work('id')} IS NOT NULL),
held AS (SELECT DISTINCT {work('id')} AS id FROM sections WHERE confidence < 0.65 AND {work('id')} IS NOT NULL UNION SELECT e.from_id FROM edge e JOIN held h ON e.to_id = h.id WHERE e.type IN ('overrides', 'narrows') AND h.id NOT IN (SELECT id FROM present))
SELECT DISTINCT id FROM held""",
    "definitions_found": f"""WITH {_DELIVERED}, t AS (SELECT DISTINCT wid, eff, regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT wid, eff, unnest(regexp_extract_all(body, '{_DEF}', 1)) AS x FROM delivered WHERE body IS NOT NULL))
SELECT wid AS id, slug, count(*) AS versions FROM t WHERE slug <> '' GROUP BY 1, 2""",
}
