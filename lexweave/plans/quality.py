"""Queries on validation, evaluation, sampling, consensus and change, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.functions import text as T
from lexweave.operators import hierarchy, incremental, integrity, quality, temporal, validate
from lexweave.plans.corpus_sql import _DELIVERED, _LISTED, _TREES, action, work
from lexweave.session import table


def validate_issues(spark: SparkSession, d: str) -> DataFrame:
    return validate.summary(validate.issues(table(spark, d, "sections"), table(spark, d, "sources"), table(spark, d, "actions")))


def cycle_check(spark: SparkSession, d: str) -> DataFrame:
    return validate.cyclic_works(hierarchy.node_links(table(spark, d, "nodes")))


def action_faults(spark: SparkSession, d: str) -> DataFrame:
    return validate.incomplete_actions(table(spark, d, "actions"))


def precedence_faults(spark: SparkSession, d: str) -> DataFrame:
    return validate.precedence_faults(table(spark, d, "sections"), table(spark, d, "sources"))


def held_files(spark: SparkSession, d: str) -> DataFrame:
    return validate.held_lines(table(spark, d, "elements"))


def similar_versions(spark: SparkSession, d: str) -> DataFrame:
    """Unequal texts of one work whose words overlap by 0.8 or more."""
    rows = table(spark, d, "sections").select(names.plain_work("id").alias("id"), "body")
    return validate.similar_contexts(rows, "id", "body").select("id", F.sha2("a", 256).alias("a"), F.sha2("b", 256).alias("b"), "jaccard")


def unresolved_parents(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").select(names.plain_work("id").alias("id"), names.plain_work("parent").alias("to_key")).where("id IS NOT NULL")
    return n.distinct().join(integrity.keys_without_record(n, n.select(F.col("id").alias("to_key"))), "to_key", "left_semi").select("id", F.col("to_key").alias("parent"))


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = integrity.deliveries(table(spark, d, "sections"), "legal_status")
    return e.groupBy("legal_status").agg(F.countDistinct("id").alias("works"), F.count("*").alias("expressions"))


def evidence_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "elements")
    state = F.when(F.size(F.coalesce("flags", F.array())) == 0, "unchecked").otherwise(F.array_join(F.array_sort("flags"), "+"))
    return e.groupBy(state.alias("state")).agg(F.count("*").alias("lines"), F.round(F.avg("confidence"), 6).alias("confidence"))


def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return quality.nearest_rank(table(spark, d, "events"), "value", 0.95, ["event_type"])


def bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    return quality.bootstrap(table(spark, d, "labels"), "toxic", "rater", rounds=200)


def seeded_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", "source")
    return quality.seeded_sample(docs, "source", "doc_id", 5, "41").select("doc_id", "source", "rn")


def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", "source")
    return quality.round_robin(docs, "source", [F.col("doc_id")], 100)


def _lots(spark, d):
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("lot"), F.when(F.col("event_type") != "view", F.col("value") > 90).alias("bad"))
    return quality.lots(e.where("bad IS NOT NULL"), "lot", "bad", 3)


def lot_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _lots(spark, d)


def switching_level(spark: SparkSession, d: str) -> DataFrame:
    return quality.switching(_lots(spark, d), "lot").select("lot", "level")


def latest_receipt(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return quality.latest(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def budget_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.lit(10.0).alias("reserved"), F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("actual"))
    return quality.budget(e, "event_type", "reserved", "actual", 100_000.0)


def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two raters' marks side by side."""
    l = table(spark, d, "labels")  # noqa: E741
    one = lambda r: l.where(F.col("rater") == r).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return quality.consensus(one("rater-1"), one("rater-2"), "doc_id", ["toxic"])


def agreement_rate(spark: SparkSession, d: str) -> DataFrame:
    c = rater_agreement(spark, d)
    return c.groupBy("state").agg(F.count("*").alias("docs"), F.count_if("toxic_agrees").alias("agreed"))


def combined_actions(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of an action united: how many contents, and by which receipts."""
    a = table(spark, d, "actions").select("action_id", "text", names.action_kind("kind").alias("kind"), "revision", F.date_format("received_at", "yyyy").alias("year"))
    c = quality.combined(a, "action_id", ["kind", "text"], "year")
    return c.select("action_id", "versions", "conflict", F.array_join("evidence", ",").alias("years"))


def align_versions(spark: SparkSession, d: str) -> DataFrame:
    e = integrity.deliveries(table(spark, d, "sections"), "retired", "node", "title", "level_name")
    at = lambda day: temporal.as_of(e, day).select("id", "node", "title", "level_name")
    return quality.aligned(at("2016-01-01"), at("2024-01-01"))


def _good_runs(spark, d) -> tuple[int, int, int]:
    """The first good run of the log, the last good one, and the last one of any state."""
    r = table(spark, d, "runs").groupBy("run_id").agg(F.min("started_at").alias("at"), F.max(F.lower(names.trimmed("state")) == "ok").alias("ok")).where("run_id IS NOT NULL")
    got = r.agg(F.min(F.when(F.col("ok"), F.struct("at", "run_id"))).alias("a"), F.max(F.when(F.col("ok"), F.struct("at", "run_id"))).alias("b"), F.max(F.struct("at", "run_id")).alias("c")).first()
    return got["a"]["run_id"], got["b"]["run_id"], got["c"]["run_id"]


def identity_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Files of the first good run and of the last one: which are the same."""
    first, last, _ = _good_runs(spark, d)
    f = table(spark, d, "fingerprints").where("blake3 IS NOT NULL").select("run_id", names.tidy_path("rel_path").alias("path"), F.lower("blake3").alias("digest"))
    side = lambda run, name: f.where(F.col("run_id") == run).groupBy(F.col("path").alias("native")).agg(F.max("digest").alias("digest")).withColumn(name, F.col("native"))
    return quality.reconciled(side(first, "id"), side(last, "uid"), "native", "digest")


def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of five words that items of several splits share."""
    t = table(spark, d, "eval_items").select("split", T.tokens("text").alias("t")).where(F.size("t") >= 5)
    runs = t.select("split", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 4), lambda i: F.array_join(F.slice("t", i, 5), " "))).alias("run"))
    return quality.leaking_splits(runs, "run", "split")


def diff_changed(spark: SparkSession, d: str) -> DataFrame:
    """What changed between the first good run and the last one."""
    first, last, _ = _good_runs(spark, d)
    l = incremental.listings(table(spark, d, "fingerprints"))  # noqa: E741
    return temporal.compared(l.where(F.col("run_id") == first), l.where(F.col("run_id") == last), "rel_path", "version")


def freshness_state(spark: SparkSession, d: str) -> DataFrame:
    """Per source: is the listing of the last run the one of the last good run?"""
    _, good, last = _good_runs(spark, d)
    l = incremental.listings(table(spark, d, "fingerprints"))  # noqa: E741
    change = temporal.compared(l.where(F.col("run_id") == good), l.where(F.col("run_id") == last), "rel_path", "version")
    src = F.substring_index("rel_path", "/", 1)
    n = change.groupBy(src.alias("source")).agg(F.count("*").alias("stale"))
    return l.where(F.col("run_id") == last).select(src.alias("source")).distinct().join(n, "source", "left").select("source", F.coalesce("stale", F.lit(0)).cast("bigint").alias("stale"), F.when(F.coalesce("stale", F.lit(0)) == 0, "fresh").otherwise("possibly_stale").alias("state"))


def cache_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Compiled groups of the last good run that the last run may reuse: same files, same digests."""
    _, good, last = _good_runs(spark, d)
    l = incremental.listings(table(spark, d, "fingerprints"))  # noqa: E741
    group = F.regexp_extract("rel_path", r"^([^/]+/[^/]+)", 1)
    key = lambda run: l.where(F.col("run_id") == run).groupBy(group.alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "rel_path", "version"))), ","), 256).alias("input"))
    return key(last).join(key(good).withColumnRenamed("input", "cached"), "g", "left").select(F.col("g").alias("files"), F.coalesce(F.col("input") == F.col("cached"), F.lit(False)).alias("reused"))


def tumbling_changes(spark: SparkSession, d: str) -> DataFrame:
    """Feed arrivals per day and kind, late ones included."""
    a = table(spark, d, "actions")
    w = F.window("received_at", "1 day")
    return a.groupBy(w.alias("w"), names.action_kind("kind").alias("kind")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "kind", "n")


def session_changes(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of one user's events: a gap of half an hour ends a burst."""
    e = table(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n", "total")


NAMES = "validate_issues cycle_check action_faults precedence_faults held_files similar_versions unresolved_parents status_rollup evidence_states percentile_nearest_rank bootstrap_means seeded_stratified_sample round_robin_sample lot_decisions switching_level latest_receipt budget_status rater_agreement agreement_rate combined_actions align_versions identity_reconcile split_leaks diff_changed freshness_state cache_reuse tumbling_changes session_changes"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_KIND = "CASE WHEN nullif(trim({x}), '') IS NULL THEN 'stay' WHEN regexp_matches(lower({x}), 'redesignat') THEN 'redesignate' WHEN regexp_matches(lower({x}), 'remov|delet') THEN 'remove' WHEN regexp_matches(lower(trim({x})), '^add') THEN 'add' WHEN regexp_matches(lower({x}), 'stay|suspend') THEN 'stay' ELSE 'amend' END"
_TOK = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 2)"
_PICKED = "picked AS (SELECT (SELECT run_id FROM once WHERE ok AND run_id IS NOT NULL ORDER BY started_at, run_id LIMIT 1) AS first, (SELECT run_id FROM once WHERE ok AND run_id IS NOT NULL ORDER BY started_at DESC, run_id DESC LIMIT 1) AS good, (SELECT run_id FROM once WHERE run_id IS NOT NULL ORDER BY started_at DESC, run_id DESC LIMIT 1) AS last)"
_DIFF = "WITH {l}, {p}, a AS (SELECT path, version FROM listed, picked WHERE run_id = {x}), b AS (SELECT path, version FROM listed, picked WHERE run_id = {y}), diff AS (SELECT coalesce(a.path, b.path) AS rel_path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.version IS DISTINCT FROM b.version THEN 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path)"
_LOTS = "lots AS (SELECT lot, count(bad) AS graded, count(*) FILTER (WHERE bad) AS errors FROM (SELECT strftime(ts, '%Y-%m-%d') AS lot, value > 90 AS bad FROM events WHERE event_type <> 'view' AND value IS NOT NULL) GROUP BY lot), decided AS (SELECT lot, graded, errors, round(errors / graded, 6) AS rate, CASE WHEN errors <= 3 THEN 'accepted' ELSE 'rejected' END AS decision FROM lots)"
_RATERS = "both_ AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'only_first' WHEN a.doc_id IS NULL THEN 'only_second' ELSE 'both' END AS state, coalesce(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.toxic IS NOT DISTINCT FROM b.toxic, false) AS toxic_agrees FROM (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE rater = 'rater-1' GROUP BY 1) a FULL JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE rater = 'rater-2' GROUP BY 1) b ON a.doc_id = b.doc_id)"
_TOTAL = "nullif(trim({x}), '') IS NULL"
_ISSUE_ROWS = f"""reg AS (SELECT source_name, any_value(id_prefix) AS prefix, any_value(kind) AS source_kind FROM sources GROUP BY 1),
w AS (SELECT DISTINCT {work('id')} AS id FROM sections),
s AS (SELECT x.*, {work('x.id')} AS wid, {work('x.parent')} AS up, r.source_name IS NOT NULL AS known, r.prefix, r.source_kind FROM sections x LEFT JOIN reg r ON r.source_name = x.source_name)"""
_RULES = [
    ("unknown_source", "error", "NOT known"), ("missing_id", "error", "wid IS NULL"), ("missing_title", "error", _TOTAL.format(x="title")), ("missing_level", "error", _TOTAL.format(x="level_name")),
    ("wrong_prefix", "error", "prefix IS NOT NULL AND split_part(wid, ':', 1) <> prefix"), ("kind_differs", "error", "source_kind IS NOT NULL AND kind <> source_kind"),
    ("no_effective", "warning", "effective IS NULL"), ("retired_before_effective", "error", "retired <= effective"), ("published_after_effective", "warning", "published > effective"),
    ("unknown_parent", "error", "up IS NOT NULL AND up NOT IN (SELECT id FROM w WHERE id IS NOT NULL)"), ("own_parent", "error", "up = wid"), ("empty_body", "warning", _TOTAL.format(x="body")),
    ("overrides_in_base", "error", "kind = 'base' AND len(coalesce(overrides, [])) > 0"), ("low_confidence", "warning", "confidence < 0.7"),
    ("unknown_legal_status", "error", "coalesce(legal_status, '') NOT IN ('official', 'unofficial-xml', 'derived')"),
]

SQL = {
    "validate_issues": f"WITH {_ISSUE_ROWS}, issue AS (" + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{v}' AS severity FROM s WHERE {c}" for n, v, c in _RULES)
    + f""" UNION ALL SELECT 'repeated_expression', 'error' FROM (SELECT wid, effective FROM s WHERE wid IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
 UNION ALL SELECT 'unknown_action', 'error' FROM (SELECT DISTINCT rel_path FROM (SELECT rel_path, {action('x')} AS a FROM (SELECT rel_path, unnest(amended_by) AS x FROM sections)) WHERE a IS NOT NULL AND a NOT IN (SELECT {action('action_id')} FROM actions)))
SELECT "check", severity, count(*) AS n FROM issue GROUP BY 1, 2""",
    "cycle_check": f"WITH RECURSIVE {_TREES} SELECT id, root_id FROM cyclic WHERE tree = 'nodes'",
    "action_faults": f"""SELECT DISTINCT action_id, revision, fault FROM (
SELECT action_id, revision, 'no_target' AS fault FROM actions WHERE {work('target_id')} IS NULL UNION ALL SELECT action_id, revision, 'no_date' FROM actions WHERE effective IS NULL
UNION ALL SELECT action_id, revision, 'no_text' FROM actions WHERE {_KIND.format(x='kind')} IN ('add', 'amend', 'redesignate') AND nullif(trim(text), '') IS NULL)""",
    "precedence_faults": f"""WITH p AS (SELECT source_name, max(precedence) AS p FROM sources GROUP BY 1), o AS (SELECT {work('id')} AS to_id, min(source_name) AS source_name FROM sections GROUP BY 1),
x AS (SELECT {work('id')} AS id, source_name, {work('x')} AS to_id FROM (SELECT id, source_name, unnest(overrides) AS x FROM sections))
SELECT DISTINCT x.id, x.to_id FROM x JOIN p ON p.source_name = x.source_name JOIN o ON o.to_id = x.to_id JOIN p q ON q.source_name = o.source_name WHERE p.p <= q.p""",
    "held_files": "SELECT DISTINCT doc_sha FROM elements WHERE list_has_any(flags, ['ocr_unverified', 'ocr_divergent', 'no_text_layer'])",
    "similar_versions": f"""WITH t AS (SELECT id, body, list_distinct({_TOK.format(x='body')}) AS w FROM (SELECT DISTINCT {work('id')} AS id, body FROM sections WHERE body IS NOT NULL) WHERE id IS NOT NULL),
p AS (SELECT a.id, sha256(a.body) AS a, sha256(b.body) AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON a.id = b.id AND a.body < b.body WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT * FROM p WHERE jaccard >= 0.8""",
    "unresolved_parents": f"SELECT DISTINCT * FROM (SELECT {work('id')} AS id, {work('parent')} AS parent FROM nodes) WHERE id IS NOT NULL AND parent IS NOT NULL AND parent NOT IN (SELECT {work('id')} FROM nodes WHERE {work('id')} IS NOT NULL)",
    "status_rollup": f"WITH {_DELIVERED.replace('parent, loaded_at', 'parent, legal_status, loaded_at')} SELECT legal_status, count(DISTINCT wid) AS works, count(*) AS expressions FROM delivered GROUP BY 1",
    "evidence_states": "SELECT CASE WHEN len(coalesce(flags, [])) = 0 THEN 'unchecked' ELSE array_to_string(list_sort(flags), '+') END AS state, count(*) AS lines, round(avg(confidence), 6) AS confidence FROM elements GROUP BY 1",
    "percentile_nearest_rank": "SELECT event_type, quantile_disc(value, 0.95) AS value FROM events WHERE value IS NOT NULL GROUP BY 1",
    "seeded_stratified_sample": "SELECT doc_id, source, CAST(rn AS INTEGER) AS rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('41' || doc_id), doc_id) AS rn FROM documents WHERE source IS NOT NULL) WHERE rn <= 5",
    "round_robin_sample": "SELECT doc_id, source, CAST(turn AS INTEGER) AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents WHERE source IS NOT NULL) ORDER BY turn, source LIMIT 100",
    "lot_decisions": f"WITH {_LOTS} SELECT * FROM decided",
    "switching_level": f"WITH {_LOTS} SELECT lot, CASE WHEN sum((decision = 'rejected')::INT) OVER (ORDER BY lot ROWS 4 PRECEDING) >= 2 THEN 'tightened' WHEN count(*) OVER (ORDER BY lot ROWS 9 PRECEDING) = 10 AND sum((decision = 'rejected')::INT) OVER (ORDER BY lot ROWS 9 PRECEDING) = 0 THEN 'reduced' ELSE 'normal' END AS level FROM decided",
    "latest_receipt": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "budget_status": "SELECT event_type, round(sum(c), 4) AS charged, count(*) FILTER (WHERE a IS NULL) AS unresolved, round(greatest(0, 100000.0 - sum(c)), 4) AS remaining FROM (SELECT event_type, CASE WHEN user_id % 3 <> 0 THEN value END AS a, coalesce(CASE WHEN user_id % 3 <> 0 THEN value END, 10.0) AS c FROM events) GROUP BY 1",
    "rater_agreement": f"WITH {_RATERS} SELECT * FROM both_",
    "agreement_rate": f"WITH {_RATERS} SELECT state, count(*) AS docs, count(*) FILTER (WHERE toxic_agrees) AS agreed FROM both_ GROUP BY 1",
    "combined_actions": f"SELECT action_id, count(DISTINCT coalesce(text, chr(1)) || chr(2) || {_KIND.format(x='kind')}) AS versions, count(DISTINCT coalesce(text, chr(1)) || chr(2) || {_KIND.format(x='kind')}) > 1 AS conflict, string_agg(DISTINCT strftime(received_at, '%Y'), ',' ORDER BY strftime(received_at, '%Y')) AS years FROM actions GROUP BY 1",
    "split_leaks": f"WITH t AS (SELECT split, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM eval_items), r AS (SELECT split, array_to_string(t[k:k + 4], ' ') AS run FROM (SELECT split, t, unnest(range(1, len(t) - 3)) AS k FROM t)) SELECT run, count(DISTINCT split) AS splits FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "diff_changed": _DIFF.format(l=_LISTED, p=_PICKED, x="first", y="good") + " SELECT rel_path, change FROM diff WHERE change IS NOT NULL",
    "freshness_state": _DIFF.format(l=_LISTED, p=_PICKED, x="good", y="last") + ", n AS (SELECT split_part(rel_path, '/', 1) AS source, count(*) AS stale FROM diff WHERE change IS NOT NULL GROUP BY 1) SELECT s.source, coalesce(stale, 0) AS stale, CASE WHEN coalesce(stale, 0) = 0 THEN 'fresh' ELSE 'possibly_stale' END AS state FROM (SELECT DISTINCT split_part(path, '/', 1) AS source FROM b) s LEFT JOIN n ON n.source = s.source",
    "cache_reuse": f"WITH {_LISTED}, {_PICKED}, k AS (SELECT run_id, regexp_extract(path, '^([^/]+/[^/]+)', 1) AS g, string_agg(path || '=' || version, ',' ORDER BY path || '=' || version) AS input FROM listed GROUP BY 1, 2) SELECT a.g AS files, coalesce(a.input = b.input, false) AS reused FROM picked JOIN k a ON a.run_id = picked.last LEFT JOIN k b ON b.g = a.g AND b.run_id = picked.good",
    "tumbling_changes": f"SELECT strftime(received_at, '%Y-%m-%d') AS day, {_KIND.format(x='kind')} AS kind, count(*) AS n FROM actions WHERE received_at IS NOT NULL GROUP BY 1, 2",
    "session_changes": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY user_id, k",
}
