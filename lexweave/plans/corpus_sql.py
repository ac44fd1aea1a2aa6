"""The same results in SQL (DuckDB), independent of the operators."""

_WORK = "nullif(trim(regexp_replace({x}, '[@#].*$', '')), '')"


def _caps(x: str) -> str:
    return f"CASE WHEN instr({x}, ':') > 0 THEN upper(split_part({x}, ':', 1)) || substr({x}, instr({x}, ':')) ELSE {x} END"


def work(x: str) -> str:
    return _caps(_WORK.format(x=x))


def action(x: str) -> str:
    return _caps(f"nullif(trim({x}), '')")


_DELIVERED = f"""
delivered AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT {work("id")} AS wid, CAST(effective AS DATE) AS eff, CAST(retired AS DATE) AS ret, superseded_by, title, body, parent, loaded_at,
           amended_by, overrides, narrows,
           row_number() OVER (PARTITION BY {work("id")}, effective ORDER BY loaded_at DESC NULLS LAST) AS rn
    FROM sections WHERE {work("id")} IS NOT NULL) WHERE rn = 1),
acted AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT {action("action_id")} AS aid, {work("target_id")} AS wid, CAST(effective AS DATE) AS eff,
           row_number() OVER (PARTITION BY {action("action_id")} ORDER BY revision DESC NULLS LAST, received_at DESC NULLS LAST, feed_pos DESC) AS rn
    FROM actions WHERE {action("action_id")} IS NOT NULL) WHERE rn = 1)"""

_REFS = f"""
named AS (
  SELECT DISTINCT 'amended_by' AS field, wid, eff, {action("x")} AS to_key FROM (SELECT wid, eff, unnest(amended_by) AS x FROM delivered)
  UNION ALL SELECT DISTINCT 'overrides', wid, eff, {work("x")} FROM (SELECT wid, eff, unnest(overrides) AS x FROM delivered)
  UNION ALL SELECT DISTINCT 'narrows', wid, eff, {work("x")} FROM (SELECT wid, eff, unnest(narrows).id AS x FROM delivered)),
refs AS (
  SELECT field, CASE WHEN eff IS NULL THEN wid ELSE wid || '@' || strftime(eff, '%Y-%m-%d') END AS from_key, to_key, eff FROM named WHERE to_key IS NOT NULL
  UNION ALL SELECT 'target_id', aid, wid, eff FROM acted WHERE wid IS NOT NULL),
marked AS (
  SELECT r.field, r.from_key, r.to_key, coalesce(strftime(r.eff, '%Y-%m'), '') AS ref_month,
    CASE WHEN r.field = 'amended_by' THEN a.aid IS NULL OR coalesce(a.eff > r.eff, false)
         ELSE w.wid IS NULL OR (r.eff IS NOT NULL AND coalesce((
            SELECT CASE WHEN arg_max(coalesce(d.ret, DATE '9999-01-01'), coalesce(d.eff, DATE '0001-01-01')) > r.eff THEN false ELSE true END
            FROM delivered d WHERE d.wid = r.to_key AND (d.eff IS NULL OR d.eff <= r.eff)), true)) END AS lost
  FROM refs r
  LEFT JOIN acted a ON r.field = 'amended_by' AND a.aid = r.to_key
  LEFT JOIN (SELECT DISTINCT wid FROM delivered) w ON r.field <> 'amended_by' AND w.wid = r.to_key)"""

_LISTED = """
listed AS (
  SELECT run_id, path, version FROM (
    SELECT run_id, path, version, row_number() OVER (PARTITION BY run_id, path ORDER BY listed_at DESC NULLS LAST, version DESC NULLS LAST) AS rn FROM (
      SELECT run_id, regexp_replace(replace(trim(rel_path), chr(92), '/'), '^(\\./+)+', '') AS path, nullif(trim(lower(blake3)), '') AS version, listed_at
      FROM fingerprints WHERE run_id IS NOT NULL AND rel_path IS NOT NULL)) WHERE rn = 1 AND version IS NOT NULL),
once AS (SELECT run_id, min(started_at) AS started_at, bool_or(lower(trim(state)) = 'ok') AS ok FROM runs GROUP BY run_id),
based AS (
  SELECT a.run_id, (SELECT b.run_id FROM once b WHERE b.ok AND b.started_at < a.started_at ORDER BY b.started_at DESC, b.run_id DESC LIMIT 1) AS base_id FROM once a)"""

_TREES = f"""
node_rows AS (
  SELECT 'nodes' AS tree, {work("id")} AS id, {work("parent")} AS up, CAST(NULL AS DATE) AS eff, CAST(NULL AS TIMESTAMP) AS seen FROM nodes
  UNION ALL SELECT 'sections', {work("id")}, {work("parent")}, CAST(effective AS DATE), loaded_at FROM sections),
one AS (
  SELECT tree, id, up FROM (
    SELECT *, row_number() OVER (PARTITION BY tree, id ORDER BY eff DESC NULLS LAST, seen DESC NULLS LAST, up DESC NULLS LAST) AS rn FROM node_rows WHERE id IS NOT NULL) WHERE rn = 1),
links AS (SELECT o.tree, o.id, p.id AS parent FROM one o LEFT JOIN one p ON p.tree = o.tree AND p.id = o.up),
down AS (
  SELECT tree, id, id AS root_id, 0 AS depth, id AS path, [id] AS trail FROM links WHERE parent IS NULL
  UNION ALL SELECT l.tree, l.id, d.root_id, d.depth + 1, d.path || ' > ' || l.id, list_append(d.trail, l.id) FROM links l JOIN down d ON l.tree = d.tree AND l.parent = d.id),
astray AS (SELECT l.* FROM links l ANTI JOIN down d ON l.tree = d.tree AND l.id = d.id),
up_walk AS (
  SELECT tree, id AS start, id, parent, [id] AS trail, false AS closed FROM astray
  UNION ALL SELECT u.tree, u.start, a.id, a.parent, list_append(u.trail, a.id), list_contains(u.trail, a.id)
  FROM up_walk u JOIN astray a ON a.tree = u.tree AND a.id = u.parent WHERE NOT u.closed),
cyclic AS (
  SELECT tree, start AS id, list_min(list_slice(trail, list_position(trail, id), -2)) AS root_id FROM up_walk WHERE closed)"""

SQL = {
    "p2_found": f"""WITH {_LISTED}
SELECT l.run_id, l.path AS rel_path FROM listed l LEFT JOIN based b ON b.run_id = l.run_id
LEFT JOIN listed h ON h.run_id = b.base_id AND h.path = l.path AND h.version = l.version WHERE h.run_id IS NULL""",
    "p4_found": f"WITH {_DELIVERED},{_REFS} SELECT field, from_key, to_key, ref_month FROM marked WHERE lost",
    "p4_counts": f"""WITH {_DELIVERED},{_REFS}
SELECT field, ref_month, count(*) AS refs, count(*) FILTER (WHERE lost) AS orphans, count(DISTINCT to_key) FILTER (WHERE lost) AS orphan_keys
FROM marked GROUP BY field, ref_month""",
    "p5_found": f"""WITH RECURSIVE {_TREES}
SELECT tree, id, root_id, CAST(depth AS INTEGER) AS depth FROM down UNION ALL SELECT tree, id, root_id, CAST(-1 AS INTEGER) FROM cyclic""",
    "p5_paths": f"""WITH RECURSIVE {_TREES}
SELECT tree, id, root_id, CAST(depth AS INTEGER) AS depth, path, false AS back_edge FROM down
UNION ALL SELECT tree, id, root_id, CAST(-1 AS INTEGER), CAST(NULL AS VARCHAR), id = root_id FROM cyclic""",
    "p5_descendants": f"""WITH RECURSIVE {_TREES}
SELECT tree, a.x AS ancestor, id, CAST(depth - a.i + 1 AS INTEGER) AS distance FROM (SELECT tree, id, depth, trail, unnest(range(1, depth + 1)) AS i FROM down) d, LATERAL (SELECT d.trail[d.i] AS x, d.i AS i) a""",
    "p6_found": f"""WITH {_DELIVERED},
dated AS (
  SELECT wid, eff, ret, title, body, TRY_CAST(nullif(regexp_extract(superseded_by, '@([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS DATE) AS by_date,
         lead(eff) OVER (PARTITION BY wid ORDER BY eff NULLS FIRST) AS next_eff FROM delivered),
ended AS (
  SELECT wid, coalesce(strftime(eff, '%Y-%m-%d'), '') AS f, title, body,
         strftime(least(coalesce(next_eff, DATE '9999-12-31'), coalesce(ret, DATE '9999-12-31'), CASE WHEN eff IS NULL OR by_date > eff THEN coalesce(by_date, DATE '9999-12-31') ELSE DATE '9999-12-31' END), '%Y-%m-%d') AS t
  FROM dated),
kept AS (
  SELECT *, lag(t) OVER w = f AND lag(title) OVER w IS NOT DISTINCT FROM title AND lag(body) OVER w IS NOT DISTINCT FROM body AS goes_on
  FROM ended WHERE t > f WINDOW w AS (PARTITION BY wid ORDER BY f)),
grouped AS (SELECT *, sum(CASE WHEN coalesce(goes_on, false) THEN 0 ELSE 1 END) OVER (PARTITION BY wid ORDER BY f ROWS UNBOUNDED PRECEDING) AS g FROM kept)
SELECT wid AS id, min(f) AS valid_from, CASE WHEN max(t) = '9999-12-31' THEN '' ELSE max(t) END AS valid_to FROM grouped GROUP BY wid, g""",
}
