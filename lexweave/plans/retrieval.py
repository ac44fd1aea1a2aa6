"""Queries on search and exact search, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.functions import text as T
from lexweave.operators import grep, quality, ranking
from lexweave.plans.corpus_sql import work
from lexweave.session import fs_of, new_path, shared_path, table
from lexweave.sources.index import SearchIndex

Q = "emergency hydrant inspected lighthouse"
PATTERN = r"hydraulic (boiler|crane)"


def _docs(spark, d):
    return table(spark, d, "documents")


def _index(spark, d) -> SearchIndex:
    """The stored index of the documents' texts in the shared folder: made at first use, kept while the file is the same."""
    fs, p = fs_of(spark, f"{d}/documents.parquet")
    status = fs.getFileStatus(p)
    name = hashlib.sha256(f"{p.toString()}|{status.getLen()}|{status.getModificationTime()}".encode()).hexdigest()[:16]
    index = SearchIndex(spark, shared_path(spark, f"index-{name}"), "doc_id", ["text"], "text")
    if not index.segments():
        index.update(_docs(spark, d))
    return index


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """What the index holds: its documents and words."""
    last = _index(spark, d).segments()[-1]
    return spark.createDataFrame([(last["documents"], last["lengths"][0])], "documents bigint, words bigint")


def index_update(spark: SparkSession, d: str) -> DataFrame:
    """An index of the notes, brought up to all documents and then to all but the notices: segments, documents and words."""
    docs = _docs(spark, d)
    index = SearchIndex(spark, new_path(spark, "updated"), "doc_id", ["text"])
    for part in (docs.where("kind = 'note'"), docs, docs.where("kind IS NULL OR kind <> 'notice'")):
        index.update(part)
    rows = [(s["number"], s["documents"], s["lengths"][0]) for s in index.segments()]
    return spark.createDataFrame(rows, "segment int, documents bigint, words bigint")


def lex_bm25_top(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(_index(spark, d).bm25(Q), "doc_id", 100)


def lex_bm25_ties(spark: SparkSession, d: str) -> DataFrame:
    """The ten best and all that tie with the tenth."""
    return ranking.top(_index(spark, d).bm25("boiler crane"), "doc_id", 10, ties=True)


def lex_bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking without an index."""
    return ranking.top(ranking.bm25(_docs(spark, d), Q, "doc_id", {"text": 1.0}), "doc_id", 100)


def lex_bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where("kind = 'note' AND lang = 'en'")
    return ranking.top(ranking.bm25(docs, Q, "doc_id", {"text": 1.0}), "doc_id", 100)


def lex_fielded(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(ranking.bm25(table(spark, d, "chunks").dropDuplicates(["chunk_id"]), "hydrant duties", "chunk_id", {"title": 3.0, "breadcrumb": 2.0, "body": 1.0}), "chunk_id", 100)


def vec_top(spark: SparkSession, d: str) -> DataFrame:
    """The 100 nearest vectors of every query row: those whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    return ranking.nearest(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 100)


def vec_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return ranking.nearest(v.where("label = 3"), v.where("vec_id % 50 = 0"), "vec_id", "embedding", 20)


def _fused(spark, d):
    """The lexical list of ``Q`` fused with the vector list of each query row."""
    vec = vec_top(spark, d).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    queries = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")).distinct()
    lex = lex_bm25_top(spark, d).select("doc_id", "rank")  # 100 rows
    return ranking.rrf(queries.join(F.broadcast(lex)), vec, ["query_id", "doc_id"], 2.0, 1.0)


def rrf_fused(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


def rrf_signals(spark: SparkSession, d: str) -> DataFrame:
    """The fused lists with title match, chunks of the same work among the candidates, notes, and texts that a later one of
    their work replaces."""
    docs = _docs(spark, d).select("doc_id", "kind", names.plain_work("id").alias("id"), "effective")
    titles = table(spark, d, "nodes").select(names.plain_work("id").alias("id"), "title").where("id IS NOT NULL").groupBy("id").agg(F.min("title").alias("title"))
    newest = docs.where("id IS NOT NULL").groupBy("id").agg(F.max("effective").alias("newest"))
    about = docs.join(titles, "id", "left").join(newest, "id", "left")
    rows = ranking.with_chunks(_fused(spark, d).join(about, "doc_id"), ["query_id"], "id")
    superseded = F.coalesce(F.col("effective") < F.col("newest"), F.lit(False))
    return rows.select(
        "query_id", "doc_id", "chunks",
        ranking.adjusted(F.col("score"), ranking.title_fraction(Q, "title"), F.lit(0), F.col("chunks"), F.coalesce(F.col("kind") == "note", F.lit(False)), superseded).alias("score"),
    )


def collapse_best(spark: SparkSession, d: str) -> DataFrame:
    scored = ranking.bm25(_docs(spark, d), Q, "doc_id", {"text": 1.0}).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return ranking.collapse(scored.where("source IS NOT NULL"), "source", "doc_id")


def pinned_list(spark: SparkSession, d: str) -> DataFrame:
    """The lexical list with the documents of the work that the most Expressions override pinned ahead of it."""
    e = table(spark, d, "sections").select(names.plain_work("id").alias("me"), F.explode("overrides").alias("x")).select("me", names.plain_work("x").alias("id"))
    docs = _docs(spark, d).select("doc_id", names.plain_work("id").alias("id"))
    top = e.where("id IS NOT NULL AND me <> id").groupBy("id").agg(F.countDistinct("me").alias("n")).join(docs.select("id").distinct(), "id", "left_semi").orderBy(F.desc("n"), "id").limit(1)
    pins = docs.join(F.broadcast(top.select("id")), "id").select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("pin"))
    return ranking.pinned(lex_bm25_top(spark, d), pins, "doc_id")


def abstain(spark: SparkSession, d: str) -> DataFrame:
    """For every evaluation item: would the engine abstain, given the share of its words that its best document has? (Items
    have no vectors.)"""
    share = ranking.best_share(table(spark, d, "eval_items"), _docs(spark, d), "item_id", "text")
    return share.select("item_id", ranking.abstains(F.col("share"), F.lit(None).cast("double"), F.lit(0)).alias("abstains"))


def best_line(spark: SparkSession, d: str) -> DataFrame:
    return ranking.best_lines(_docs(spark, d), Q, "doc_id", "text")


def seed_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = lex_bm25_top(spark, d).join(_docs(spark, d).select("doc_id", T.words("text").alias("words")), "doc_id")
    return ranking.within_budget(rows, [F.col("rank")], "words", 3000).select("doc_id", "rank", "words", "spent")


def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    return grep.matches(_docs(spark, d), "doc_id", "text", PATTERN)


def grep_word(spark: SparkSession, d: str) -> DataFrame:
    return grep.matches(_docs(spark, d), "doc_id", "text", grep.pattern_of(["kiln"], word=True, ignore_case=True)).select("path", "line_no")


def grep_multi(spark: SparkSession, d: str) -> DataFrame:
    return grep.matches(_docs(spark, d), "doc_id", "text", grep.pattern_of(["§ 4.", "(b) No"], fixed=True)).select("path", "line_no")


def grep_counts(spark: SparkSession, d: str) -> DataFrame:
    return grep.counts(grep.matches(_docs(spark, d), "doc_id", "text", PATTERN))


def grep_context(spark: SparkSession, d: str) -> DataFrame:
    return grep.with_context(_docs(spark, d), "doc_id", "text", PATTERN, 1, 2).select("path", "line_no", "is_match", "breaks")


def grep_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fingerprints").where(grep.selected_paths("rel_path", ["ucr-title-2*/**", "!*0/*.md", "!**/7.md"]))
    return f.groupBy("rel_path").agg(F.count("*").alias("n"))


def grep_bounded(spark: SparkSession, d: str) -> DataFrame:
    return grep.bounded(grep.matches(_docs(spark, d), "doc_id", "text", "kiln"), 200)[1]


def gram_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).candidates(grep.required_literals(PATTERN))


def grep_indexed(spark: SparkSession, d: str) -> DataFrame:
    """``grep_lines`` over the candidates of the gram index."""
    return _index(spark, d).matches(_docs(spark, d), PATTERN)


def gram_pairs(spark: SparkSession, d: str) -> DataFrame:
    return grep.pair_weights(_docs(spark, d), "text")


def id_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("id").distinct().select("id", F.array_join(T.id_parts("id"), "|").alias("parts"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("title").distinct().select("title", T.slug("title").alias("slug"))


def citation_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where("body IS NOT NULL").select("rel_path", "loaded_at", F.array_join(T.citations("body"), "|").alias("cites"))


def cited_sections(spark: SparkSession, d: str) -> DataFrame:
    cites = _docs(spark, d).where("text IS NOT NULL").select(F.explode(T.citations("text")).alias("cite"))
    return cites.groupBy("cite").agg(F.count("*").alias("docs"))


def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of neighbouring versions of a work."""
    s = table(spark, d, "sections").where("id IS NOT NULL").groupBy("id", "effective").agg(F.max(F.struct("loaded_at", "body")).alias("x"))
    w = Window.partitionBy("id").orderBy(F.col("effective").asc_nulls_first())
    s = s.select("id", "effective", F.array_distinct(F.coalesce(T.tokens("x.body"), F.array().cast("array<string>"))).alias("now"), F.lag(F.array_distinct(F.coalesce(T.tokens("x.body"), F.array().cast("array<string>")))).over(w).alias("then"))
    return s.where("then IS NOT NULL").select("id", F.date_format("effective", "yyyy-MM-dd").alias("effective"), F.round(T.jaccard(F.col("now"), F.col("then")), 6).alias("jaccard"), F.round(T.overlap(F.col("now"), F.col("then")), 6).alias("overlap"))


def levenshtein_sim(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of the titles of neighbouring versions of a work, where they differ."""
    s = table(spark, d, "sections").where("id IS NOT NULL").groupBy("id", "effective").agg(F.max(F.struct("loaded_at", "title")).alias("x"))
    w = Window.partitionBy("id").orderBy(F.col("effective").asc_nulls_first())
    s = s.select("id", F.coalesce(F.date_format("effective", "yyyy-MM-dd"), F.lit("")).alias("effective"), F.col("x.title").alias("a"), F.lag("x.title").over(w).alias("b"))
    return s.where("a <> b").select("id", "effective", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def run_containment(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold all words of an evaluation item in a row."""
    run = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    items = table(spark, d, "eval_items").select("item_id", T.tokens("text").alias("t")).where(F.size("t") > 0).select("item_id", run("t").alias("run")).distinct()
    docs = _docs(spark, d).select("doc_id", T.tokens("text").alias("t")).where(F.size("t") > 0).select("doc_id", run("t").alias("words"))
    return docs.join(F.broadcast(items), F.contains(F.col("words"), F.col("run"))).select("doc_id", "item_id")


def _run_hits(items: DataFrame, docs: DataFrame, n: int = 8) -> DataFrame:
    """(item_id, doc_id): documents that share a run of ``n`` words with an item, by an equi-join on runs."""
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
    runs = lambda df, key: df.select(key, T.tokens("text").alias("t")).where(F.size("t") >= n).select(key, F.explode(F.array_distinct(cut("t"))).alias("run"))
    return runs(docs, "doc_id").join(runs(items, "item_id"), "run").select("item_id", "doc_id").distinct()


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well ranking documents by the words they share with an evaluation item finds those that repeat eight of its words
    in a row: recall, NDCG and reciprocal rank at 10 of every item that is repeated at all."""
    items, docs = table(spark, d, "eval_items").select("item_id", "text"), _docs(spark, d).select("doc_id", "text")
    ranked = ranking.shared_words(items, docs, "item_id", "doc_id", "text", 10)
    return quality.ranking_metrics(ranked, _run_hits(items, docs), "item_id", "doc_id", 10)


NAMES = "index_build index_update lex_bm25_top lex_bm25_ties lex_bm25_scan lex_bm25_filtered lex_fielded vec_top vec_filtered rrf_fused rrf_signals collapse_best pinned_list abstain best_line seed_budget grep_lines grep_word grep_multi grep_counts grep_context grep_files grep_bounded gram_candidates grep_indexed gram_pairs id_tokens slugs citation_tokens cited_sections token_jaccard levenshtein_sim run_containment retrieval_metrics"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_TOK = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _bm25(rows: str, key: str, fields: dict[str, float], query: str) -> str:
    terms = query.split()
    parts = []
    for i, (f, boost) in enumerate(fields.items()):
        for t in terms:
            tf, df = f"tf_{i}_{t}", f"df_{i}_{t}"
            parts.append(f"CASE WHEN {tf} > 0 THEN {boost} * ln(1 + (n - {df} + 0.5) / ({df} + 0.5)) * ({tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len_{i} / avg_{i}))) ELSE 0.0 END")
    toks = ", ".join(f"coalesce({_TOK.format(x=f)}, []) AS t_{i}" for i, f in enumerate(fields))
    tfs = ", ".join(f"len(t_{i}) AS len_{i}, " + ", ".join(f"len(list_filter(t_{i}, lambda x: x = '{t}')) AS tf_{i}_{t}" for t in terms) for i in range(len(fields)))
    stats = ", ".join(f"avg(len_{i}) AS avg_{i}, " + ", ".join(f"count(*) FILTER (WHERE tf_{i}_{t} > 0) AS df_{i}_{t}" for t in terms) for i in range(len(fields)))
    some = " + ".join(f"tf_{i}_{t}" for i in range(len(fields)) for t in terms)
    return f"""tokd AS (SELECT {key}, {toks} FROM ({rows})), counted AS (SELECT {key}, {tfs} FROM tokd), stats AS (SELECT count(*) AS n, {stats} FROM counted),
scored AS (SELECT {key}, round({' + '.join(parts)}, 6) AS score FROM counted, stats WHERE {some} > 0)"""


_RANK = "SELECT {k}, score, CAST(row_number() OVER (ORDER BY round(score * 1000) DESC, {k}) AS INTEGER) AS rank FROM scored ORDER BY rank LIMIT 100"
_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_COS = f"round({_DOT.format(a='v.embedding', b='q.embedding')} / (sqrt({_DOT.format(a='v.embedding', b='v.embedding')}) * sqrt({_DOT.format(a='q.embedding', b='q.embedding')})), 6)"
_NEAR = f"""(SELECT query_id, vec_id, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cosine * 1000) DESC NULLS LAST, vec_id) AS INTEGER) AS rank
 FROM (SELECT q.vec_id AS query_id, v.vec_id, CASE WHEN {_DOT.format(a='v.embedding', b='v.embedding')} > 0 AND {_DOT.format(a='q.embedding', b='q.embedding')} > 0 THEN {_COS} END AS cosine FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0{{where}})) WHERE rank <= {{k}}"""
_LEX = f"""{_bm25("SELECT * FROM documents", "doc_id", {"text": 1.0}, Q)}, lex AS ({_RANK.format(k="doc_id")})"""
_LEGS = f"""{_LEX}, vec AS (SELECT query_id, vec_id AS doc_id, rank FROM {_NEAR.format(where='', k=100)}), asked AS (SELECT DISTINCT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0),
fused AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.doc_id, v.doc_id) AS doc_id, coalesce(l.rank, 0) AS lex_rank, coalesce(v.rank, 0) AS vec_rank, round((coalesce(2.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0)) / (3.0 / 61), 6) AS score
 FROM (SELECT query_id, doc_id, rank FROM lex, asked) l FULL JOIN vec v ON l.doc_id = v.doc_id AND l.query_id = v.query_id)"""
_LINES = r"SELECT doc_id AS path, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) AS line_no FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0))"
_TERMS = "[" + ", ".join(f"'{t}'" for t in Q.split()) + "]"
_VERSIONS = "SELECT id, effective, arg_max(body, loaded_at) AS body FROM sections WHERE id IS NOT NULL GROUP BY id, effective"
_SET = "list_distinct(coalesce(" + _TOK.format(x="body") + ", []))"

SQL = {
    "index_build": f"SELECT count(*) AS documents, CAST(sum(len(coalesce({_TOK.format(x='text')}, []))) AS BIGINT) AS words FROM documents",
    "index_update": " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS segment, count(*) AS documents, CAST(sum(len(coalesce({_TOK.format(x='text')}, []))) AS BIGINT) AS words FROM documents WHERE {w}" for i, w in enumerate(("kind = 'note'", "true", "kind IS NULL OR kind <> 'notice'"))),
    "lex_bm25_top": f"WITH {_LEX} SELECT * FROM lex",
    "lex_bm25_scan": f"WITH {_LEX} SELECT * FROM lex",
    "lex_bm25_ties": f"WITH {_bm25('SELECT * FROM documents', 'doc_id', {'text': 1.0}, 'boiler crane')} SELECT doc_id, score, rank FROM (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY round(score * 1000) DESC, doc_id) AS INTEGER) AS rank, rank() OVER (ORDER BY round(score * 1000) DESC) AS place FROM scored) WHERE place <= 10",
    "lex_bm25_filtered": "WITH " + _bm25("SELECT * FROM documents WHERE kind = 'note' AND lang = 'en'", "doc_id", {"text": 1.0}, Q) + " " + _RANK.format(k="doc_id"),
    "lex_fielded": f"WITH {_bm25('SELECT DISTINCT ON (chunk_id) * FROM chunks', 'chunk_id', {'title': 3.0, 'breadcrumb': 2.0, 'body': 1.0}, 'hydrant duties')} {_RANK.format(k='chunk_id')}",
    "vec_top": f"SELECT * FROM {_NEAR.format(where='', k=100)}",
    "vec_filtered": f"SELECT * FROM {_NEAR.format(where=' AND v.label = 3', k=20)}",
    "rrf_fused": f"WITH {_LEGS} SELECT query_id, doc_id, lex_rank, vec_rank, score FROM fused",
    "rrf_signals": f"""WITH {_LEGS}, about AS (SELECT d.doc_id, d.kind, d.wid AS id, t.title, coalesce(d.effective < max(d.effective) OVER (PARTITION BY d.wid), false) AND d.wid IS NOT NULL AS old
  FROM (SELECT doc_id, kind, {work('id')} AS wid, effective FROM documents) d LEFT JOIN (SELECT {work('id')} AS id, min(title) AS title FROM nodes GROUP BY 1) t ON t.id = d.wid),
rows_ AS (SELECT f.query_id, f.doc_id, f.score, a.kind, a.title, a.old, CASE WHEN a.id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY f.query_id, a.id) END AS chunks FROM fused f JOIN about a USING (doc_id))
SELECT query_id, doc_id, CAST(chunks AS BIGINT) AS chunks, round(score + 0.10 * coalesce(len(list_intersect({_TERMS}, {_TOK.format(x='title')})), 0) / 4.0 + CASE WHEN chunks >= 3 THEN 0.10 ELSE 0 END - CASE WHEN kind = 'note' THEN 0.20 ELSE 0 END - CASE WHEN old THEN 0.50 ELSE 0 END, 6) AS score FROM rows_""",
    "collapse_best": f"WITH {_bm25('SELECT * FROM documents', 'doc_id', {'text': 1.0}, Q)} SELECT source, doc_id, score FROM (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM scored JOIN documents USING (doc_id) WHERE source IS NOT NULL) WHERE rn = 1",
    "pinned_list": f"""WITH {_LEX}, d AS (SELECT doc_id, {work('id')} AS id FROM documents), o AS (SELECT DISTINCT {work('id')} AS me, {work('x')} AS id FROM (SELECT id, unnest(overrides) AS x FROM sections)),
top AS (SELECT id FROM o WHERE id IS NOT NULL AND me <> id AND id IN (SELECT id FROM d) GROUP BY id ORDER BY count(DISTINCT me) DESC, id LIMIT 1), pins AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS pin FROM d WHERE id IN (SELECT id FROM top))
SELECT doc_id, 2.0 AS score, pin FROM pins UNION ALL SELECT doc_id, score, 0 FROM lex WHERE doc_id NOT IN (SELECT doc_id FROM pins)""",
    "abstain": f"""WITH d AS (SELECT list_distinct({_TOK.format(x='text')}) AS t FROM documents WHERE text IS NOT NULL), q AS (SELECT item_id, list_distinct({_TOK.format(x='text')}) AS t FROM eval_items)
SELECT item_id, coalesce(max(len(list_intersect(q.t, d.t))) / nullif(len(q.t), 0), 0) < 0.34 AS abstains FROM q LEFT JOIN d ON true GROUP BY item_id, q.t""",
    "best_line": f"SELECT path AS doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(hits AS INTEGER) AS hits, substr(line, 1, 220) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY hits DESC, line_no) AS rn FROM (SELECT *, len(list_intersect({_TERMS}, {_TOK.format(x='line')})) AS hits FROM ({_LINES}))) WHERE rn = 1 AND hits > 0",
    "seed_budget": rf"WITH {_LEX} SELECT * FROM (SELECT doc_id, rank, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS words, CAST(sum(words) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM lex JOIN documents USING (doc_id)) WHERE spent <= 3000",
    "grep_lines": f"SELECT path, line_no, line FROM ({_LINES}) WHERE regexp_matches(line, '{PATTERN}')",
    "grep_word": rf"SELECT path, line_no FROM ({_LINES}) WHERE regexp_matches(line, '(?i)(^|[^\p{{L}}\p{{N}}_])kiln($|[^\p{{L}}\p{{N}}_])')",
    "grep_multi": f"SELECT path, line_no FROM ({_LINES}) WHERE contains(line, '§ 4.') OR contains(line, '(b) No')",
    "grep_counts": f"SELECT path, count(*) AS lines FROM ({_LINES}) WHERE regexp_matches(line, '{PATTERN}') GROUP BY path",
    "grep_context": f"WITH l AS ({_LINES}), m AS (SELECT path, line_no FROM l WHERE regexp_matches(line, '{PATTERN}')), s AS (SELECT l.path, l.line_no, regexp_matches(l.line, '{PATTERN}') AS is_match FROM l SEMI JOIN m ON l.path = m.path AND l.line_no BETWEEN m.line_no - 1 AND m.line_no + 2) SELECT path, line_no, is_match, coalesce(line_no - lag(line_no) OVER (PARTITION BY path ORDER BY line_no) > 1, false) AS breaks FROM s",
    "grep_files": "SELECT rel_path, count(*) AS n FROM fingerprints WHERE regexp_matches(rel_path, '^ucr-title-2[^/]*/.*$') AND NOT regexp_matches(rel_path, '^[^/]*0/[^/]*\\.md$') AND NOT regexp_matches(rel_path, '^(.*/)?7\\.md$') GROUP BY rel_path",
    "grep_bounded": f"SELECT path, count(*) AS lines FROM ({_LINES}) WHERE contains(line, 'kiln') GROUP BY path",
    "gram_candidates": "SELECT doc_id AS path FROM documents WHERE " + " OR ".join("(" + " AND ".join(f"contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{g}')" for g in sorted({x[i : i + 4] for x in opt for i in range(len(x) - 3)})) + ")" for opt in (["hydraulic ", "boiler"], ["hydraulic ", "crane"])),
    "grep_indexed": f"SELECT path, line_no, line FROM ({_LINES}) WHERE regexp_matches(line, '{PATTERN}')",
    "gram_pairs": "SELECT pair, n, CAST(row_number() OVER (ORDER BY n DESC, pair) AS INTEGER) AS rarity FROM (SELECT substr(h, 2 * i - 1, 4) AS pair, count(*) AS n FROM (SELECT h, unnest(range(1, len(h) // 2)) AS i FROM (SELECT hex(encode(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS h FROM documents WHERE text IS NOT NULL)) GROUP BY 1)",
    "id_tokens": "SELECT id, array_to_string(list_filter([low, native, CASE WHEN last <> native THEN last END], lambda x: x <> ''), '|') AS parts FROM (SELECT id, lower(id) AS low, regexp_replace(lower(id), '^[^:]*:', '') AS native, regexp_replace(regexp_replace(lower(id), '^[^:]*:', ''), '^[^-]*-', '') AS last FROM (SELECT DISTINCT id FROM sections WHERE id IS NOT NULL))",
    "slugs": "SELECT title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT DISTINCT title FROM sections)",
    "citation_tokens": r"SELECT rel_path, loaded_at, coalesce((SELECT string_agg(x, '|' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(regexp_extract_all(s.body, '§+\s*([0-9]+\.[0-9]+)', 1)) AS x, generate_subscripts(regexp_extract_all(s.body, '§+\s*([0-9]+\.[0-9]+)', 1), 1) AS i) GROUP BY x)), '') AS cites FROM sections s WHERE body IS NOT NULL",
    "cited_sections": r"SELECT cite, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '§+\s*([0-9]+\.[0-9]+)', 1)) AS cite FROM documents) GROUP BY cite",
    "token_jaccard": f"WITH v AS ({_VERSIONS}), p AS (SELECT id, effective, {_SET} AS now, lag({_SET}) OVER (PARTITION BY id ORDER BY effective NULLS FIRST) AS prev FROM v) SELECT id, strftime(effective, '%Y-%m-%d') AS effective, CASE WHEN len(now) + len(prev) = 0 THEN 0 ELSE round(len(list_intersect(now, prev)) / (len(now) + len(prev) - len(list_intersect(now, prev))), 6) END AS jaccard, CASE WHEN least(len(now), len(prev)) = 0 THEN 0 ELSE round(len(list_intersect(now, prev)) / least(len(now), len(prev)), 6) END AS overlap FROM p WHERE prev IS NOT NULL",
    "levenshtein_sim": "WITH v AS (SELECT id, effective, arg_max(title, loaded_at) AS title FROM sections WHERE id IS NOT NULL GROUP BY id, effective), p AS (SELECT id, effective, title AS a, lag(title) OVER (PARTITION BY id ORDER BY effective NULLS FIRST) AS b FROM v) SELECT id, coalesce(strftime(effective, '%Y-%m-%d'), '') AS effective, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM p WHERE a <> b",
    "run_containment": f"SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || array_to_string({_TOK.format(x='text')}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL) d, (SELECT item_id, array_to_string({_TOK.format(x='text')}, ' ') AS r FROM eval_items) e WHERE r <> '' AND contains(t, ' ' || r || ' ')",
    "retrieval_metrics": f"""WITH i AS (SELECT item_id, {_TOK.format(x='text')} AS t FROM eval_items), d AS (SELECT doc_id, {_TOK.format(x='text')} AS t FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, unnest(t) AS w FROM i), dw AS (SELECT DISTINCT doc_id, unnest(t) AS w FROM d),
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rank FROM iw JOIN dw USING (w) GROUP BY 1, 2),
ir AS (SELECT DISTINCT item_id, array_to_string(t[k:k + 7], ' ') AS run FROM (SELECT item_id, t, unnest(range(1, len(t) - 6)) AS k FROM i)), dr AS (SELECT DISTINCT doc_id, array_to_string(t[k:k + 7], ' ') AS run FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS k FROM d)),
rel AS (SELECT DISTINCT item_id, doc_id FROM ir JOIN dr USING (run)), w AS (SELECT item_id, count(*) AS wanted FROM rel GROUP BY 1),
h AS (SELECT item_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM r JOIN rel USING (item_id, doc_id) WHERE rank <= 10 GROUP BY 1)
SELECT w.item_id, round(coalesce(hits / wanted, 0), 6) AS recall, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(wanted, 10) + 1) t(i)), 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr FROM w LEFT JOIN h ON h.item_id = w.item_id""",
}
