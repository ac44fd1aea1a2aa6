"""A stored search index: term postings and gram postings in segments, kept up with the corpus by rewriting what changed
(SURVEY VB8, I5, I6, A7, A8, A10, SO4).

An update writes one segment with the postings of new and changed texts, and their (key, digest, segment) to the log of
documents. Postings whose (key, segment) is not the current one are dead and read past until ``compact``. Postings are
partitioned by a hash of their term and sorted within, so a query reads the partitions and row groups of its own terms.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.names import c
from lexweave.operators import grep
from lexweave.operators.ranking import K1, B, query_terms
from lexweave.session import fs_of, put_if_absent, read_text, remove, staged
from lexweave.streaming.upserts import Upserts

ROWS_PER_BUCKET = 2_000_000


class SearchIndex:
    """``fields`` are ranked, each with its own statistics; ``grams_of`` is the field whose grams prefilter exact search."""

    def __init__(self, spark: SparkSession, root: str, key: str, fields: list[str], grams_of: str | None = None):
        self.spark, self.root, self.key, self.fields, self.grams_of = spark, root.rstrip("/"), key, fields, grams_of
        self.documents = Upserts(spark, f"{self.root}/documents", [key])

    # ---- what is there

    def segments(self) -> list[dict]:
        """Published segments in order: number, buckets, documents, total lengths of the index up to them."""
        fs, p = fs_of(self.spark, f"{self.root}/_segments")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        return [json.loads(read_text(self.spark, f"{self.root}/_segments/{n}")) for n in names if n.isdigit()]

    def _current(self) -> DataFrame | None:
        done = self.segments()
        rows = self.documents.current(before=done[-1]["number"] + 1) if done else None
        return None if rows is None else rows.where("NOT tombstone")

    # ---- building

    def update(self, docs: DataFrame, complete: bool = True) -> int:
        """Bring the index up to ``docs``: the number of texts written. Of rows with one key the greatest counts; rows without
        a key are left out.

        Unchanged texts are not read into postings again; with nothing new nothing is published. Keys missing from a
        ``complete`` corpus are deleted. Of two updates at a time one fails and is repeated.
        """
        done = self.segments()
        number = done[-1]["number"] + 1 if done else 0
        columns = list(dict.fromkeys([*self.fields, *([self.grams_of] if self.grams_of else [])]))
        rows = docs.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*columns)).alias("_row")).select(self.key, *(F.col("_row")[x].alias(x) for x in columns))
        rows = rows.withColumn("digest", F.xxhash64(*columns))
        held = self._current()
        if held is not None:
            fresh = rows.join(held.select(self.key, "digest"), [self.key, "digest"], "left_anti")
            gone = held.select(self.key).join(rows.select(self.key), self.key, "left_anti") if complete else None
        else:
            fresh, gone = rows, None
        fresh = staged(fresh, "fresh") if held is not None else fresh
        spaced = {f: F.filter(F.split(F.lower(F.coalesce(c(f), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "") for f in self.fields}
        tokened = fresh.select(self.key, *(spaced[f].alias(f"t_{i}") for i, f in enumerate(self.fields)), *([grep.grams(self.grams_of).alias("grams")] if self.grams_of else []), "digest")
        lengths = [F.size(f"t_{i}").alias(f"len_{i}") for i in range(len(self.fields))]
        log = tokened.select(self.key, "digest", *lengths, F.lit(False).alias("tombstone"), F.lit(number).cast("bigint").alias("sequence"))
        if gone is not None:
            log = log.unionByName(gone.withColumn("tombstone", F.lit(True)).withColumn("sequence", F.lit(number).cast("bigint")), allowMissingColumns=True)
        self.documents.write(log, number)
        written = self.spark.read.parquet(f"{self.documents.root}/batch={number}").agg(F.count("*").alias("n"), F.count_if(~F.col("tombstone")).alias("live")).first()
        if held is not None and written["n"] == 0:
            return 0
        one = lambda i: tokened.select(self.key, F.lit(i).alias("field"), F.size(f"t_{i}").alias("len"), F.explode(f"t_{i}").alias("term"))
        terms = one(0)
        for i in range(1, len(self.fields)):
            terms = terms.unionByName(one(i))
        postings = terms.groupBy("field", "term", self.key).agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"))
        rows_at_most = written["live"] * 100 * len(self.fields)
        buckets = max(1, min(4096, rows_at_most // ROWS_PER_BUCKET))
        self._write(postings, "term", buckets, number, "postings")
        if self.grams_of:
            self._write(tokened.select(self.key, F.explode("grams").alias("gram")), "gram", buckets, number, "grams")
        now = self.documents.current(before=number + 1).where("NOT tombstone")
        sums = now.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"len_{i}"), F.lit(0)).alias(f"len_{i}") for i in range(len(self.fields)))).first()
        segment = {"number": number, "buckets": buckets, "documents": sums["n"], "lengths": [sums[f"len_{i}"] for i in range(len(self.fields))]}
        if not put_if_absent(self.spark, f"{self.root}/_segments/{number:012d}", json.dumps(segment)):
            raise RuntimeError(f"segment {number} was published by another update")
        return int(written["live"])

    def _write(self, rows: DataFrame, term: str, buckets: int, number: int, layer: str) -> None:
        """A hot term's postings are spread over tasks by their key, and its bucket's files over them."""
        bucket = F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
        rows = rows.withColumn("bucket", bucket)
        if buckets > 1:
            rows = rows.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(8)))
        rows.sortWithinPartitions("bucket", term).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{layer}/segment={number}")

    def compact(self, docs: DataFrame) -> None:
        """Write the index of ``docs`` anew as one segment above all others, and drop those."""
        old = self.segments()
        fresh = SearchIndex(self.spark, f"{self.root}/compacted-{len(old)}", self.key, self.fields, self.grams_of)
        fresh.update(docs)
        for name in ("documents", "postings", "grams", "_segments"):
            fs, target = fs_of(self.spark, f"{self.root}/{name}")
            fs.delete(target, True)
            _, source = fs_of(self.spark, f"{fresh.root}/{name}")
            if fs.exists(source):
                fs.rename(source, target)
        remove(self.spark, fresh.root)

    # ---- asking

    def _read(self, layer: str, term: str, wanted: list[str]) -> DataFrame | None:
        """Live rows of the wanted terms."""
        done, out = self.segments(), None
        for s in done:
            path = f"{self.root}/{layer}/segment={s['number']}"
            fs, p = fs_of(self.spark, path)
            if not fs.exists(p) or not any(x.getPath().getName().startswith("bucket=") for x in fs.listStatus(p)):
                continue
            rows = self.spark.read.parquet(path)
            at = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(s["buckets"])).cast("int") for w in wanted)))).collect()] if s["buckets"] > 1 else [0]
            rows = rows.where(F.col("bucket").isin(at) & F.col(term).isin(wanted)).drop("bucket")
            if len(done) > 1:
                rows = rows.withColumn("sequence", F.lit(s["number"]).cast("bigint"))
            out = rows if out is None else out.unionByName(rows)
        if out is not None and len(done) > 1:
            out = out.join(self._current().select(self.key, "sequence"), [self.key, "sequence"], "left_semi").drop("sequence")
        return out

    def bm25(self, query: str, boosts: dict[str, float] | None = None) -> DataFrame:
        """(key, score) of the texts with a query term: as ``ranking.bm25`` over the whole corpus, from the query's postings."""
        terms = list(dict.fromkeys(query_terms(query)))
        done = self.segments()
        rows = self._read("postings", "term", terms) if terms and done else None
        if rows is None:
            return self.spark.createDataFrame([], f"{self.key} string, score double")
        n, totals = done[-1]["documents"], done[-1]["lengths"]
        weights = boosts or dict.fromkeys(self.fields, 1.0)
        row = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("field") + 1)
        # The query's own statistics are few rows: one per field and term.
        df = rows.groupBy("field", "term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / row([max(t / n, 1e-9) if n else 1.0 for t in totals])))
        each = rows.join(F.broadcast(df), ["field", "term"]).select(self.key, (row([weights.get(f, 0.0) for f in self.fields]) * idf * norm).alias("part"))
        return each.groupBy(self.key).agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")

    def candidates(self, literals: list[list[str]]) -> DataFrame:
        """(path) of the texts that hold all grams of one of the alternatives (``grep.required_literals``)."""
        out = None
        for option in literals:
            wanted = sorted({lit[i : i + 4] for lit in option for i in range(len(lit) - 3)})
            rows = self._read("grams", "gram", wanted)
            if rows is None:
                return self.spark.createDataFrame([], "path string")
            paths = rows.groupBy(F.col(self.key).alias("path")).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("path")
            out = paths if out is None else out.unionByName(paths)
        return out.distinct()

    def matches(self, docs: DataFrame, pattern: str) -> DataFrame:
        """As ``grep.matches``, over the candidates only (all texts if the pattern proves nothing)."""
        literals = grep.required_literals(pattern)
        if literals is None or not self.grams_of:
            return grep.matches(docs, self.key, self.grams_of or self.fields[0], pattern)
        few = docs.join(self.candidates(literals).withColumnRenamed("path", self.key), self.key, "left_semi")
        return grep.matches(few, self.key, self.grams_of, pattern)
