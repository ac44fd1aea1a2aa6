"""Exhaustive exact search with a gram prefilter."""

from __future__ import annotations

import re
from re import _parser as sre  # the query's own syntax tree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.names import c


def pattern_of(patterns: list[str], fixed: bool = False, word: bool = False, ignore_case: bool = False) -> str:
    """One expression for a list of patterns: literal, whole-word and case-blind as asked."""
    parts = [re.escape(p) if fixed else p for p in patterns]
    joined = "|".join(f"(?:{p})" for p in parts)
    if word:
        joined = rf"(?<![\p{{L}}\p{{N}}_])(?:{joined})(?![\p{{L}}\p{{N}}_])"
    return f"(?iu){joined}" if ignore_case else joined


def numbered_lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line_no, line) of all lines; a file with a NUL is binary and has none."""
    rows = files.where(c(text).isNotNull() & ~F.contains(c(text), F.lit("\0")))
    return rows.select(F.col(path).alias("path"), F.posexplode(T.lines(text)).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def matches(files: DataFrame, path: str, text: str, pattern: str) -> DataFrame:
    """(path, line_no, line) of the matching lines (lines, not occurrences). Files are tested whole before they are cut."""
    return numbered_lines(files.where(c(text).rlike(f"(?m){pattern}")), path, text).where(F.col("line").rlike(pattern))


def counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.count("*").alias("lines"))


def with_context(files: DataFrame, path: str, text: str, pattern: str, before: int, after: int) -> DataFrame:
    """(path, line_no, line, is_match, breaks): matches with lines around them; breaks marks a gap before a line."""
    flagged = numbered_lines(files.where(c(text).rlike(f"(?m){pattern}")), path, text).withColumn("is_match", F.col("line").rlike(pattern))
    around = Window.partitionBy("path").orderBy("line_no")
    near = F.max("is_match").over(around.rowsBetween(-after, before))
    shown = flagged.withColumn("near", near).where("near").drop("near")
    gap = F.col("line_no") - F.lag("line_no").over(around)
    return shown.withColumn("breaks", F.coalesce(gap > 1, F.lit(False)))


def bounded(hits: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame, bool]:
    """(lines, counts, cut): above ``most`` matching lines no line is shown, only the counts per file."""
    per_file = counts(hits)
    total = per_file.agg(F.sum("lines")).first()[0] or 0
    return (hits.limit(0) if total > most else hits), per_file, total > most


def glob_pattern(glob: str) -> str:
    """A path glob as an expression; ``**`` crosses directories, ``*`` and ``?`` do not."""
    out = ""
    i = 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$" if "/" in glob else f"^(?:.*/)?{out}$"


def selected_paths(path: str | Column, globs: list[str]) -> Column:
    """Later globs win; ``!`` excludes; with only exclusions the rest is in."""
    keep = F.lit(all(g.startswith("!") for g in globs))
    for g in globs:
        hit = c(path).rlike(glob_pattern(g.lstrip("!")))
        keep = F.when(hit, F.lit(not g.startswith("!"))).otherwise(keep)
    return keep


# ---- gram prefilter: which files can hold a literal at all


def pair_weights(files: DataFrame, text: str) -> DataFrame:
    """(pair, n, rarity): pairs of UTF-8 bytes (in hex) of all texts, ASCII letters small; rarity 1 is the most frequent.

    There are at most 65,536 pairs, so the one window over them is bounded.
    """
    pairs = files.select(F.explode(F.regexp_extract_all(F.hex(F.encode(_small(text), "UTF-8")), F.lit("(?=(....)).."), 1)).alias("pair"))
    counted = pairs.groupBy("pair").agg(F.count("*").alias("n"))
    return counted.withColumn("rarity", F.row_number().over(Window.orderBy(F.desc("n"), "pair")).cast("int"))


def _small(x: str | Column) -> Column:
    """Small ASCII letters; all else as it is."""
    return F.translate(c(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(x: str | Column, n: int = 4) -> Column:
    """Distinct n-grams of the text, found in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(_small(x), F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def gram_index(files: DataFrame, path: str, text: str) -> DataFrame:
    """(gram, path) postings, one row each."""
    return files.select(F.explode(grams(text)).alias("gram"), F.col(path).alias("path"))


def required_literals(pattern: str, least: int = 4) -> list[list[str]] | None:
    """Literals every match must hold: a list of alternatives, each a list of literals all needed; None if there are none.

    Only what the syntax tree proves is used, so the prefilter can never lose a match.
    """
    try:
        tree = sre.parse(pattern)
    except re.error:
        return None

    def needed(items) -> list[list[str]] | None:
        runs, run, options = [], "", [[]]
        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            runs.append(run)
            run = ""
            inner = None
            if op is sre.SUBPATTERN:
                inner = needed(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                inner = needed(arg[2])
            elif op is sre.BRANCH:
                parts = [needed(p) for p in arg[1]]
                inner = None if any(p is None for p in parts) else [x for p in parts for x in p]
            if inner and len(options) * len(inner) <= 64:
                options = [a + b for a in options for b in inner]
        runs.append(run)
        own = [r.lower() for r in runs if len(r) >= least and r.isascii()]
        out = [own + o for o in options]
        return out if all(out) else None

    return needed(tree)


def candidates(index: DataFrame, literals: list[list[str]]) -> DataFrame:
    """Paths that hold all grams of one alternative at least: an aggregate over the query's postings only."""
    out = None
    for option in literals:
        wanted = sorted({lit[i : i + 4] for lit in option for i in range(len(lit) - 3)})
        paths = index.where(F.col("gram").isin(wanted)).groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("path")
        out = paths if out is None else out.unionByName(paths)
    return out.distinct()


def indexed_matches(files: DataFrame, index: DataFrame, path: str, text: str, pattern: str) -> DataFrame:
    """Same rows as ``matches``, over the candidate files only (all files if nothing can be proved)."""
    literals = required_literals(pattern)
    if literals is None:
        return matches(files, path, text, pattern)
    few = files.join(candidates(index, literals).withColumnRenamed("path", path), path, "left_semi")
    return matches(few, path, text, pattern)


def line_anchor(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """As-of join: each hit (path, line_no) with the last anchor (path, line_no, anchor) at or above it."""
    both = hits.select("path", "line_no", "line", F.lit(None).cast("string").alias("anchor"), F.lit(1).alias("side")).unionByName(
        anchors.select("path", "line_no", F.lit(None).cast("string").alias("line"), "anchor", F.lit(0).alias("side"))
    )
    sofar = Window.partitionBy("path").orderBy("line_no", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("anchor", F.last("anchor", ignorenulls=True).over(sofar)).where("side = 1").select("path", "line_no", "line", "anchor")
