"""Citations to ids by the registry's patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import ship


@dataclass(frozen=True)
class Pattern:
    """How one source cites: a pattern with named groups, the id it stands for, and whether it names its source itself."""

    source: str
    pattern: str
    template: str
    explicit: bool = True
    anchor: str = "paras"


#: Patterns of the test corpus: ``UCR 12-40.7(b)``, ``HB AM-3``, and bare ``§ 40.7`` for the home title.
DEFAULT = (
    Pattern("ucr", r"\bUCR\s*:?\s*(?P<title>\d+)-(?P<num>\d+(?:\.\d+)?)(?P<paras>(?:\([a-z0-9]{1,4}\))*)", "UCR:{title}-{num}"),
    Pattern("harbour", r"\b(?:HB\s*:?\s*)?AM-(?P<num>\d+)(?P<paras>(?:\([a-z0-9]{1,4}\))*)", "HB:AM-{num}"),
    Pattern("ucr", r"§+\s*(?P<num>\d+\.\d+)(?P<paras>(?:\([a-z0-9]{1,4}\))*)", "UCR:{home}-{num}", explicit=False),
)


def all_in(text: str, home: str | None, patterns: tuple[Pattern, ...] = DEFAULT) -> list[tuple[int, int, str, str, str]]:
    """(start, end, cited, id, anchor) in order of offset; a bare citation counts only with a home title, and not where an
    explicit one covers it, nor after ``of title N`` of another."""
    out: list[tuple[int, int, str, str, str]] = []
    for p in sorted(patterns, key=lambda p: not p.explicit):
        for m in re.finditer(p.pattern, text):
            g = {k: v or "" for k, v in m.groupdict().items()}
            title = home
            if not p.explicit:
                other = re.match(r"(?:\([a-z0-9]+\))*\s+of\s+title\s+(\d+)", text[m.end() :], re.I)
                title = other.group(1) if other else home
                if not title or any(a < m.end() and m.start() < b for a, b, *_ in out):
                    continue
            anchor = "-".join(re.findall(r"\(([a-z0-9]+)\)", g.get(p.anchor, "")))
            out.append((m.start(), m.end(), m.group(), p.template.format(home=title, **g), anchor))
    return sorted(set(out))


def whole(text: str, patterns: tuple[Pattern, ...] = DEFAULT) -> tuple[str, str] | None:
    """(id, anchor) if the text is nothing but one explicit citation."""
    for p in patterns:
        m = re.fullmatch(p.pattern, text.strip()) if p.explicit else None
        if m:
            g = {k: v or "" for k, v in m.groupdict().items()}
            return p.template.format(**g), "-".join(re.findall(r"\(([a-z0-9]+)\)", g.get(p.anchor, "")))
    return None


def linked(text: str, targets: dict[str, str]) -> str:
    """The first bare occurrence of each reference as a link, longest first, never inside another link."""
    done: list[tuple[int, int]] = [(m.start(), m.end()) for m in re.finditer(r"\[[^\]]*\]\([^)]*\)", text)]
    edits = []
    for ref in sorted(targets, key=lambda r: (-len(r), r)):
        for m in re.finditer(re.escape(ref) + r"(?![\w(.]\w?)", text):
            if not any(a < m.end() and m.start() < b for a, b in done):
                done.append((m.start(), m.end()))
                edits.append((m.start(), m.end(), f"[{ref}]({targets[ref]})"))
                break
    for a, b, new in sorted(edits, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def found(rows: DataFrame, key: str, text: str, home: str, patterns: tuple[Pattern, ...] = DEFAULT) -> DataFrame:
    """(key, start, cited, id, anchor) of all citations; ``home`` is a column with the home title (null: none)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, a, cited, i, anchor) for k, t, h in zip(pdf["key"], pdf["text"], pdf["home"]) if isinstance(t, str) for a, _, cited, i, anchor in all_in(t, h if isinstance(h, str) else None, patterns)]
            yield pd.DataFrame(out, columns=["key", "start", "cited", "id", "anchor"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(home).cast("string").alias("home")).mapInPandas(run, f"key {kind}, start int, cited string, id string, anchor string")


def candidate_ids(refs: DataFrame, works: DataFrame, most: int = 8) -> DataFrame:
    """(key, cited, id, position): works that a reference may mean, by its exact id, then by the same number in the home
    source, then in any; the best ``most``."""
    from pyspark.sql import Window

    number = lambda x: F.regexp_extract(x, r"-([0-9.]+)$", 1)
    w = works.select(F.col("id").alias("work"), F.col("source_name").alias("in_source"), number(F.col("id")).alias("num"))
    r = refs.withColumn("num", number(F.col("id")))
    exact = r.join(w, r["id"] == w["work"]).select("key", "cited", "work", F.lit(0).alias("how"))
    near = r.join(w.where("num <> ''"), "num").select("key", "cited", "work", F.when(F.col("in_source") == F.col("source_name"), 1).otherwise(2).alias("how"))
    best = exact.unionByName(near).groupBy("key", "cited", "work").agg(F.min("how").alias("how"))
    at = Window.partitionBy("key", "cited").orderBy("how", "work")
    return best.withColumn("position", F.row_number().over(at).cast("int")).where(F.col("position") <= most).select("key", "cited", F.col("work").alias("id"), "how", "position")


def resolved(candidates: DataFrame) -> DataFrame:
    """(key, cited, id): references with exactly one candidate of their best kind."""
    best = candidates.groupBy("key", "cited").agg(F.min("how").alias("how"))
    one = candidates.join(best, ["key", "cited", "how"]).groupBy("key", "cited").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return one.where("n = 1").select("key", "cited", "id")
