"""Defined terms: finding, counting and resolving them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.session import ship

#: A term is one to six words before the defining verb, at the start of a line (after its label).
DEFINING = r"(?m)^(?:\([a-z0-9]{1,4}\)\s*)*\*?([A-Z][\p{L}\p{N}-]*(?: [\p{L}\p{N}-]+){0,5}?)\*?,? (?:means|shall mean|is defined as|includes|refers to) "


def found(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, term, slug): terms a text defines, each slug once per text (its first spelling by order of letters)."""
    terms = F.regexp_extract_all(F.col(text), F.lit(DEFINING), 1)
    each = rows.where(F.col(text).isNotNull()).select(*keys, F.explode(terms).alias("term"))
    return each.withColumn("slug", T.slug("term")).where("slug <> ''").groupBy(*keys, "slug").agg(F.min("term").alias("term"))


def usages(rows: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, slug, n): how often each text uses each term; longer terms first, words whole, a plural s allowed.

    ``terms`` is the glossary asked for (a bounded list the caller gives): one alternation is compiled per partition, so a
    text is read once whatever the number of terms.
    """
    ship(rows.sparkSession)
    ordered = sorted({t.lower() for t in terms if t.strip()}, key=lambda t: (-len(t), t))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, ordered)) + r")s?(?!\w)") if ordered else None
        for pdf in batches:
            out = []
            if pattern is not None:
                for k, t in zip(pdf["key"], pdf["text"]):
                    if isinstance(t, str):
                        out += [(k, m) for m in pattern.findall(t.lower())]
            yield pd.DataFrame(out, columns=["key", "term"])

    kind = rows.schema[key].dataType.simpleString()
    hits = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, term string")
    return hits.groupBy(F.col("key").alias(key), T.slug("term").alias("slug")).agg(F.count("*").alias("n"))


def resolve(asked: DataFrame, defined: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, slug, owner, distance, ambiguous): the nearest definition of a slug as seen from a work.

    Distance 0 is the work itself, then its ancestors; among those only the nearest counts, several at one distance are
    ambiguous. ``asked`` (id, slug), ``defined`` (id, slug), ``closure`` (ancestor, id, distance).
    """
    up = closure.select("id", "ancestor", "distance").unionByName(asked.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).distinct())
    hits = asked.join(up, "id").join(defined.select(F.col("id").alias("ancestor"), "slug").distinct(), ["ancestor", "slug"])
    best = hits.groupBy("id", "slug").agg(F.min("distance").alias("distance"))
    near = hits.join(best, ["id", "slug", "distance"]).groupBy("id", "slug", "distance")
    return near.agg(F.min("ancestor").alias("owner"), (F.countDistinct("ancestor") > 1).alias("ambiguous")).select("id", "slug", "owner", "distance", "ambiguous")
