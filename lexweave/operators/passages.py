"""Passages of section bodies, and the peers that are short enough to be read as one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import anchors
from lexweave.session import ship

WORD = re.compile(r"\S+")
PARAGRAPH, SENTENCE = re.compile(r"\n[ \t]*\n\s*|\n(?=\|)"), re.compile(r"[.!?][\"')\]]*\s+")


def check_policy(target: int, most: int) -> None:
    if not 64 <= target <= most <= 8192:
        raise ValueError("a passage policy needs 64 <= target <= max <= 8192")


def spans(body: str, target: int, most: int) -> list[tuple[int, int, bool]]:
    """(start, end, fallback): contiguous passages that cover the body, none over ``most`` words.

    A passage ends at the first paragraph (or table row) boundary at or after ``target`` words; else at the last sentence
    end within ``most``; else at the last white space, which counts as a fallback.
    """
    words = [(m.start(), m.end()) for m in WORD.finditer(body)]
    ends = {m.end() for m in PARAGRAPH.finditer(body)}
    stops = {m.end() for m in SENTENCE.finditer(body)}
    out, i, start = [], 0, 0
    while i < len(words):
        if len(words) - i <= most and len(words) - i < 2 * target:
            out.append((start, len(body), False))
            return out
        limit = min(i + most, len(words))
        cut = lambda j: words[j][0] if j < len(words) else len(body)
        by_paragraph = next((j for j in range(i + target, limit + 1) if cut(j) in ends or j == len(words)), None)
        by_sentence = next((j for j in range(limit, i, -1) if cut(j) in stops), None) if by_paragraph is None else None
        j = by_paragraph or by_sentence or limit
        out.append((start, cut(j), by_paragraph is None and by_sentence is None))
        start, i = cut(j), j
    return out or ([(0, len(body), False)] if body else [])


PASSAGES = "key string, part int, nparts int, start_at int, end_at int, words int, fallback boolean, body string"


def passages(rows: DataFrame, key: str, text: str, target: int = 256, most: int = 400) -> DataFrame:
    """Passages of every body: key, part of nparts, offsets in code points, words, fallback, body. Null and empty bodies
    give none."""
    check_policy(target, most)
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, body in zip(pdf["key"], pdf["text"]):
                if isinstance(body, str) and body:
                    cut = spans(body, target, most)
                    out += [(k, n, len(cut), a, b, len(body[a:b].split()), f, body[a:b]) for n, (a, b, f) in enumerate(cut)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PASSAGES.split(", ")])

    return rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, PASSAGES)


def merged_peers(units: DataFrame, group: str, order: str, words: str, target: int, most: int) -> DataFrame:
    """(group, order, passage): neighbouring units packed while the passage before is below target and the sum fits.

    A sequential fold, but over rows sorted by the shuffle, with one running sum per group in memory.
    """
    ship(units.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, size = object(), 0, 0
        for pdf in batches:
            numbers = []
            for g, w in zip(pdf["g"], pdf["w"]):
                if g != now:
                    now, n, size = g, 0, 0
                elif size >= target or size + w > most:
                    n, size = n + 1, 0
                size += w
                numbers.append(n)
            yield pdf.assign(passage=pd.array(numbers, dtype="int32"))[["g", "o", "passage"]]

    rows = units.select(F.col(group).cast("string").alias("g"), F.col(order).cast("bigint").alias("o"), F.coalesce(words, F.lit(0)).cast("bigint").alias("w"))
    out = rows.repartition("g").sortWithinPartitions("g", "o").mapInPandas(run, "g string, o bigint, passage int")
    return out.select(F.col("g").alias(group), F.col("o").alias(order), "passage")


def anchors_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, anchor, line) of the labelled paragraphs of every body."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, a, n) for k, t in zip(pdf["key"], pdf["text"]) if isinstance(t, str) for a, n in anchors.paragraph_anchors(t)]
            yield pd.DataFrame(out, columns=["key", "anchor", "line"])

    return rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, anchor string, line int")


def tables_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, line, row, flat): every row of every pipe table as ``Header: cell; ...``."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"]):
                if isinstance(t, str) and "|" in t:
                    for i, tab in enumerate(anchors.gfm_tables(t)):
                        out += [(k, i, tab["line"], r, "; ".join(f"{h}: {c}" for h, c in zip(tab["header"], row))) for r, row in enumerate(tab["rows"])]
            yield pd.DataFrame(out, columns=["key", "table", "line", "row", "flat"])

    return rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, table int, line int, row int, flat string")


def packed_windows(rows: DataFrame, group: str, order: str, text: str, most: int = 6000) -> DataFrame:
    """(group, window, first, last, chars, text): neighbouring regions packed greedily into windows of at most ``most``
    characters; a longer region is a window of its own. Streams over the sorted rows, one window in memory."""
    ship(rows.sparkSession)
    columns = [group, "window", "first", "last", "chars", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, held, size, first, last = None, 0, [], 0, 0, 0
        for pdf in batches:
            out = []
            for g, o, t in zip(pdf["g"], pdf["o"], pdf["t"]):
                if held and (g != now or size + 1 + len(t) > most):
                    out.append((now, n, first, last, size, "\n".join(held)))
                    n, held, size = n + 1, [], 0
                if g != now:
                    now, n = g, 0
                if not held:
                    first = o
                size += len(t) + (1 if held else 0)
                held.append(t)
                last = o
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(now, n, first, last, size, "\n".join(held))], columns=columns)

    data = rows.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(order).cast("bigint").alias("o"), F.col(text).alias("t"))
    return data.repartition("g").sortWithinPartitions("g", "o").mapInPandas(run, f"`{group}` string, window int, first bigint, last bigint, chars int, text string")
