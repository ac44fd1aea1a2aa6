"""Order-sensitive matching of texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import ship


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) of one longest common subsequence; rows are computed with array operations.

    Only every sqrt(n)-th row is kept, and those between are computed again on the way back, so two texts of 100,000 words need
    some 250 MB, not 40 GB.
    """
    if not a or not b:
        return []
    code: dict = {}
    x = np.array([code.setdefault(t, len(code)) for t in a])
    y = np.array([code.setdefault(t, len(code)) for t in b])
    step = int(len(x) ** 0.5) + 1

    def after(row: np.ndarray, i: int) -> np.ndarray:
        new = np.empty_like(row)
        new[0] = 0
        np.maximum.accumulate(np.where(y == x[i], row[:-1] + 1, row[1:]), out=new[1:])
        return new

    row, kept = np.zeros(len(y) + 1, np.int32), []
    for i in range(len(x)):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    out, i, j = [], len(x), len(y)
    for block in range(len(kept) - 1, -1, -1):
        first = block * step
        rows = [kept[block]]
        for k in range(first, i):
            rows.append(after(rows[-1], k))
        while i > first and j:
            here, above = rows[i - first], rows[i - first - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        if not j:
            break
    return out[::-1]


def span_score(needle: list, hay: list) -> tuple[float, int, int]:
    """(score, start, end) of the hay's span that holds the needle best: 2 lcs / (needle + span)."""
    pairs = lcs(needle, hay)
    if not pairs:
        return 0.0, 0, 0
    at = [j for _, j in pairs]
    best = (0.0, 0, 0)
    for lo in range(len(at)):
        # a span gains by each match and loses by each word; ends only matter at matches
        for hi in range(len(at) - 1, lo - 1, -1):
            score = 2 * (hi - lo + 1) / (len(needle) + at[hi] - at[lo] + 1)
            if score > best[0]:
                best = (score, at[lo], at[hi] + 1)
            if 2 * (hi - lo + 1) / (len(needle) + hi - lo + 1) <= best[0]:
                break
    return best


def best_window(needle: list, hay: list) -> tuple[int, int, int]:
    """(start, end, hits): the window of three times the needle's length with most of its words (as a multiset)."""
    size = min(len(hay), 3 * len(needle))
    want, have, hits, best = Counter(needle), Counter(), 0, (0, size, 0)
    for j, t in enumerate(hay):
        have[t] += 1
        hits += have[t] <= want[t]
        if j >= size:
            old = hay[j - size]
            hits -= have[old] <= want[old]
            have[old] -= 1
        if hits > best[2]:
            best = (max(0, j - size + 1), j + 1, hits)
    return best


def similar(a: str, b: str) -> float:
    """1 - edit distance / greater length."""
    if not a and not b:
        return 1.0
    y = np.frombuffer(b.encode("utf-32-le"), np.int32)
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, ch in enumerate(np.frombuffer(a.encode("utf-32-le"), np.int32), 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != ch))
        row = np.minimum.accumulate(np.append(i, new) - steps) + steps
    return 1 - int(row[-1]) / max(len(a), len(b))


def aligned_lines(first: list[str], second: list[str], least: float = 0.8) -> list[tuple[int | None, int | None]]:
    """Lines of two readings side by side, in both orders at once; unlike lines stand alone."""
    n, m = len(first), len(second)
    like = [[similar(a, b) >= least for b in second] for a in first]
    rows = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            rows[i][j] = max(rows[i + 1][j], rows[i][j + 1], rows[i + 1][j + 1] + 1 if like[i][j] else 0)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and like[i][j] and rows[i][j] == rows[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif i < n and (j == m or rows[i + 1][j] >= rows[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def merged_readings(first: list[str], second: list[str]) -> list[tuple[str, str]]:
    """(line, flag) of two transcriptions: '' where they agree, divergent where they differ, secondary_only for lines that
    only the second has."""
    out = []
    for i, j in aligned_lines(first, second):
        if i is None:
            out.append((second[j], "secondary_only"))
        else:
            out.append((first[i], "" if j is not None and first[i].split() == second[j].split() else "divergent"))
    return out


def consensus_lines(readings: list[list[str]], least: float = 0.9) -> list[str]:
    """Lines of the first reading that every other one holds nearly letter by letter."""
    return [x for x in readings[0] if all(any(similar(x, y) >= least for y in r) for r in readings[1:])]


def dual_reading(first: str, second: str) -> list[tuple[str, str]]:
    """(line, flag) of a page read twice: the merged readings; the first alone if the second has not half to one and a half
    times its words or got stuck; the second alone if only the first got stuck (its lines are then ``secondary_only``)."""
    rows = lambda t: [x.strip() for x in t.splitlines() if x.strip()]
    a, b = rows(first), rows(second)

    def stuck(lines: list[str]) -> bool:
        return len(lines) >= 20 and max(Counter(lines).values()) >= 8 and len(set(lines)) / len(lines) < 0.5

    if stuck(a) and not stuck(b):
        return [(x, "secondary_only") for x in b]
    n, m = len(first.split()), len(second.split())
    if stuck(b) or not n or not 0.5 <= m / n <= 1.5:
        return [(x, "") for x in a]
    return merged_readings(a, b)


def span_matches(pairs: DataFrame, key: str, needle: str, hay: str) -> DataFrame:
    """(key, score, start, end) of each row's needle in its hay, both texts split at white space."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *span_score((a or "").lower().split(), (b or "").lower().split())) for k, a, b in zip(pdf["key"], pdf["a"], pdf["b"])]
            out = [(k, round(s, 6), i, j) for k, s, i, j in out]
            yield pd.DataFrame(out, columns=["key", "score", "start", "end"])

    kind = pairs.schema[key].dataType.simpleString()
    rows = pairs.select(F.col(key).alias("key"), F.coalesce(needle, F.lit("")).alias("a"), F.coalesce(hay, F.lit("")).alias("b"))
    return rows.mapInPandas(run, f"key {kind}, score double, start int, end int")
