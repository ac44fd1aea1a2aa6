"""Problem 3: oversized passages cut at natural boundaries, by agglomerative merging.

A body is first cut into atoms at every boundary it has (paragraph, line, sentence, clause; words only inside an atom
that is too long; anywhere only inside a word that is). Adjacent pieces are held in a heap by the strength of the
boundary between them and the weakest boundary whose two sides still fit together is merged first.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import ship

#: Unicode White_Space, for Python's patterns.
SPACE = "\t-\r \x85\xa0  -     　"
WORD = re.compile(f"[^{SPACE}]+")
#: Ends of atoms with the strength of the boundary: paragraph 4, line 3, sentence 2, clause 1, word 0, inside a word -1.
_LINE = "(?:\r\n|[\n\r\x0b\x0c\x85  ])"
BOUNDARY = re.compile(
    rf"(?P<p>[{SPACE}]*?{_LINE}[{SPACE}]*?{_LINE}[{SPACE}]*)|(?P<l>[{SPACE}]*?{_LINE}[{SPACE}]*)"
    rf"|(?P<s>[.!?…。！？]['\"”’»)\]]*(?:[{SPACE}]+|(?<=[。！？])))|(?P<c>[,;:、，；][{SPACE}]+)"
)
STRENGTH = {"p": 4, "l": 3, "s": 2, "c": 1}
WORDS = "whitespace_words"


def _atoms(body: str, limit: int, by_words: bool) -> list[tuple[int, int, int, int]]:
    """(start, end, units, strength of the boundary at the end), covering the whole body."""
    cuts = [(m.end(), STRENGTH[m.lastgroup]) for m in BOUNDARY.finditer(body) if 0 < m.end() < len(body)]
    if by_words:  # a sentence may end without white space, but a word is never counted twice
        cuts = [x for x in cuts if not WORD.match(body, x[0] - 1, x[0])]
    out, start = [], 0
    for end, strength in [*cuts, (len(body), 4)]:
        n = _units(body, start, end, by_words)
        if n <= limit:
            out.append((start, end, n, strength))
        else:
            out += _words(body, start, end, limit, by_words, strength)
        start = end
    return out


def _units(body: str, start: int, end: int, by_words: bool) -> int:
    return sum(1 for _ in WORD.finditer(body, start, end)) if by_words else end - start


def _words(body: str, start: int, end: int, limit: int, by_words: bool, strength: int) -> list[tuple[int, int, int, int]]:
    """An atom above the limit, by words; a word above it (in characters), by pieces of the limit."""
    starts = [m.start() for m in WORD.finditer(body, start, end)]
    edges = [start, *starts[1:], end] if starts else [start, end]
    out = []
    for a, b in zip(edges, edges[1:]):
        if by_words:
            out.append((a, b, 1, 0))
        else:
            out += [(i, min(i + limit, b), min(i + limit, b) - i, -1 if i + limit < b else 0) for i in range(a, b, limit)]
    out[-1] = (*out[-1][:3], strength)
    return out


def split_text(body: str, unit: str, max_size: int, overlap_size: int) -> list[tuple[int, int, int]]:
    """(start, cut, end) of the parts of ``body``: a part is body[start:end], of which body[start:cut] repeats the end of
    the part before. No part has more than ``max_size`` units; consecutive parts share ``overlap_size`` (at most
    ``max_size - 1``). A body within the limit is one part; an empty one none.
    """
    by_words = unit == WORDS
    if not body:
        return []
    if _units(body, 0, len(body), by_words) <= max_size:
        return [(0, 0, len(body))]
    overlap = max(0, min(overlap_size, max_size - 1))
    limit = max_size - overlap
    atoms = _atoms(body, limit, by_words)
    n = len(atoms)
    end, units, strength = [a[1] for a in atoms], [a[2] for a in atoms], [a[3] for a in atoms]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    fits = lambda i, j: units[i] + units[j] <= (max_size if i == 0 else limit)  # noqa: E731  the first part repeats nothing
    heap = [(strength[i], units[i] + units[i + 1], i, i + 1) for i in range(n - 1) if fits(i, i + 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and units[i] + units[j] == size and fits(i, j)):
            continue
        alive[j] = False
        end[i], units[i], strength[i], k = end[j], size, strength[j], after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if fits(i, k):
                heapq.heappush(heap, (strength[i], units[i] + units[k], i, k))
        h = before[i]
        if h >= 0 and fits(h, i):
            heapq.heappush(heap, (strength[h], units[h] + units[i], h, i))
    parts, i = [], 0
    word_starts = [m.start() for m in WORD.finditer(body)] if by_words and overlap else []
    seen = 0
    while i < n:
        cut = atoms[i][0]
        start = cut
        if parts and overlap:
            start = (word_starts[max(0, seen - overlap)] if seen else 0) if by_words else max(0, cut - overlap)
        parts.append((start, cut, end[i]))
        seen += units[i]
        i = after[i]
    return parts


def units(body: Column, unit: Column) -> Column:
    """Size of a body in its policy's unit, JVM side: words between Unicode white space, or code points."""
    words = F.size(F.filter(F.split(body, r"\p{IsWhite_Space}+"), lambda x: x != ""))
    return F.when(unit == WORDS, words).otherwise(F.char_length(body))


PARTS_SCHEMA = "chunk_id string, policy_id int, part int, nparts int, start_at int, cut_at int, end_at int, units int, body string"


def split_oversized(chunks: DataFrame, policies: DataFrame) -> DataFrame:
    """Parts of every chunk above the limit of its policy: chunk_id, policy_id, part, nparts, offsets, units, body.

    Chunks within their limit, without a body, or without a known policy give no rows; equal repeated rows count once;
    chunks that share an id but not the body are cut separately. Offsets are code points; part counts from 0. A limit
    below 1 is no limit. Only oversized bodies leave the JVM.
    """
    ship(chunks.sparkSession)
    rules = policies.where(F.col("policy_id").isNotNull() & (F.col("max_size") > 0)).groupBy("policy_id").agg(
        F.max(F.struct("max_size", F.coalesce("overlap_size", F.lit(0)).alias("overlap_size"), "budget_unit")).alias("rule")
    )
    over = (
        chunks.select("chunk_id", "policy_id", "body")
        .where(F.col("body").isNotNull())
        .join(rules, "policy_id")
        .where(units(F.col("body"), F.col("rule.budget_unit")) > F.col("rule.max_size"))
        .select("chunk_id", "policy_id", "body", "rule.max_size", "rule.overlap_size", "rule.budget_unit")
        .distinct()
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cid, pid, body, most, overlap, unit in pdf.itertuples(index=False, name=None):
                parts = split_text(body, unit, int(most), int(overlap))
                for k, (start, cut, end) in enumerate(parts):
                    piece = body[start:end]
                    out.append((cid, pid, k, len(parts), start, cut, end, _units(piece, 0, len(piece), unit == WORDS), piece))
            if out:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in PARTS_SCHEMA.split(", ")])

    return over.mapInPandas(run, PARTS_SCHEMA)
