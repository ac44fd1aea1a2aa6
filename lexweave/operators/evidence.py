"""Evidence for displayed hits: excerpts, and greedy budgets over at most a page of rows."""

from __future__ import annotations

import re

_WORD = re.compile(r"\S+")


def excerpt(body: str, terms: list[str], most: int) -> tuple[int, int]:
    """(start, end) of at most ``most`` words: the whole body if it fits; else the paragraph with most terms; else the first
    sentence with a term; else a window that begins a third of the budget before the first term."""
    if len(body.split()) <= most:
        return 0, len(body)
    wanted = [t.lower() for t in terms]
    score = lambda s: sum(t in s.lower() for t in wanted)
    for unit in (r"(?:(?!\n[ \t]*\n).)+", r"[^.!?]+[.!?]*"):
        parts = [(m.start(), m.end()) for m in re.finditer(unit, body, re.S)]
        fit = [(a, b) for a, b in parts if len(body[a:b].split()) <= most and score(body[a:b])]
        if fit:
            return max(fit, key=lambda p: (score(body[p[0] : p[1]]), -p[0])) if unit[0] == "(" else fit[0]
    words = [(m.start(), m.end()) for m in _WORD.finditer(body)]
    low = body.lower()
    at = min((low.find(t) for t in wanted if t in low), default=0)
    first = next((i for i, (_, b) in enumerate(words) if b > at), 0)
    start = max(0, first - most // 3)
    return words[start][0], words[min(start + most, len(words)) - 1][1]


def packets(hits: list[dict], budget: int) -> list[dict]:
    """Greedy allocation over displayed hits: first every primary text, then support, peers, and context, each at most what is
    left; what lies within a span that was given already is not given again."""
    left, given, out = budget, [], []
    for role in ("primary", "support", "peer", "context"):
        for rank, hit in enumerate(hits):
            for expr, body in hit.get(role, []):
                if left <= 0:
                    return out
                a, b = excerpt(body, hit.get("terms", []), left)
                n = len(body[a:b].split())
                if n and not any(e == expr and s <= a and b <= t for e, s, t in given):
                    given.append((expr, a, b))
                    out.append({"rank": rank, "role": role, "expr": expr, "start": a, "end": b, "words": n, "text": body[a:b]})
                    left -= n
    return out


def fitting(items: list[tuple[str, int]], budget: int) -> list[str]:
    """Names of the items that fit one after another; one that does not is skipped, later ones may still fit."""
    out = []
    for name, cost in items:
        if cost <= budget:
            out.append(name)
            budget -= cost
    return out
