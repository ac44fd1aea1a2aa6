"""Paragraph anchors, tables and quoted paragraphs of a body: state machines over the lines of one text."""

from __future__ import annotations

import re

LABELS = re.compile(r"^\s*(?:[*_>\-]\s*)?((?:\([A-Za-z0-9]{1,5}\)\s*)+)")
ONE = re.compile(r"\(([A-Za-z0-9]{1,5})\)")
_UNITS = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
_TENS = ["", "x", "xx", "xxx", "xl", "l"]
ROMAN = {t + u: 10 * i + j for i, t in enumerate(_TENS) for j, u in enumerate(_UNITS) if t + u}


def _letter(label: str) -> int | None:
    """a = 1 ... z = 26, aa = 27 ...; None for other labels."""
    if label.isalpha() and label == label[0] * len(label):
        return ord(label.lower()[0]) - 96 + 26 * (len(label) - 1)
    return None


def _kinds(label: str) -> list[str]:
    """Level kinds a label can belong to, the outer one first."""
    if label.isdigit():
        return ["1"]
    low, kinds = label.lower(), []
    if _letter(low) is not None and len(low) <= 2:
        kinds.append("a" if label.islower() else "A")
    if low in ROMAN:
        kinds.append("i" if label.islower() else "I")
    return kinds


def _value(label: str, kind: str) -> int:
    return int(label) if kind == "1" else ROMAN[label.lower()] if kind in "iI" else _letter(label) or 0


def paragraph_anchors(body: str) -> list[tuple[str, int]]:
    """(anchor, line number from 1) of every labelled paragraph, in order.

    A label goes to the open level it continues; else it opens a level below if it is a first label; else it restarts
    at the level of its kind. Where a label is both letter and roman numeral, the reading that continues an open level wins,
    then the one that the next label of the text continues, then the roman one below a numbered level.
    """
    runs = []
    for n, line in enumerate(body.splitlines(), 1):
        m = LABELS.match(line)
        if m:
            runs.append((n, ONE.findall(m.group(1))))
    flat = [x for _, r in runs for x in r]
    path: list[tuple[str, str]] = []  # (kind, label)
    out, at = [], 0
    for n, labels in runs:
        for x in labels:
            following = flat[at + 1] if at + 1 < len(flat) else ""
            at += 1
            kinds = _kinds(x)
            if not kinds:
                continue
            path = _placed(path, x, kinds, following)
            out.append(("-".join(label for _, label in path), n))
    return out


def _placed(path: list[tuple[str, str]], label: str, kinds: list[str], following: str) -> list[tuple[str, str]]:
    low = [k for k in kinds if k in "iI"]
    if len(kinds) > 1 and low and _value(label, low[0]) == 1 and path and path[-1][0] == "1" and low[0] not in {k for k, _ in path}:
        # "(h)(1)(i)": a first roman numeral below the number, or the letter after h? The label after it tells.
        after = _kinds(following) if following else []
        as_letter = any(k in after and k == kinds[0] and _value(following, k) == _value(label, k) + 1 for k in "aA") or following == "1"
        if not as_letter or following in (label, label * 2):
            return [*path, (low[0], label)]
    goes_on = [(d, k) for k in kinds for d, (kind, last) in enumerate(path) if kind == k and _value(label, k) == _value(last, k) + 1]
    if len(goes_on) > 1 and following:
        nxt = [(d, k) for d, k in goes_on if k in _kinds(following) and _value(following, k) == _value(label, k) + 1]
        goes_on = nxt or goes_on
    if goes_on:
        d, k = max(goes_on)
        return [*path[:d], (k, label)]
    open_kinds = {k for k, _ in path}
    first = [k for k in kinds if _value(label, k) == 1 and k not in open_kinds]
    if first:
        return [*path, (first[-1] if path else first[0], label)]
    for k in kinds:
        for d, (kind, _) in enumerate(path):
            if kind == k:
                return [*path[:d], (k, label)]
    return [*path, (kinds[-1] if path else kinds[0], label)]


def anchor_slice(body: str, anchor: str) -> str:
    """The lines of one paragraph: from its anchor to the next one that does not lie below it; '' if there is none."""
    lines, found = body.splitlines(), paragraph_anchors(body)
    for i, (a, n) in enumerate(found):
        if a == anchor:
            end = next((m for b, m in found[i + 1 :] if not b.startswith(a + "-") and m > n), len(lines) + 1)
            return "\n".join(lines[n - 1 : end - 1]).strip()
    return ""


def gfm_tables(body: str) -> list[dict]:
    """Pipe tables: line, header and rows of cells."""
    cells = lambda s: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", s.strip().removeprefix("|").removesuffix("|"))]
    lines, out, i = body.splitlines(), [], 0
    while i + 1 < len(lines):
        if "|" in lines[i] and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]) and "-" in lines[i + 1]:
            header, rows, j = cells(lines[i]), [], i + 2
            while j < len(lines) and "|" in lines[j] and lines[j].strip():
                row = cells(lines[j])[: len(header)]
                rows.append(row + [""] * (len(header) - len(row)))
                j += 1
            out.append({"line": i + 1, "header": header, "rows": rows})
            i = j
        else:
            i += 1
    return out


def lookup(table: dict, needles: list[str]) -> str | None:
    """The first row, as ``Header: cell; ...``, that holds all needles (case-blind)."""
    for row in table["rows"]:
        flat = "; ".join(f"{h}: {c}" for h, c in zip(table["header"], row))
        if all(x.lower() in flat.lower() for x in needles):
            return flat
    return None


def quoted_paragraphs(text: str) -> dict[str, str]:
    """Anchor -> text of the labelled paragraphs that an instruction quotes."""
    lines, found, out = text.splitlines(), paragraph_anchors(text), {}
    for i, (a, n) in enumerate(found):
        end = next((m for _, m in found[i + 1 :] if m > n), len(lines) + 1)
        out[a] = LABELS.sub("", "\n".join(lines[n - 1 : end - 1]), count=1).strip()
    return out
