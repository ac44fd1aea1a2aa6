"""A reader of amending instructions: one scan to tokens, one pass over them.

``Amend § 12.4 by revising paragraphs (a)(1) and (b)`` is a container verb, a section, a deciding verb and two labels. What
stands in quotation marks is matter to be put in or taken out and never read as an instruction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# What the verbs of an instruction do; "amend" opens an instruction and lets a later verb say how.
VERBS = {"add": "add", "insert": "add", "remov": "remove", "delet": "remove", "redesignat": "redesignate", "stay": "stay", "suspend": "stay", "revis": "amend", "correct": "amend", "republish": "amend"}
_TOKEN = re.compile(
    r"""["“”](?P<quote>[^"“”]+)["“”]
      | (?P<label>(?:\(\s?[A-Za-z0-9]{1,4}\s?\))+)
      | (?P<number>\d+(?:\.\d+)*[a-z]?(?:-\d+)?)
      | (?P<sign>§+)
      | (?P<word>[^\W\d_]+\.?)
      | (?P<comma>[,;])""",
    re.X,
)
_LINKS = {"and", "or", "through", "to", ","}


@dataclass
class Instruction:
    """kind (None for no text), the section it names, labels of the paragraphs it names (each once), word edits as (old, new,
    everywhere), moves as (from, to); ``reserve`` and ``introductory`` are asked for in so many words."""

    kind: str | None = None
    section: str | None = None
    paragraphs: list[str] = field(default_factory=list)
    edits: list[tuple[str, str, bool]] = field(default_factory=list)
    moves: list[tuple[str, str]] = field(default_factory=list)
    reserve: bool = False
    introductory: bool = False


def anchor_of(label: str) -> str:
    """``(a)(1)`` as ``a-1``."""
    return "-".join(part.strip() for part in label.strip("()").split(")("))


def _verb(word: str) -> str | None:
    if word.startswith("add"):  # no addresses
        return "add" if word in ("add", "adds", "added", "adding") else None
    return next((kind for stem, kind in VERBS.items() if word.startswith(stem)), None)


def _series(first: str, last: str) -> list[str]:
    """``b`` through ``d``: the siblings between two labels of one kind; the two alone where they have no order."""
    head, _, a = first.rpartition("-")
    b = last.rpartition("-")[2]
    if a.isdigit() and b.isdigit() and int(a) < int(b):
        labels = [str(i) for i in range(int(a), int(b) + 1)]
    elif len(a) == len(b) == 1 and a.isalpha() and a.islower() == b.islower() and a < b:
        labels = [chr(i) for i in range(ord(a), ord(b) + 1)]
    else:
        return [first, last]
    return [f"{head}-{x}" if head else x for x in labels]


def read(text: str | None) -> Instruction:
    """The instruction in a sentence. It does what its first verb other than "amend" says, and amends without one."""
    out = Instruction()
    if text is None:
        return out
    listing, after_as, section_next, through = False, False, False, False
    role, old = None, None  # what the next quoted matter is, and what is to go
    named: list[str] = []
    targets: list[str] = []
    for m in _TOKEN.finditer(text):
        what, value = m.lastgroup, m.group(m.lastgroup)
        if what == "quote":
            if role == "new" and old is not None:
                out.edits.append((old, value, False))
                old = None
            elif role in ("old", "words"):
                old = value
            listing = False
        elif what == "label":
            if listing:
                mark, into = anchor_of(value), targets if after_as else named
                into += _series(into.pop(), mark) if through and into and out.kind == "redesignate" else [mark]
            through = False
        elif what == "number":
            if section_next and "." in value and out.section is None:
                out.section = value
            listing = section_next = False
        elif what == "sign":
            section_next, listing = True, False
        elif what == "comma":
            pass
        else:
            word = value.lower().rstrip(".")
            kind = _verb(word)
            if kind and out.kind is None:
                out.kind = kind
            if kind == "remove":
                role = "old"
            elif kind == "add" or word in ("replaced", "substituting"):
                role = "new"
            elif word in ("word", "words", "phrase", "phrases") and role is None:
                role = "words"
            section_next = word in ("section", "sections", "sec", "secs")
            out.reserve |= word.startswith("reserv")
            out.introductory |= word == "introductory"
            if word in ("wherever", "everywhere", "each") and (old is not None or out.edits):
                out.edits = [(a, b, True) for a, b, _ in out.edits]
                old = old and f"\0{old}"
            if word in ("paragraph", "paragraphs"):
                listing, through = True, False
            elif listing and word == "through":
                through = True
            elif word == "as":
                listing = after_as = out.kind == "redesignate"
            elif listing and word not in _LINKS:
                listing, after_as = False, False
    out.edits = [(a.removeprefix("\0"), b, e or a.startswith("\0")) for a, b, e in out.edits]
    out.kind = out.kind or "amend"
    out.paragraphs = list(dict.fromkeys(named))
    if out.kind == "redesignate":
        out.moves = list(zip(named, targets))
    return out
