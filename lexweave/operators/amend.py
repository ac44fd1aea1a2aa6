"""Applying amending actions to texts, and reading the instructions that order them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import anchors, instructions
from lexweave.functions.names import c
from lexweave.session import ship

READ_SCHEMA = "kind string, section string, paragraphs array<string>, edits array<struct<old:string,new:string,everywhere:boolean>>, moves array<struct<source:string,target:string>>"


def reading(x: str | Column) -> Column:
    """(kind, section, paragraphs, edits, moves) of an instruction, by Arrow batches; all null or empty for null."""

    @F.pandas_udf(READ_SCHEMA)
    def read(texts: pd.Series) -> pd.DataFrame:
        found = [instructions.read(None if t is None or t != t else t) for t in texts]
        return pd.DataFrame(
            {
                "kind": [f.kind for f in found],
                "section": [f.section for f in found],
                "paragraphs": [f.paragraphs for f in found],
                "edits": [[{"old": a, "new": b, "everywhere": e} for a, b, e in f.edits] for f in found],
                "moves": [[{"source": a, "target": b} for a, b in f.moves] for f in found],
            }
        )

    return read(c(x))


def _label(anchor: str) -> str:
    return f"({anchor.rpartition('-')[2]})"


class Paragraph:
    """A labelled paragraph: its own lines and those below it, by label. The first line carries the label."""

    __slots__ = ("lines", "kids")

    def __init__(self, lines: list[str]):
        self.lines, self.kids = lines, {}

    def rendered(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            out += node.lines
            stack += reversed(node.kids.values())
        return out


def parsed(text: str) -> Paragraph:
    """The paragraphs of a text as a tree under a root that holds what comes before the first label. A label that comes twice
    at one place is kept, under a key no anchor has."""
    lines, found = text.splitlines(), anchors.paragraph_anchors(text)
    starts: dict[int, list[str]] = {}
    for anchor, n in found:
        starts.setdefault(n - 1, []).append(anchor)
    at = sorted(starts)
    root = Paragraph(lines[: at[0]] if at else lines)
    for i, n in enumerate(at):
        node = None
        for anchor in starts[n]:
            *above, label = anchor.split("-")
            up = root
            for x in above:
                up = up.kids.setdefault(x, Paragraph([]))
            while label in up.kids and (up.kids[label].lines or up.kids[label].kids):
                label += "\0"
            node = up.kids[label] = Paragraph([])
        node.lines = lines[n : at[i + 1] if i + 1 < len(at) else len(lines)]
    return root


class Text:
    """A text under amendment, parsed once; an action costs what it touches, not the whole text."""

    def __init__(self, body: str):
        self.root = parsed(body)

    def body(self) -> str:
        return "\n".join(self.root.rendered())

    def _at(self, anchor: str, make: bool = False) -> tuple[Paragraph | None, str]:
        """(the node above an anchor, its label); with ``make`` missing ones are made, without lines."""
        *above, label = anchor.split("-")
        node = self.root
        for x in above:
            if x not in node.kids:
                if not make:
                    return None, label
                node.kids[x] = Paragraph([])
            node = node.kids[x]
        return node, label

    @staticmethod
    def _made(anchor: str, text: str) -> Paragraph:
        """The paragraph an action's text gives; a text that brings its own labels brings its sub-paragraphs too."""
        own = parsed(text)
        label = anchor.rpartition("-")[2]
        if not own.lines and label in own.kids and len(own.kids) == 1:
            return own.kids[label]
        return Paragraph(f"{_label(anchor)} {text}".split("\n"))

    def apply(self, kind: str, anchor: str, text: str, instruction: str = "") -> bool:
        """Whether the action was done. An action whose paragraph is not there, whose words are not found, or whose text leaves
        something out (asterisks) is not done and changes nothing."""
        order = instructions.read(instruction) if instruction else None
        if kind == "stay":
            return True
        if not anchor:
            return self._whole(kind, text)
        up, label = self._at(anchor)
        there = up is not None and label in up.kids
        if kind == "remove" and there:
            if order and order.reserve:
                up.kids[label] = Paragraph([f"{_label(anchor)} [Reserved]"])
            elif order and order.edits:
                return self._edited(up.kids[label], order.edits)
            else:
                del up.kids[label]
            return True
        if kind == "redesignate" and there:
            return self._moved(up, label, anchor, named_anchor(text))
        if kind not in ("add", "amend") or (kind == "amend" and not there) or not text or "* * *" in text:
            return False
        if there:
            edits = instructions.read(text).edits or (order.edits if order else [])
            if edits:
                return self._edited(up.kids[label], edits)
            made = self._made(anchor, text)
            if order and order.introductory:
                made.kids = up.kids[label].kids
            up.kids[label] = made
        else:
            up, label = self._at(anchor, make=True)
            up.kids[label] = self._made(anchor, text)
        return True

    def _whole(self, kind: str, text: str) -> bool:
        if kind == "remove":
            self.root = Paragraph([])
        elif kind in ("add", "amend") and text:
            self.root = parsed(text)
        else:
            return False
        return True

    def _moved(self, up: Paragraph, label: str, anchor: str, target: str) -> bool:
        if not target:
            return False
        node = up.kids.pop(label)
        if node.lines:
            node.lines = [node.lines[0].replace(_label(anchor), _label(target), 1), *node.lines[1:]]
        into, new = self._at(target, make=True)
        into.kids[new] = node
        return True

    @staticmethod
    def _edited(node: Paragraph, edits: list[tuple[str, str, bool]]) -> bool:
        lines = "\n".join(node.rendered())
        for old, new, everywhere in edits:
            if old not in lines:
                return False
            lines = lines.replace(old, new) if everywhere else lines.replace(old, new, 1)
        changed = parsed(lines)
        first = next(iter(changed.kids.values()), None)
        if first is not None and len(changed.kids) == 1 and not changed.lines:
            node.lines, node.kids = first.lines, first.kids
        else:
            node.lines, node.kids = lines.split("\n"), {}
        return True


def apply_one(body: str, kind: str, anchor: str, text: str, instruction: str = "") -> tuple[str, bool]:
    """(new body, done): one action on one text."""
    t = Text(body)
    done = t.apply(kind, anchor, text, instruction)
    return t.body() if done else body, done


def named_anchor(x: str | None) -> str:
    """``(b)(2)``, ``#b-2`` and ``b-2`` as ``b-2``."""
    bare = (x or "").strip().removeprefix("#")
    return "-".join(p for p in re.split(r"[()\s-]+", bare) if p)


def composed(texts: DataFrame, actions: DataFrame) -> DataFrame:
    """(work, body, applied, failed): each text after its actions in order; works without actions keep theirs.

    ``texts`` (work, body); ``actions`` (work, kind, anchor, text, seq). Rows of both are merged by the shuffle's sort, the
    text first; one text at a time is in memory, parsed once, so a work with very many actions streams through.
    """
    ship(texts.sparkSession)
    a = actions.select("work", "kind", "anchor", "text", F.col("seq").cast("bigint").alias("seq"), F.lit(1).alias("side"))
    t = texts.select("work", F.lit("").alias("kind"), F.lit("").alias("anchor"), F.col("body").alias("text"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("side"))
    columns = ["work", "body", "applied", "failed"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work, now, done, failed = None, None, 0, 0
        for pdf in batches:
            out = []
            for w, kind, anchor, text, side in zip(pdf["work"], pdf["kind"], pdf["anchor"], pdf["text"], pdf["side"]):
                if w != work:
                    if now is not None:
                        out.append((work, now.body(), done, failed))
                    work, now, done, failed = w, None, 0, 0
                if side == 0:
                    now = Text(text or "")
                elif now is not None:
                    ok = now.apply(kind, anchor or "", text or "")
                    done, failed = done + ok, failed + (not ok)
            yield pd.DataFrame(out, columns=columns)
        if now is not None:
            yield pd.DataFrame([(work, now.body(), done, failed)], columns=columns)

    rows = t.unionByName(a).where("work IS NOT NULL").repartition("work").sortWithinPartitions("work", "side", "seq")
    return rows.mapInPandas(run, "work string, body string, applied int, failed int")
