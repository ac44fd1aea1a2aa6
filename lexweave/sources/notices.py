"""Amending notices in XML, versions by date, and imported layout artifacts."""

from __future__ import annotations

from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import anchors, instructions
from lexweave.sources.formats import _element, _local, squash

def notice_actions(data: bytes | str, notice: str, prefix: str) -> list[dict]:
    """Actions of a rule: each instruction (AMDPAR) with the section and paragraphs it names and the quoted text after it.

    An instruction that names several paragraphs gives one action each; quoted paragraphs go to the one whose anchor they
    carry, a text without labels to all.
    """
    orders: list[tuple[str, list[str]]] = []
    for node in ET.fromstring(data).iter():
        tag = _local(node.tag).upper()
        if tag == "AMDPAR":
            orders.append((squash("".join(node.itertext())), []))
        elif tag == "P" and orders:
            orders[-1][1].append(squash("".join(node.itertext())))
    out: list[dict] = []
    for sentence, quoted in orders:
        order, text = instructions.read(sentence), "\n".join(quoted)
        parts = anchors.quoted_paragraphs(text)
        title = order.section.partition(".")[0] if order.section else None
        for mark in order.paragraphs or [None]:
            own = next((parts[x] for x in (mark, (mark or "").rpartition("-")[2]) if parts.get(x)), text or None)
            out.append(
                {
                    "action_id": f"{notice}#instr-{len(out) + 1}", "notice": notice, "kind": order.kind, "instruction": sentence,
                    "target_id": f"{prefix}:{title}-{order.section}" if title else None, "target_anchor": mark, "text": own,
                }
            )
    return out


def versions_at(rows: DataFrame, key: str, date: str, removed: str, day: str) -> DataFrame:
    """(key, date): the latest version of each key that is not a removal and not later than ``day``."""
    return rows.where((F.col(date) <= F.lit(day).cast("date")) & ~F.coalesce(removed, F.lit(False))).groupBy(key).agg(F.max(date).alias(date))


def artifact_elements(artifact: dict) -> list[dict]:
    """Elements of a layout artifact (texts and tables by reference, groups as children): depth-first reading order; what no
    group reaches comes last, marked ``unlinked``."""
    items = {f"#/{kind}/{i}": (kind, x) for kind in ("texts", "tables", "groups") for i, x in enumerate(artifact.get(kind, []))}
    kinds = {"section_header": "heading", "title": "heading", "list_item": "list_item", "caption": "caption", "footnote": "footnote", "page_header": "header", "page_footer": "footer"}
    out, seen = [], set()

    def emit(ref: str, why: str | None) -> None:
        kind, x = items[ref]
        if kind == "tables":
            grid = [[c.get("text", "") for c in row] for row in x.get("data", {}).get("grid", [])]
            out.append(_element("table", "\n".join("; ".join(r) for r in grid), ref, exclusion=why, grid=grid))
        elif kind == "texts" and (x.get("text") or "").strip():
            label = x.get("label", "")
            out.append(_element(kinds.get(label, "paragraph"), x["text"].strip(), ref, x.get("level") if kinds.get(label) == "heading" else None, why or ("furniture" if label.startswith("page_") else None)))

    stack = [c.get("$ref") for c in reversed(artifact.get("body", {}).get("children", []))]
    while stack:
        ref = stack.pop()
        if ref in seen or ref not in items:
            continue
        seen.add(ref)
        emit(ref, None)
        stack += [c.get("$ref") for c in reversed(items[ref][1].get("children", []))]
    for ref, (kind, _) in items.items():
        if ref not in seen and kind != "groups":
            emit(ref, "unlinked")
    return out


def case_safe(paths: DataFrame, path: str) -> DataFrame:
    """(path, safe): paths that differ from a sibling in case only get a short digest before their extension."""
    w = Window.partitionBy(F.lower(path))
    stem, ext = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 2)
    marked = F.concat(stem, F.lit("-"), F.substring(F.sha2(path, 256), 1, 8), ext)
    return paths.select(path).distinct().withColumn("n", F.count("*").over(w)).select(path, F.when(F.col("n") > 1, marked).otherwise(F.col(path)).alias("safe"))
