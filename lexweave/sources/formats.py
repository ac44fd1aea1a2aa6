"""Documents of many formats as rows of elements: pure parsers, and one reader for files.

An element is a dict with: type (paragraph, heading, list_item, table, caption, footnote, value, ...), text, level (of a
heading), locator (where in the source), exclusion (page chrome that is kept but is no text), grid (cells of a table).
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import ship

SQUASH = re.compile(r"\s+")


def _element(type_: str, text: str, locator: str, level: int | None = None, exclusion: str | None = None, grid: list | None = None) -> dict:
    return {"type": type_, "text": text, "locator": locator, "level": level, "exclusion": exclusion, "grid": grid}


def squash(x: str) -> str:
    return SQUASH.sub(" ", x).strip()


# ---- plain text, JSON, CSV


def text_elements(text: str) -> list[dict]:
    """Blocks between blank lines; ``# x`` is a heading. The locator is the range of lines."""
    out, block, first = [], [], 0
    for n, line in enumerate([*text.splitlines(), ""], 1):
        if line.strip():
            first = first or n
            block.append(line)
        elif block:
            m = re.match(r"(#{1,6})\s+(.*)", block[0])
            if m and len(block) == 1:
                out.append(_element("heading", m.group(2).strip(), f"lines:{first}-{n - 1}", len(m.group(1))))
            else:
                out.append(_element("paragraph", "\n".join(block), f"lines:{first}-{n - 1}"))
            block, first = [], 0
    return out


class _Numeral(str):
    """A number as the source spells it."""


def json_elements(text: str) -> list[dict]:
    """Leaves with their RFC 6901 pointer; exclusion is unused, locator is pointer|scope, scope the nearest array item."""
    data = json.loads(text, parse_int=_Numeral, parse_float=_Numeral)
    out, stack = [], [(data, "", "")]
    while stack:
        value, at, scope = stack.pop()
        if isinstance(value, dict):
            stack += [(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}", scope) for k, v in reversed(list(value.items()))]
        elif isinstance(value, list):
            stack += [(v, f"{at}/{i}", f"{at}/{i}") for i, v in reversed(list(enumerate(value)))]
        else:
            shown = "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
            out.append(_element("value", shown, f"{at}|{scope}"))
    return out


def csv_elements(text: str, delimiter: str | None = None) -> list[dict]:
    if delimiter is None:
        delimiter = "\t" if text.split("\n", 1)[0].count("\t") > text.split("\n", 1)[0].count(",") else ","
    grid = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if r]
    if not grid:
        return []
    width = max(map(len, grid))
    grid = [r + [""] * (width - len(r)) for r in grid]
    return [_element("table", flat(grid), f"A1:{column_name(width)}{len(grid)}", grid=grid)]


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def flat(grid: list[list[str]]) -> str:
    """Rows as ``Header: cell; ...`` lines."""
    head, *rows = grid
    return "\n".join("; ".join(f"{h}: {c}" for h, c in zip(head, r)) for r in rows) if rows else "; ".join(head)


# ---- tables with spans


def occupied(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Grid of a table given as rows of (text, rowspan, colspan): a spanning cell fills all it covers."""
    cells: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, across in row:
            while (r, c) in cells:
                c += 1
            for i in range(max(1, min(down, 1000))):
                for j in range(max(1, min(across, 1000))):
                    cells[r + i, c + j] = text
            c += max(1, across)
    height = len(rows)
    width = max((c for _, c in cells), default=-1) + 1
    return [[cells.get((r, c), "") for c in range(width)] for r in range(height)]


# ---- HTML

_CHROME_TAGS, _CHROME_ROLES = {"nav", "header", "footer", "aside"}, {"navigation", "banner", "contentinfo", "search", "complementary"}
_SKIP, _VOID = {"script", "style", "template", "noscript"}, {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
_BLOCKS = {"p": "paragraph", "li": "list_item", "pre": "code", "blockquote": "quote", "figcaption": "caption", "caption": "caption", "dt": "list_item", "dd": "list_item", **{f"h{i}": "heading" for i in range(1, 7)}}


class _Html(HTMLParser):
    """Blocks of a page. Unclosed tags are closed by their parents' ends; script bodies are never read as markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.open: list[tuple[str, str, str | None]] = []  # tag, path, chrome
        self.counts: list[dict[str, int]] = [{}]
        self.block: tuple[str, str, str, str | None] | None = None
        self.text: list[str] = []
        self.rows: list[list[tuple[str, int, int]]] | None = None
        self.cell: tuple[int, int] | None = None
        self.skip = 0
        self.title = ""
        self.links: list[tuple[str, str]] = []
        self.href: str | None = None
        self.anchor: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        if tag in _VOID:
            if tag == "br" and self.block:
                self.text.append("\n")
            if tag == "img" and a.get("alt"):
                self._flush()
                self.out.append(_element("figure", a["alt"], self._path(tag), exclusion=self._chrome()))
            return
        same = self.counts[-1]
        same[tag] = same.get(tag, 0) + 1
        up = self.open[-1][1] if self.open else ""
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "")
        chrome = self._chrome() or (tag if tag in _CHROME_TAGS else None) or (a.get("role") if a.get("role") in _CHROME_ROLES else None) or ("hidden" if hidden else None)
        if tag in _BLOCKS and self.rows is None or tag == "table":
            self._flush()
        self.open.append((tag, f"{up}/{tag}[{same[tag]}]", chrome))
        self.counts.append({})
        if tag == "table" and self.rows is None:
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self._cell()
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th"):
            number = lambda x: int(x) if (x or "").isdigit() else 1
            self._cell()
            self.cell = (number(a.get("rowspan")), number(a.get("colspan")))
            self.text = []
        elif tag in _BLOCKS and self.rows is None:
            self.block = (_BLOCKS[tag], tag, self.open[-1][1], chrome)
        elif tag == "a" and a.get("href"):
            self.href, self.anchor = a["href"], []

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        if tag == "a" and self.href is not None:
            self.links.append((self.href, squash("".join(self.anchor))))
            self.href = None
        if tag in ("td", "th", "tr"):
            self._cell()
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            t, path, chrome = self.open.pop()
            self.counts.pop()
            if t == "table" and self.rows is not None:
                self._cell()
                grid = occupied([r for r in self.rows if r])
                self.rows, self.text = None, []
                if grid:
                    self.out.append(_element("table", flat(grid), path, exclusion=chrome, grid=grid))
            elif self.block and t == self.block[1]:
                self._flush()
            if t == tag:
                return

    def handle_data(self, data):
        if self.skip:
            return
        if self.open and self.open[-1][0] == "title":
            self.title += data
        elif self.block or self.cell is not None:
            self.text.append(data)
        if self.href is not None:
            self.anchor.append(data)

    def _path(self, tag: str) -> str:
        return (self.open[-1][1] if self.open else "") + f"/{tag}"

    def _chrome(self) -> str | None:
        return self.open[-1][2] if self.open else None

    def _cell(self) -> None:
        if self.cell is not None and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((squash("".join(self.text)), *self.cell))
            self.cell, self.text = None, []

    def _flush(self) -> None:
        if self.block:
            kind, tag, path, chrome = self.block
            text = "".join(self.text).strip("\n") if kind == "code" else squash("".join(self.text))
            if text:
                self.out.append(_element(kind, text, path, int(tag[1]) if kind == "heading" else None, chrome))
        self.block, self.text = None, []


def html_page(text: str) -> dict:
    """title, links (href, text) and elements of a page."""
    p = _Html()
    p.feed(text)
    p.close()
    p._flush()
    return {"title": squash(p.title), "links": p.links, "elements": p.out}


def html_elements(text: str) -> list[dict]:
    return html_page(text)["elements"]


# ---- XML


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def xml_elements(data: bytes | str) -> list[dict]:
    """Titles, paragraphs, references, captions, footnotes and tables of an article in XML, with their paths.

    A title's level is the number of sections around it.
    """
    kinds = {"title": "heading", "article-title": "heading", "head": "heading", "p": "paragraph", "ref": "reference", "caption": "caption", "fn": "footnote", "table": "table"}
    out = []
    todo = [(ET.fromstring(data), "", 0)]
    while todo:
        node, at, depth = todo.pop()
        tag = _local(node.tag)
        path = at or f"/{tag}"
        deeper = depth + (tag == "sec" or re.fullmatch(r"DIV\d*", tag or "") is not None)
        kind = kinds.get(tag.lower() if tag in ("HEAD", "P", "FN", "TABLE") else tag)
        if kind == "table":
            rows = [[(squash("".join(c.itertext())), int(c.get("rowspan") or 1), int(c.get("colspan") or 1)) for c in r if _local(c.tag).lower() in ("td", "th", "ent")] for r in node.iter() if _local(r.tag).lower() in ("tr", "row")]
            grid = occupied([r for r in rows if r])
            if grid:
                out.append(_element("table", flat(grid), path, grid=grid))
            continue
        if kind:
            text = squash("".join(node.itertext()))
            if text:
                out.append(_element(kind, text, path, max(1, depth) if kind == "heading" else None))
            continue
        seen: dict[str, int] = {}
        kids = []
        for child in node:
            name = _local(child.tag)
            seen[name] = seen.get(name, 0) + 1
            kids.append((child, f"{path}/{name}[{seen[name]}]", deeper))
        todo += reversed(kids)
    return out


def hierarchy_records(data: bytes | str, prefix: str) -> list[dict]:
    """Sections of a title in nested DIVs (N, TYPE, HEAD, P): id, parent, level_name, title, body, ord, inherited source note.

    A section (the lowest level) is ``prefix:title-number``; the levels above it are numbered within their parents.
    """
    root = ET.fromstring(data)
    out = []

    def texts(div: ET.Element, tag: str) -> list[str]:
        return [squash("".join(x.itertext())) for x in div if _local(x.tag).upper() == tag]

    def down(div: ET.Element, parent: str | None, note: str, title_no: str, order: int) -> None:
        level, number = (div.get("TYPE") or "").lower(), squash(div.get("N") or "").removeprefix("§").strip()
        note = " ".join(texts(div, "AUTH") + texts(div, "SOURCE")) or note
        if level == "title" or not title_no:
            title_no = number
            id_ = f"{prefix}:{number}"
        elif level == "section":
            id_ = f"{prefix}:{title_no}-{number}"
        else:
            id_ = f"{parent}/{level}-{number}"
        out.append({"id": id_, "parent": parent, "level_name": level, "title": " ".join(texts(div, "HEAD")), "body": "\n\n".join(texts(div, "P")), "ord": order, "note": note})
        kids = [x for x in div if re.fullmatch(r"DIV\d*", _local(x.tag).upper())]
        for i, kid in enumerate(kids, 1):
            down(kid, id_, note, title_no, i)

    for i, div in enumerate((x for x in root.iter() if re.fullmatch(r"DIV1?", _local(x.tag).upper())), 1):
        down(div, None, "", "", i)
    return out


# ---- office files (zip + XML)

_W, _A = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S, _R = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_elements(data: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for i, node in enumerate(body if body is not None else [], 1):
        where = f"/w:document/w:body/*[{i}]"
        if node.tag == f"{_W}tbl":
            grid = occupied([[(squash("".join(t.text or "" for t in c.iter(f"{_W}t"))), 1, int(next((g.get(f"{_W}val") for g in c.iter(f"{_W}gridSpan")), 1))) for c in r.findall(f"{_W}tc")] for r in node.iter(f"{_W}tr")])
            if grid:
                out.append(_element("table", flat(grid), where, grid=grid))
        elif node.tag == f"{_W}p":
            text = squash("".join((t.text or "") if t.tag == f"{_W}t" else " " for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")))
            style = next((s.get(f"{_W}val") or "" for s in node.iter(f"{_W}pStyle")), "")
            m = re.match(r"(?i)heading\s*(\d)", style)
            if text:
                kind = "heading" if m else "list_item" if next(node.iter(f"{_W}numPr"), None) is not None else "paragraph"
                out.append(_element(kind, text, where, int(m.group(1)) if m else None))
    return out


def pptx_elements(data: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        order = []
        if "ppt/_rels/presentation.xml.rels" in names:
            target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
            for s in ET.fromstring(z.read("ppt/presentation.xml")).iter():
                if _local(s.tag) == "sldId":
                    order.append("ppt/" + (target.get(s.get(f"{_R}id")) or "").removeprefix("/ppt/"))
        order = [s for s in order if s in names] or sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for number, name in enumerate(order, 1):
            for i, shape in enumerate(x for x in ET.fromstring(z.read(name)).iter() if _local(x.tag) in ("sp", "graphicFrame")):
                where = f"slide:{number}/shape:{i + 1}"
                rows = [[(squash("".join(t.text or "" for t in c.iter(f"{_A}t"))), int(c.get("rowSpan") or 1), int(c.get("gridSpan") or 1)) for c in r.findall(f"{_A}tc") if c.get("hMerge") != "1" and c.get("vMerge") != "1"] for r in shape.iter(f"{_A}tr")]
                if rows:
                    grid = occupied(rows)
                    out.append(_element("table", flat(grid), where, grid=grid))
                    continue
                heading = any(_local(p.tag) == "ph" and p.get("type") in ("title", "ctrTitle") for p in shape.iter())
                for p in shape.iter(f"{_A}p"):
                    text = squash("".join(t.text or "" for t in p.iter(f"{_A}t")))
                    if text:
                        out.append(_element("heading" if heading else "paragraph", text, where, 1 if heading else None))
    return out


def xlsx_elements(data: bytes) -> list[dict]:
    """One table per sheet with its range; numbers stay as the file spells them; merged cells are filled."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n))):
            sheet = ET.fromstring(z.read(name))
            cells: dict[tuple[int, int], str] = {}
            for c in sheet.iter(f"{_S}c"):
                at = _cell_at(c.get("r") or "")
                v = c.find(f"{_S}v")
                text = shared[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                if at and text:
                    cells[at] = text
            for m in sheet.iter(f"{_S}mergeCell"):
                (r0, c0), (r1, c1) = map(_cell_at, (m.get("ref") or "A1:A1").split(":"))
                for r in range(r0, r1 + 1):
                    for c in range(c0, c1 + 1):
                        cells.setdefault((r, c), cells.get((r0, c0), ""))
            if cells:
                height, width = max(r for r, _ in cells), max(c for _, c in cells)
                grid = [[cells.get((r, c), "") for c in range(1, width + 1)] for r in range(1, height + 1)]
                out.append(_element("table", flat(grid), f"{name.rsplit('/', 1)[-1]}!A1:{column_name(width)}{height}", grid=grid))
    return out


def _cell_at(ref: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
    if not m:
        return None
    col = 0
    for ch in m.group(1):
        col = col * 26 + ord(ch) - 64
    return int(m.group(2)), col


# ---- reader

PARSERS = {
    "txt": lambda b: text_elements(b.decode("utf-8-sig", "replace")), "md": lambda b: text_elements(b.decode("utf-8-sig", "replace")),
    "json": lambda b: json_elements(b.decode("utf-8-sig")), "csv": lambda b: csv_elements(b.decode("utf-8-sig", "replace")), "tsv": lambda b: csv_elements(b.decode("utf-8-sig", "replace"), "\t"),
    "html": lambda b: html_elements(b.decode("utf-8", "replace")), "htm": lambda b: html_elements(b.decode("utf-8", "replace")), "xml": xml_elements, "docx": docx_elements, "pptx": pptx_elements, "xlsx": xlsx_elements,
}

SCHEMA = "path string, doc_sha string, seq int, type string, text string, level int, locator string, exclusion string, grid array<array<string>>, error string"


def elements_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Elements of binary files, by their extension. A file that cannot be read gives one row with its error."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, sha, data in zip(pdf["p"], pdf["sha"], pdf["c"]):
                parse = PARSERS.get(p.rsplit(".", 1)[-1].lower())
                try:
                    if parse is None:
                        raise ValueError("unknown format")
                    rows = parse(bytes(data))
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    out.append((p, sha, 0, "error", None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
                    continue
                out += [(p, sha, i, e["type"], e["text"], e["level"], e["locator"], e["exclusion"], e["grid"], None) for i, e in enumerate(rows)]
            df = pd.DataFrame(out, columns=names)
            df["level"] = df["level"].astype("Int32")
            yield df

    return files.select(F.col(path).alias("p"), F.sha2(content, 256).alias("sha"), F.col(content).alias("c")).mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as elements; hidden files and folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return elements_of(files.where(~F.col("path").rlike(r"/\.[^/]")))
