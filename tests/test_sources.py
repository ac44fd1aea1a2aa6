"""Formats, corpus files and generations on small files written by hand."""

import io
import json
import zipfile

import pytest

from lexweave.sources import corpus, formats, sinks


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def short(rows):
    return [(r["type"], r["text"]) for r in rows]


def test_text_and_json():
    assert short(formats.text_elements("# Head\n\none\ntwo\n\n\nthree")) == [("heading", "Head"), ("paragraph", "one\ntwo"), ("paragraph", "three")]
    got = formats.json_elements('{"a/b": [{"n": 1.50}, null], "t": true, "x": {}}')
    assert [(r["locator"], r["text"]) for r in got] == [("/a~1b/0/n|/a~1b/0", "1.50"), ("/a~1b/1|/a~1b/1", "null"), ("/t|", "true")]
    assert formats.csv_elements("a,b\n1,\"x,y\"\n")[0]["grid"] == [["a", "b"], ["1", "x,y"]] and formats.csv_elements("") == []


def test_html():
    page = """<html><head><title>T &amp; U</title><script>var x = "</p><p>no"</script></head><body><nav><p>menu</p></nav>
    <h2>Head</h2><p>One <b>bold</b><p>Two <a href="/x">link</a><ul><li>item<li>last</ul>
    <table><tr><th rowspan=2>A<th>B<tr><td>c</table><p hidden>gone</p><img src=q alt="a boat"></body>"""
    p = formats.html_page(page)
    assert p["title"] == "T & U" and p["links"] == [("/x", "link")]
    assert short(p["elements"]) == [("paragraph", "menu"), ("heading", "Head"), ("paragraph", "One bold"), ("paragraph", "Two link"), ("list_item", "item"), ("list_item", "last"), ("table", "A: A; B: c"), ("paragraph", "gone"), ("figure", "a boat")]
    assert [e["exclusion"] for e in p["elements"] if e["exclusion"]] == ["nav", "hidden"]


def test_spans():
    assert formats.occupied([[("a", 2, 1), ("b", 1, 2)], [("c", 1, 1), ("d", 1, 1)]]) == [["a", "b", "b"], ["a", "c", "d"]]


def test_xml():
    doc = "<article><front><article-title>Big</article-title></front><body><sec><title>S</title><p>one <i>two</i></p><sec><title>Sub</title></sec></sec><table><tr><td>h</td></tr><tr><td>v</td></tr></table></body></article>"
    got = formats.xml_elements(doc)
    assert [(r["type"], r["text"], r["level"]) for r in got] == [("heading", "Big", 1), ("heading", "S", 1), ("paragraph", "one two", None), ("heading", "Sub", 2), ("table", "h: v", None)]
    assert got[2]["locator"] == "/article/body[1]/sec[1]/p[1]"
    title = '<X><DIV1 N="5" TYPE="TITLE"><HEAD>Title 5</HEAD><AUTH>A</AUTH><DIV5 N="2" TYPE="PART"><HEAD>Part 2</HEAD><DIV8 N="§ 2.1" TYPE="SECTION"><HEAD>§ 2.1 Scope.</HEAD><P>(a) x</P><P>(b) y</P></DIV8></DIV5></DIV1></X>'
    recs = formats.hierarchy_records(title, "UCR")
    assert [(r["id"], r["parent"]) for r in recs] == [("UCR:5", None), ("UCR:5/part-2", "UCR:5"), ("UCR:5-2.1", "UCR:5/part-2")]
    assert recs[2]["body"] == "(a) x\n\n(b) y" and recs[2]["note"] == "A"


def test_office(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = zipped({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert [(e["type"], e["text"], e["level"]) for e in formats.docx_elements(docx)] == [("heading", "Head", 2), ("paragraph", "a b", None), ("table", "k", None)]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = zipped({"xl/sharedStrings.xml": f"<sst {s}><si><t>Name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>1.50</v></c></row><row><c r="B2"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>'})
    assert formats.xlsx_elements(xlsx)[0]["grid"] == [["Name", "1.50"], ["Name", "7"]]
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="p"'
    pptx = zipped({"ppt/slides/slide1.xml": f'<p:sld {a}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>T</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>x</a:t></a:r></a:p></p:sp></p:sld>'})
    assert short(formats.pptx_elements(pptx)) == [("heading", "T"), ("paragraph", "x")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.docx").write_bytes(docx)
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "c.txt").write_text("one\n\ntwo")
    rows = formats.read_files(spark, f"file://{tmp_path}").collect()
    assert sum(r.path.endswith("a.docx") for r in rows) == 3 and sum(r.path.endswith("c.txt") for r in rows) == 2
    assert [r.type for r in rows if r.path.endswith("b.json")] == ["error"] and not any(".hidden" in r.path for r in rows)


def test_corpus(spark, tmp_path):
    pytest.importorskip("yaml")
    base = tmp_path / "corpus" / "ucr"
    base.mkdir(parents=True)
    (base / "_source.yaml").write_text("name: ucr\ninput_mode: markdown\nkind: base\nprecedence: 100\nid_prefix: UCR\n")
    (base / "a.md").write_text("---\nid: UCR:1-1\nsource: ucr\ntitle: One\nlevel: section\nparent: null\neffective: 2020-01-02\nnarrows:\n- id: UCR:1-2\n  anchor: a\nprovenance: {confidence: 0.5}\n---\n# One\n(a) x\n")
    (base / "bad.md").write_text("---\n: : [\n---\nbody")
    (base / ".h.md").write_text("x")
    root = f"file://{tmp_path}/corpus"
    (r,) = corpus.registry(spark, root).collect()
    assert (r.folder, r.name, r.precedence) == ("ucr", "ucr", 100)
    files = corpus.walk(spark, root)
    docs = {d.rel: d for d in corpus.documents(files).collect()}
    assert set(docs) == {"ucr/a.md", "ucr/bad.md"}
    d = docs["ucr/a.md"]
    assert d.id == "UCR:1-1" and str(d.effective) == "2020-01-02" and d.narrows[0].anchor == "a" and "parent" in d["keys"] and d.body.startswith("# One") and d.provenance.confidence == 0.5
    assert docs["ucr/bad.md"].error
    assert {(x.rel, x.key) for x in corpus.missing_keys(corpus.documents(files)).collect()} == {("ucr/bad.md", k) for k in corpus.REQUIRED}
    packed = corpus.packed(files.selectExpr("rel", "text", "'d' AS g"), "g")
    back = corpus.unpacked(packed).collect()
    assert len(back) == 2 and all(b.intact for b in back)
    broken = packed.selectExpr("replace(bundle, '(a) x', '(a) y') AS bundle")
    assert sorted(b.intact for b in corpus.unpacked(broken).collect()) == [False, True]
    assert corpus.all_files(files, broken).count() == 2
    assert json.loads(packed.first().bundle)["document"] == "d"


def test_generations(spark, tmp_path):
    g = sinks.Generations(spark, f"file://{tmp_path}/index")
    assert g.read("x") is None
    df = lambda rows: spark.createDataFrame(rows, "k string, h string, built string")
    g.publish({"x": df([("a", "1", "A1"), ("b", "1", "B1")])})
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "k string, h string")
    layer, rebuilt = sinks.refreshed(g.read("x"), new, "k", "h", lambda t: t.selectExpr("k", "h", "upper(k) || h AS built"))
    assert sorted(r.k for r in rebuilt.collect()) == ["b", "c"]
    assert sorted(map(tuple, layer.collect())) == [("a", "1", "A1"), ("b", "2", "B2"), ("c", "1", "C1")]
    g.publish({"x": layer})
    assert g.read("x").count() == 3 and not sinks.unchanged(g.read("x"), new.limit(1), "k", "h") and sinks.unchanged(g.read("x"), new, "k", "h")
    sinks.write_layers({"x": df([])}, f"file://{tmp_path}/index/generation=9")  # never marked ready
    assert g.read("x").count() == 3
    g.withdraw()
    assert g.read("x").count() == 2
