import json
import zipfile

import pytest

from skarn.sources import readers


@pytest.fixture
def files(tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("a.md", "# One\nfirst section with enough text\n# Two\nsecond section, also with text\n# x\n")
    put("b.md", "a paragraph without any heading\n\nand another one of some length\n\nshort")
    put("c.txt", "first paragraph of a text file\n\n \nsecond paragraph of a text file")
    put("d.py", "import os\n\ndef first():\n    return 'a body that is long'\n\nclass Second:\n    pass  # long enough to keep\n")
    put("e.json", '{"b": [1, 2], "a": "é"}')
    put("f.jsonl", '{"text": "a record of some length"}\n{"x": 1}\n{"text": "another record of length"}')
    put("g.csv", "name,value\nalpha,the first value here\nbeta,the second value here\nodd one out of them\n")
    put("h.xml", "<r><a>some text in a tag</a>\n<b>and some more text</b></r>")
    put("i.rtf", r"{\rtf1\ansi Some rich text that goes on for a while\par}")
    put("j.html", "<html><style>x{}</style><h1>Title of it</h1><p>A paragraph with text in it.</p><script>no()</script><p>Second paragraph, longer.</p></html>")
    put("k.yaml", "a: 1\nb: [x, y]\n")
    put("skip.bin", "not read at all by anything here")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda text, style="": f'<w:p>{style}<w:r><w:t>{text}</w:t></w:r></w:p>'
    head = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    with zipfile.ZipFile(tmp_path / "l.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("Opening words of the document")}{p("Heading", head)}{p("body under the heading")}</w:body></w:document>')
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    with zipfile.ZipFile(tmp_path / "m.pptx", "w") as z:
        for k in (1, 2, 10):
            z.writestr(f"ppt/slides/slide{k}.xml", f'<s xmlns:a="{a}"><a:t>text of slide number {k}</a:t></s>')
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    return tmp_path


def rows(df, name):
    return [(r.position, r.text) for r in sorted(df.collect(), key=lambda r: r.position) if r.source.endswith(name)]


def test_text_formats(spark, files):
    path = str(files)
    md = readers.read_markdown(spark, path)
    assert [t.split("\n")[0] for _, t in rows(md, "a.md")] == ["# One", "# Two"]
    assert [r.section for r in md.collect() if r.source.endswith("a.md")] == ["One", "Two"]
    assert rows(md, "b.md") == [(0, "a paragraph without any heading"), (1, "and another one of some length")]
    assert rows(readers.read_text(spark, path), "c.txt") == [(0, "first paragraph of a text file"), (1, "second paragraph of a text file")]
    assert [t.split("\n")[0] for _, t in rows(readers.read_code(spark, path), "d.py")] == ["def first():", "class Second:"]
    assert json.loads(rows(readers.read_json(spark, path), "e.json")[0][1]) == {"b": [1, 2], "a": "é"}
    assert [p for p, _ in rows(readers.read_jsonl(spark, path), "f.jsonl")] == [0, 2]
    table = rows(readers.read_csv(spark, path), "g.csv")
    assert table[0][1] == "CSV: g.csv\nColumns: name, value\nRows: 3" and table[1][1] == "name: alpha\nvalue: the first value here"
    assert rows(readers.read_xml(spark, path), "h.xml") == [(0, "some text in a tag and some more text")]
    assert "Some rich text" in rows(readers.read_rtf(spark, path), "i.rtf")[0][1]
    html = [t for _, t in rows(readers.read_html(spark, path), "j.html")]
    assert "no()" not in " ".join(html) and any("A paragraph with text" in t for t in html)
    assert "x" in rows(readers.read_yaml(spark, path), "k.yaml")[0][1]


def test_binary_formats_and_folders(spark, files):
    path = str(files)
    assert [t for _, t in rows(readers.read_docx(spark, path), "l.docx")] == ["Opening words of the document", "Heading\nbody under the heading"]
    assert [t for _, t in rows(readers.read_pptx(spark, path), "m.pptx")] == [f"text of slide number {k}" for k in (1, 2, 10)]
    every = readers.read_folder(spark, path)
    assert {r.source.rsplit(".", 1)[-1] for r in every.collect()} == {"md", "txt", "py", "json", "jsonl", "csv", "xml", "rtf", "html", "yaml", "docx", "pptx"}
    found = readers.discover(spark, path).collect()
    assert all(50 <= r.length <= 1_000_000 for r in found) and [r.modificationTime for r in found] == sorted(r.modificationTime for r in found)
    records = spark.read.json(str(files / "f.jsonl"))
    assert readers.absorb(records).count() == 2


def test_bounds():
    long = "A sentence of several words. " * 400
    parts = readers.bound(long)
    assert all(20 < len(p) <= readers.BOUND for p in parts) and " ".join(parts).split() == long.split()
    assert [len(p) for p in readers.bound("x" * 9000)] == [4000, 4000, 1000]
