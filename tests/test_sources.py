"""Readers and writers on files made in memory."""

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from docspark.operators import blocks, lines, numbering
from docspark.sources import docx_writer, encodings, html, markdown_sink, office
from docspark.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_html_blocks_and_tables(spark):
    page = (
        "<html><head><title>x</title><script>var p='</p>';</script></head><body><h1 id=a>T</h1><p>a <b>bold<br>c</p><ol start=3><li>x<ol><li>y</li></ol></li></ol>"
        "<table><tr><td rowspan=2>r</td><td colspan=2>c</td></tr><tr><td>1</td><td>2</td></tr></table><pre>k\n l</pre></body></html>"
    )
    d = spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, html string")
    got = [(r["kind"], r["md"]) for r in html.page_blocks(d, "k", "html").orderBy("seq").collect()]
    assert got == [
        ("heading", '# T <a id="a"></a>'), ("paragraph", "a **bold**<br>c"), ("list", "3. x\n3.1 y"), ("table", "| r | c |  |\n|---|---|---|\n| r | 1 | 2 |"), ("code", "```\nk\n l\n```"),
    ]
    cells = {(r["r"], r["c"]): (r["text"], r["is_anchor"]) for r in html.table_cells(d, "k", "html").collect()}
    assert cells[1, 0] == ("r", False) and cells[0, 2] == ("", False) and cells[1, 2] == ("2", True)


def test_encodings(spark):
    raw = [(1, "é中".encode()), (2, "中文".encode("gbk")), (3, "𠀀".encode("gb18030")), (4, b"\xff\xff\x00"), (5, None)]
    d = spark.createDataFrame(raw, "k int, content binary").select("k", encodings.decoded(F.col("content")).alias("d"))
    got = {r["k"]: (r["d"]["text"], r["d"]["encoding"]) if r["d"] else None for r in d.collect()}
    assert got[1] == ("é中", "utf-8") and got[2] == ("中文", "gb2312") and got[3][0] == "𠀀" and got[4][1] == "replaced"


def test_files_and_detectors(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.html").write_bytes("é".encode("latin-1") + b"x")
    (tmp_path / "deep" / "b.htm").write_bytes("中".encode())
    (tmp_path / "deep" / "c.png").write_bytes(b"12345")
    (tmp_path / "d.md").write_bytes(b"\xef\xbb\xbf# d")
    guess = {b"\xe9x": "LATIN-1", "中".encode(): "no-such-encoding"}.get
    names = lambda d, c: {r["path"].rsplit("/", 1)[1]: r[c] for r in d.collect()}
    found = encodings.html_files(spark, str(tmp_path), guess)
    assert names(found, "html") == {"a.html": "éx", "b.htm": "中"} and names(found, "encoding") == {"a.html": "latin-1", "b.htm": "utf-8"}
    assert names(encodings.html_files(spark, str(tmp_path)), "encoding") == {"a.html": "gbk", "b.htm": "utf-8"}
    assert names(encodings.images(spark, str(tmp_path)), "length") == {"c.png": 5}
    assert names(encodings.markdown_files(spark, str(tmp_path)), "text") == {"d.md": "# d"}


def test_word_numbers(spark):
    numbering_xml = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="0">
      <w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="chineseCounting"/><w:lvlText w:val="第%1章"/></w:lvl>
      <w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:isLgl/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum>
      <w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>"""
    p = '<w:p><w:pPr><w:numPr><w:ilvl w:val="{0}"/><w:numId w:val="{2}"/></w:numPr></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>{1}</w:t></w:r></w:p>'
    body = p.format(0, "a", 5) + p.format(1, "b", 5) + "<w:tbl><w:tr><w:tc>" + p.format(1, "c", 5) + "</w:tc></w:tr></w:tbl>" + p.format(0, "d", 5) + p.format(0, "no", 0)
    style = f'<w:p {W}><w:pPr><w:pStyle w:val="S2"/></w:pPr><w:r><w:t>e</w:t><w:tab/></w:r></w:p>'
    styles_xml = f"""<w:styles {W}><w:style w:styleId="S1"><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:style>
      <w:style w:styleId="S2"><w:basedOn w:val="S1"/></w:style><w:style w:styleId="S3"><w:basedOn w:val="S3"/></w:style></w:styles>"""
    content = package(word__document=f"<w:document {W}><w:body>{body}{style}</w:body></w:document>", word__numbering=numbering_xml, word__styles=styles_xml)
    docs = spark.createDataFrame([("f", content), ("broken", b"no zip")], "path string, content binary")
    numbered = numbering.document_numbers(office.paragraphs(docs), office.list_levels(docs), office.styles(docs), ["path"])
    got = [(r["text"], r["number"], r["in_table"], r["bold"]) for r in numbered.orderBy("seq").collect()]
    assert got == [("a", "第一章", False, True), ("b", "1.1", False, True), ("c", "1.2", True, True), ("d", "第二章", False, True), ("e", "第三章", False, False)]


def word_file(paragraphs, levels, lists, styles=""):
    """paragraphs: (text, list or None, level, further marks); levels: by abstract list, of (start, format, text); lists: XML."""
    body = "".join(
        f'<w:p><w:pPr>{f"""<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>""" if num else ""}{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
        for text, num, level, more in paragraphs
    )
    abstract = "".join(
        f'<w:abstractNum w:abstractNumId="{a}">'
        + "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="{s}"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for i, (s, f, t) in enumerate(own))
        + "</w:abstractNum>"
        for a, own in enumerate(levels)
    )
    return package(
        word__document=f"<w:document {W}><w:body>{body}</w:body></w:document>",
        word__numbering=f"<w:numbering {W}>{abstract}{lists}</w:numbering>",
        word__styles=f"<w:styles {W}>{styles}</w:styles>",
    )


def file_numbers(spark, files):
    d = spark.createDataFrame(list(files.items()), "path string, content binary")
    rows = numbering.document_numbers(office.paragraphs(d), office.list_levels(d), office.styles(d), ["path"]).collect()
    return sorted((r["path"], r["seq"], r["text"], r["number"]) for r in rows)


LIST = '<w:num w:numId="1"><w:abstractNumId w:val="0"/>{}</w:num>'


def test_files_with_equal_ids_do_not_mix(spark):
    h1 = '<w:style w:styleId="H1"><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="H2"><w:basedOn w:val="H1"/></w:style>'
    mark = '<w:pStyle w:val="H2"/>'
    rows = [("a", None, 0, mark), ("b", 1, 0, ""), ("c", 1, 1, "")]
    files = {
        f"f{i}": word_file(rows, [[(start, fmt, "%1."), (1, "decimal", "%1.%2")]], LIST.format(""), h1)
        for i, (start, fmt) in enumerate([(1, "decimal"), (5, "upperRoman"), (3, "lowerLetter")])
    }
    together = file_numbers(spark, files)
    assert together == [x for path, content in files.items() for x in file_numbers(spark, {path: content})]
    assert [x[3] for x in together] == ["1.", "2.", "2.1", "V.", "VI.", "VI.1", "c.", "d.", "d.1"]


def test_a_list_may_define_a_level_anew(spark):
    own = '<w:lvlOverride w:ilvl="0"><w:lvl w:ilvl="0"><w:start w:val="5"/><w:numFmt w:val="decimal"/><w:lvlText w:val="[%1]"/></w:lvl></w:lvlOverride>'
    got = file_numbers(spark, {"f": word_file([("a", 1, 0, ""), ("b", 1, 0, "")], [[(1, "decimal", "%1.")]], LIST.format(own))})
    assert [x[3] for x in got] == ["[5]", "[6]"]


def test_lists_of_one_kind_count_apart_and_start_where_told(spark):
    levels = [[(1, "decimal", ".".join(f"%{j + 1}" for j in range(i + 1))) for i in range(9)]]
    second = '<w:num w:numId="2"><w:abstractNumId w:val="0"/>' + "".join(f'<w:lvlOverride w:ilvl="{i}"><w:startOverride w:val="1"/></w:lvlOverride>' for i in range(9)) + "</w:num>"
    rows = [("x", num, level, "") for num, level in [(1, 1), (1, 3), (1, 4), (1, 4), (1, 6), (1, 4), (1, 6), (2, 2), (2, 2)]]
    got = file_numbers(spark, {"f": word_file(rows, levels, LIST.format("") + second)})
    assert [x[3] for x in got] == ["1.1", "1.1.1.1", "1.1.1.1.1", "1.1.1.1.2", "1.1.1.1.2.1.1", "1.1.1.1.3", "1.1.1.1.3.1.1", "1.1.1", "1.1.2"]


def test_alternate_content_counts_once_and_deleted_paragraphs_do_not(spark):
    p = '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>{1}</w:pPr><w:r><w:t>{0}</w:t></w:r></w:p>'
    box = f'<w:p><w:r><mc:AlternateContent><mc:Choice>{p.format("tb", "")}</mc:Choice><mc:Fallback>{p.format("tb", "")}</mc:Fallback></mc:AlternateContent></w:r></w:p>'
    body = box + p.format("a", "") + p.format("gone", "<w:rPr><w:del/></w:rPr>") + p.format("b", "")
    content = package(
        word__document=f'<w:document {W} xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>{body}</w:body></w:document>',
        word__numbering=f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum>{LIST.format("")}</w:numbering>',
    )
    assert [x[2:] for x in file_numbers(spark, {"f": content})] == [("tb", "1."), ("a", "2."), ("b", "3.")]


def test_deep_and_odd_pages(spark):
    deep = "<div>" * 10_000 + "x <b>y</b>" + "</div>" * 10_000
    lists = "<ol start=0><li>a</li></ol><ol start=2024><li>b<ul><li>c</li></ul></li></ol><ol start=x><li>d</li></ol><ol start=-2><li>e</li></ol>"
    cells = "<table><tr><td rowspan=99999999>r</td><td colspan=0>c</td></tr><tr><td>d</td></tr></table>"
    d = spark.createDataFrame([(1, deep), (2, lists), (3, "<b>" * 9000 + "z"), (4, cells), (5, "<ul><li>" * 3000 + "q")], "k int, html string")
    got = {}
    for r in html.page_blocks(d, "k", "html").orderBy("k", "seq").collect():
        got.setdefault(r["k"], []).append(r["md"])
    assert got[1] == ["x**y**"] or got[1] == ["x **y**"]
    assert got[2] == ["0. a", "2024. b\n  - c", "1. d", "-2. e"]
    assert got[4] == ["| r | c |\n|---|---|\n| r | d |"]
    assert got[3][0].strip("*") == "z" and got[5][0].endswith("- q")


def test_links_and_entities_however_written(spark):
    page = "<a href='/a?x=1&amp;y=2'>A &#65;&#x42; &amp;lt; &#0; &#xD800; &#128512;</a><a class=c HREF = /b >B&nbsp;&ldquo;c&rdquo;</a><a name=n>no</a><a href=\"/c'd\">C</a>"
    got = [(r["href"], r["label"]) for r in html.links(spark.createDataFrame([(1, page)], "k int, html string"), "k", "html").orderBy("seq").collect()]
    assert got == [("/a?x=1&y=2", "A AB &lt; &#0; &#xD800; \U0001f600"), ("/b", "B “c”"), ("/c'd", "C")]


def test_sheet_cells(spark):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    content = package(
        xl__workbook=f'<workbook {s}><bookViews><workbookView activeTab="0"/></bookViews></workbook>', xl__sharedStrings=f"<sst {s}><si><t>hello</t></si></sst>",
        xl__styles=f'<styleSheet {s}><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/></cellXfs></styleSheet>',
        xl__worksheets__sheet1=f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB2" s="1"><v>2.5</v></c><c r="B1" t="b"><v>1</v></c></row></sheetData></worksheet>',
    )
    got = {(r["r"], r["c"]): (r["v_str"], r["v_num"], r["v_bool"], r["number_format"]) for r in office.sheet_cells(spark.createDataFrame([("f", content)], "path string, content binary")).collect()}
    assert got == {(1, 1): ("hello", None, None, "General"), (2, 28): (None, 2.5, None, "0.00"), (1, 2): (None, None, True, "General")}


def test_bad_cells_are_null_and_the_active_sheet_is_found_by_its_relationship(spark):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = '<c r="A1"><v>abc</v></c><c r="B1" t="s"><v>7</v></c><c r="C1" t="s"><v>x</v></c><c r="D1" s="99"><v>4</v></c><c r="E1" s="q" t="b"><v>0</v></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet2.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData><row>{cells}</row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {s}><sheetData><row><c r="A1"><v>9</v></c></row></sheetData></worksheet>')
    got = {r["c"]: (r["v_str"], r["v_num"], r["v_bool"]) for r in office.sheet_cells(spark.createDataFrame([("f", out.getvalue())], "path string, content binary")).collect()}
    assert got == {1: (None, None, None), 2: (None, None, None), 3: (None, None, None), 4: (None, 4.0, None), 5: (None, None, False)}


def test_docx_round_trip(spark):
    md = "# T\n\na **b** [l](http://x)\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n- x\n- y"
    d = spark.createDataFrame([("f", md)], "path string, text string")
    docs = docx_writer.documents(blocks.blocks(lines.lines_of(d, "path", "text"), "path"), "path", title="Title")
    got = [(r["text"], r["in_table"]) for r in office.paragraphs(docs).orderBy("seq").collect()]
    assert [g for g in got if g[0]] == [("Title", False), ("T", False), ("a b l", False), ("h", True), ("i", True), ("1", True), ("2", True), ("• x", False), ("• y", False)]


def test_docx_lists_keep_their_marks_and_images_and_footers_are_written(spark):
    md = "- a **b** [l](http://x)\n- `c`\n\n1. *i*\n\n> q **r**\n\n![pic](a.png)\n\n![gone](b.png)"
    d = spark.createDataFrame([("f", md)], "path string, text string")
    png = b"\x89PNG\r\n\x1a\n rest"
    images = spark.createDataFrame([("f", "a.png", png, 1152, 96), ("f", "c.png", png, 1, 1)], "path string, src string, content binary, width int, height int")
    docs = docx_writer.documents(blocks.blocks(lines.lines_of(d, "path", "text"), "path"), "path", images=images, footer="- {N} of <9>")
    with zipfile.ZipFile(io.BytesIO(docs.first()["content"])) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    body, rels = parts["word/document.xml"].decode(), parts["word/_rels/document.xml.rels"].decode()
    for name in [n for n in parts if n.endswith((".xml", ".rels"))]:
        ElementTree.fromstring(parts[name])
    assert [r["text"] for r in office.paragraphs(docs).orderBy("seq").collect()] == ["• a b l", "• c", "1. i", "q r", "", "[image missing: b.png]"]
    assert body.count("<w:b/>") == 2 and body.count("<w:i/>") == 3 and "Consolas" in body and "**" not in body
    assert 'r:id="rLink1"' in body and 'Id="rLink1"' in rels and 'Target="http://x"' in rels
    assert parts["word/media/image1.png"] == png and 'r:embed="rImage1"' in body and 'Target="media/image1.png"' in rels and "media/image2.png" not in rels
    assert f'cx="{6 * 914_400}" cy="{914_400 // 2}"' in body and 'Extension="png"' in parts["[Content_Types].xml"].decode()
    footer = parts["word/footer1.xml"].decode()
    assert footer.index("- <") < footer.index("PAGE") < footer.index(" of &lt;9&gt;")


def test_markdown_files(spark, tmp_path):
    d = spark.createDataFrame([("a/b", "# x\n"), ("c", None), (None, "y"), ("d", "é")], "k string, t string")
    for folders in (1, 4):
        out = markdown_sink.write_markdown(d, "k", "t", str(tmp_path / str(folders)), folders)
        got = {r["k"]: r["file"] for r in out.collect()}
        assert {k: open(f, encoding="utf-8", newline="").read() for k, f in got.items()} == {"a/b": "# x\n", "c": "", "d": "é"}
        assert {f.name for f in (tmp_path / str(folders)).rglob("*") if f.is_file()} == {"a_b.md", "c.md", "d.md"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes(b"\xef\xbb\xbf# a")
    for more in (1, 2):
        ingest.ingest_available(ingest.markdown_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == more
        (tmp_path / "in" / "b.md").write_text("b")
    assert {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"# a", "b"}
