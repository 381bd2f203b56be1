"""Markdown blocks as word-processor packages."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import INCH_DOTS, MAX_HEIGHT_IN, MAX_WIDTH_IN
from ..functions.text import inline_tokens, split_row

_DRAWN = "http://schemas.openxmlformats.org/drawingml/2006"
#: First bytes of the image kinds that a package may hold, with the ending of their names.
_KINDS = ((b"\x89PNG", "png"), (b"\xff\xd8", "jpeg"), (b"GIF8", "gif"), (b"BM", "bmp"))
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _run(kind: str, text: str, rel: str | None, bold: bool = False, italic: bool = False, color: str = "") -> str:
    if kind == "break":
        return "<w:r><w:br/></w:r>"
    marks = {"bold": "<w:b/>", "italic": "<w:i/>", "strike": "<w:strike/>", "code": '<w:rFonts w:ascii="Consolas"/>'}.get(kind, "")
    marks += ("<w:b/>" if bold and kind != "bold" else "") + ("<w:i/>" if italic and kind != "italic" else "")
    marks += f'<w:color w:val="{color}"/>' if color else ""
    run = f'<w:r><w:rPr>{marks}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
    return f'<w:hyperlink r:id="{rel}">{run}</w:hyperlink>' if rel else run


def _picture(number: int, rel: str, name: str, width: int, height: int) -> str:
    """An image in a line of text, at 96 dots an inch and no larger than fits the page."""
    share = min(1.0, MAX_WIDTH_IN * INCH_DOTS / max(width, 1), MAX_HEIGHT_IN * INCH_DOTS / max(height, 1))
    cx, cy = (round(x * share / INCH_DOTS * 914_400) for x in (width, height))
    return (
        f'<w:r><w:drawing><wp:inline xmlns:wp="{_DRAWN}/wordprocessingDrawing"><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{number}" name={quoteattr(name)}/>'
        f'<a:graphic xmlns:a="{_DRAWN}/main"><a:graphicData uri="{_DRAWN}/picture"><pic:pic xmlns:pic="{_DRAWN}/picture">'
        f'<pic:nvPicPr><pic:cNvPr id="{number}" name={quoteattr(name)}/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{rel}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
    )


def _paragraph(runs: str, style: str = "", align: str = "") -> str:
    pr = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:jc w:val="{align}"/>' if align else "")
    return f"<w:p><w:pPr>{pr}</w:pPr>{runs}</w:p>"


def documents(blocks: DataFrame, key: str, title: str | None = None, images: DataFrame | None = None, footer: str = "{N}") -> DataFrame:
    """(key, content): one package per document, as bytes. blocks: key, block, kind, level, text as
    :func:`docspark.operators.blocks.blocks` gives them. images: key, src, content, width, height (dots); an image that
    isn't among them, or of no known kind, leaves a note in red. footer: what stands at the foot of each page, with {N}
    for its number.

    Inline runs are split inside the JVM; only the package is put together in Python, one document at a time.
    """
    # Arrays of arrays of unequal length don't come through to Python; arrays of structs do.
    tokens = lambda line: F.struct(inline_tokens(line).alias("runs"))
    rows = F.transform(F.split("text", "\n", -1), lambda line: F.struct(F.transform(split_row(line), tokens).alias("cells")))
    lines = F.transform(F.split("text", "\n", -1), tokens)
    b = blocks.select(
        key, "block", "kind", "level", "text", F.when(F.col("kind") == "table", rows).alias("cells"), inline_tokens(F.col("text")).alias("runs"),
        F.when(F.col("kind").isin("ordered", "bullet", "quote"), lines).alias("lines"),
    )
    all_ = F.array_sort(F.collect_list(F.struct("block", "kind", "level", "text", "cells", "runs", "lines")))
    docs = b.groupBy(key).agg(all_.alias("blocks"))
    if images is None:
        docs = docs.withColumn("images", F.array().cast("array<struct<src:string,content:binary,width:int,height:int>>"))
    else:
        one = images.groupBy(key, "src").agg(F.min(F.struct("content", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))).alias("i"))
        own = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("src", "i.*"))).alias("images"))
        docs = docs.join(own, key, "left")

    @F.pandas_udf("binary")
    def package(blocks: pd.Series, images: pd.Series) -> pd.Series:
        return pd.Series([_package(b, title, {} if i is None else {x["src"]: x for x in i}, footer) for b, i in zip(blocks, images)])

    return docs.select(key, package("blocks", "images").alias("content"))


def _package(blocks, title: str | None, images: dict, footer: str) -> bytes:
    rels: dict[str, str] = {}
    media: dict[str, tuple[str, str, bytes]] = {}

    def picture(src: str, alt: str) -> str:
        found = images.get(src)
        content = bytes(found["content"]) if found is not None and found["content"] is not None else b""
        ending = next((e for first, e in _KINDS if content.startswith(first)), None)
        if ending is None:
            return _run("text", f"[image missing: {src or alt}]", None, color="C00000")
        if src not in media:
            media[src] = (f"rImage{len(media) + 1}", f"media/image{len(media) + 1}.{ending}", content)
        return _picture(len(media), media[src][0], alt or src, found["width"] or 0, found["height"] or 0)

    def runs(tokens, bold: bool = False, italic: bool = False) -> str:
        out = []
        for t in tokens:
            if t["kind"] == "image":
                out.append(picture(t["href"], t["text"]))
                continue
            rel = rels.setdefault(t["href"], f"rLink{len(rels) + 1}") if t["kind"] == "link" and t["href"] else None
            out.append(_run(t["kind"], t["text"], rel, bold, italic))
        return "".join(out)

    body = [_paragraph(_run("bold", title, None), "Title", "center")] if title else []
    for b in blocks:
        kind = b["kind"]
        if kind == "table":
            body.append(_table([[c["runs"] for c in row["cells"]] for row in b["cells"]], b["text"].split("\n"), runs))
        elif kind == "code":
            lines = b["text"].split("\n")[1:]
            lines = lines[:-1] if lines and lines[-1].lstrip().startswith(("```", "~~~")) else lines
            body += [_paragraph(_run("code", line, None)) for line in lines]
        elif kind == "rule":
            body.append('<w:p><w:pPr><w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr></w:pPr></w:p>')
        elif kind == "heading":
            body.append(_paragraph(runs(b["runs"]), f"Heading{b['level']}"))
        elif kind == "ordered":
            body += [_paragraph(_run("text", f"{i}. ", None) + runs(item["runs"])) for i, item in enumerate(b["lines"], 1)]
        elif kind == "bullet":
            body += [_paragraph(_run("text", "• ", None) + runs(item["runs"])) for item in b["lines"]]
        elif kind == "quote":
            body += [_paragraph(runs(line["runs"], italic=True)) for line in b["lines"]]
        else:
            body.append(_paragraph(runs(b["runs"]), align={"date": "right", "image": "center"}.get(kind, "")))
    before, place, after = footer.partition("{N}")
    number = '<w:fldSimple w:instr=" PAGE "><w:r><w:t>1</w:t></w:r></w:fldSimple>' if place else ""
    parts = (_run("text", before, None) if before else "") + number + (_run("text", after, None) if after else "")
    foot = _paragraph(parts, align="center")
    document = f'<w:document {_NS}><w:body>{"".join(body)}<w:sectPr><w:footerReference w:type="default" r:id="rFooter"/></w:sectPr></w:body></w:document>'
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    links = "".join(f'<Relationship Id="{i}" Type="{base}/hyperlink" Target={quoteattr(h)} TargetMode="External"/>' for h, i in rels.items())
    links += "".join(f'<Relationship Id="{i}" Type="{base}/image" Target="{name}"/>' for i, name, _ in media.values())
    kinds = "".join(f'<Default Extension="{e}" ContentType="image/{e}"/>' for e in sorted({name.rsplit(".", 1)[1] for _, name, _ in media.values()}))
    package = "http://schemas.openxmlformats.org/package/2006"
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    members = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}'
        f'<Override PartName="/word/document.xml" ContentType="{word}.document.main+xml"/><Override PartName="/word/footer1.xml" ContentType="{word}.footer+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{base}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": document,
        "word/footer1.xml": f"<w:ftr {_NS}>{foot}</w:ftr>",
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rFooter" Type="{base}/footer" Target="footer1.xml"/>{links}</Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        for _, name, content in media.values():
            z.writestr(zipfile.ZipInfo(f"word/{name}", (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def _table(cells, lines, runs) -> str:
    import re

    from ..functions.constants import SEPARATOR_ROW

    if len(cells) < 2 or not re.match(SEPARATOR_ROW, lines[1].strip()):
        return "".join(_paragraph(_run("text", line, None)) for line in lines)
    rows = [cells[0], *[c for c, line in zip(cells[2:], lines[2:]) if line.strip()]]
    width = max(map(len, rows))
    out = []
    for i, row in enumerate(rows):
        shade = '<w:tcPr><w:shd w:val="clear" w:fill="D9D9D9"/></w:tcPr>' if i == 0 else ""
        padded = [*row, *[[]] * (width - len(row))]
        out.append("<w:tr>" + "".join(f"<w:tc>{shade}{_paragraph(runs(c, bold=i == 0))}</w:tc>" for c in padded) + "</w:tr>")
    return f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr>{"".join(out)}</w:tbl>'
