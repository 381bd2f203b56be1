"""Word-processor and spreadsheet packages: members of the archive as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BUILT_IN = {2: "0.00", 4: "#,##0.00", 10: "0.00%", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)"}


def _member(content: bytes, name: str):
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return None


def _rows(docs: DataFrame, schema: str, columns: list[str], read) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *row) for path, content in zip(batch["path"], batch["content"]) for row in read(content or b"")]
            yield pd.DataFrame(rows, columns=["path", *columns]).astype(object)

    return docs.select("path", "content").mapInPandas(run, f"path string, {schema}")


def _int(element, tag: str):
    found = element.find(tag) if element is not None else None
    return _whole(found.get(W + "val") if found is not None else None)


def _whole(value) -> int | None:
    """A whole number of 32 bits; anything else is null."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return None
    return n if -(2**31) <= n < 2**31 else None


def _float(value) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def _on(element, tag: str) -> bool:
    found = element.find(tag) if element is not None else None
    return found is not None and found.get(W + "val", "true") not in ("0", "false", "off")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(path, seq, text, style_id, has_numpr, own_num_id, own_ilvl, bold, in_table, deleted, fallback) of every paragraph.

    Tabs and breaks are spaces; a paragraph is bold if all its runs with text are. Packages without the main member
    have no paragraphs.
    """

    def read(content: bytes):
        root = _member(content, "word/document.xml")

        def walk(top):
            seq, open_ = 0, [(iter(top), False, False)]
            while open_:
                kids, in_table, fallback = open_[-1]
                kid = next(kids, None)
                if kid is None:
                    open_.pop()
                    continue
                if kid.tag == W + "p":
                    yield paragraph(kid, seq, in_table, fallback)
                    seq += 1
                open_.append((iter(kid), in_table or kid.tag == W + "tbl", fallback or kid.tag.endswith("}Fallback")))

        def paragraph(p, n, in_table, fallback):
            pr = p.find(W + "pPr")
            num = pr.find(W + "numPr") if pr is not None else None
            style = pr.find(W + "pStyle") if pr is not None else None
            mark = pr.find(W + "rPr") if pr is not None else None
            text, bold = [], []
            for run in p.iter(W + "r"):
                own = "".join(x.text or "" if x.tag == W + "t" else " " for x in run if x.tag in (W + "t", W + "tab", W + "br", W + "cr"))
                text.append(own)
                if own.strip():
                    bold.append(_on(run.find(W + "rPr"), W + "b"))
            return (
                n, "".join(text).strip(), style.get(W + "val") if style is not None else None, num is not None,
                _int(num, W + "numId"), _int(num, W + "ilvl"), bool(bold) and all(bold), in_table,
                mark is not None and mark.find(W + "del") is not None, fallback,
            )

        return walk(root) if root is not None else ()

    return _rows(
        docs,
        "seq int, text string, style_id string, has_numpr boolean, own_num_id int, own_ilvl int, bold boolean, in_table boolean, deleted boolean, fallback boolean",
        ["seq", "text", "style_id", "has_numpr", "own_num_id", "own_ilvl", "bold", "in_table", "deleted", "fallback"],
        read,
    )


def _level(e):
    text, fmt = e.find(W + "lvlText"), e.find(W + "numFmt")
    start, restart = _int(e, W + "start"), _int(e, W + "lvlRestart")
    return (
        _whole(e.get(W + "ilvl")) or 0, start, fmt.get(W + "val") if fmt is not None else None,
        text.get(W + "val") if text is not None else None,
        # Levels are counted from 1 here, 0 says never.
        None if restart is None else restart if restart == 0 else restart - 1, _on(e, W + "isLgl"),
    )


def list_levels(docs: DataFrame) -> DataFrame:
    """(path, num_id, abstract_id, ilvl, start, fmt, lvl_text, restart, is_lgl, override, own): levels of every list, the
    abstract ones and, with own, those the list itself redefines or overrides."""

    def read(content: bytes):
        root = _member(content, "word/numbering.xml")
        if root is None:
            return
        abstract = {a.get(W + "abstractNumId"): [_level(e) for e in a.findall(W + "lvl")] for a in root.findall(W + "abstractNum")}
        for num in root.findall(W + "num"):
            num_id, ref = _whole(num.get(W + "numId")), num.find(W + "abstractNumId")
            if num_id is None:
                continue
            name = ref.get(W + "val") if ref is not None else None
            for level in abstract.get(name, []):
                yield (num_id, name, *level, None, False)
            for over in num.findall(W + "lvlOverride"):
                own = over.find(W + "lvl")
                pinned = _int(over, W + "startOverride")
                level = _level(own)[1:] if own is not None else (None,) * 5
                yield (num_id, name, _whole(over.get(W + "ilvl")) or 0, *level, pinned, True)

    return _rows(
        docs,
        "num_id int, abstract_id string, ilvl int, start int, fmt string, lvl_text string, restart int, is_lgl boolean, override int, own boolean",
        ["num_id", "abstract_id", "ilvl", "start", "fmt", "lvl_text", "restart", "is_lgl", "override", "own"],
        read,
    )


def styles(docs: DataFrame) -> DataFrame:
    """(path, style_id, based_on, num_id, ilvl) of every paragraph style."""

    def read(content: bytes):
        root = _member(content, "word/styles.xml")
        for s in root.findall(W + "style") if root is not None else ():
            base, pr = s.find(W + "basedOn"), s.find(W + "pPr")
            num = pr.find(W + "numPr") if pr is not None else None
            yield s.get(W + "styleId"), base.get(W + "val") if base is not None else None, _int(num, W + "numId"), _int(num, W + "ilvl")

    return _rows(docs, "style_id string, based_on string, num_id int, ilvl int", ["style_id", "based_on", "num_id", "ilvl"], read)


def sheet_cells(docs: DataFrame) -> DataFrame:
    """(path, r, c, v_str, v_num, v_bool, number_format): cells of the active sheet with the values stored in the file.

    The active sheet is found by its relationship. A value that isn't of the cell's type, as a word among the numbers
    or a string that isn't there, is null in all columns; packages without such a sheet have no cells.
    """

    def read(content: bytes):
        book = _member(content, "xl/workbook.xml")
        if book is None:
            return
        view = book.find(f"{S}bookViews/{S}workbookView")
        active = (_whole(view.get("activeTab")) if view is not None else 0) or 0
        sheets = book.findall(f"{S}sheets/{S}sheet")
        rels = _member(content, "xl/_rels/workbook.xml.rels")
        targets = {r.get("Id"): r.get("Target", "") for r in rels} if rels is not None else {}
        target = targets.get(sheets[active].get(R + "id")) if 0 <= active < len(sheets) else None
        target = f"worksheets/sheet{active + 1}.xml" if target is None else target
        sheet = _member(content, target[1:] if target.startswith("/") else f"xl/{target}")
        if sheet is None:
            return
        strings = _member(content, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in strings.findall(S + "si")] if strings is not None else []
        looks = _member(content, "xl/styles.xml")
        formats, own = [], {}
        if looks is not None:
            own = {f.get("numFmtId"): f.get("formatCode") for f in looks.iter(S + "numFmt")}
            for xf in looks.findall(f"{S}cellXfs/{S}xf"):
                code = xf.get("numFmtId", "0")
                formats.append(own.get(code) or _BUILT_IN.get(_whole(code), "General"))
        for c in sheet.iter(S + "c"):
            letters = [x for x in c.get("r", "") if "A" <= x <= "Z"][:3]
            col = 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            row = _whole("".join(x for x in c.get("r", "") if x.isdigit())) or 0
            kind, value = c.get("t", "n"), c.findtext(S + "v")
            style = _whole(c.get("s")) or 0
            look = formats[style] if 0 <= style < len(formats) else "General"
            if kind == "s" and value is not None:
                at = _whole(value)
                yield row, col, shared[at] if at is not None and 0 <= at < len(shared) else None, None, None, look
            elif kind == "inlineStr":
                yield row, col, "".join(t.text or "" for t in c.iter(S + "t")), None, None, look
            elif kind == "b":
                yield row, col, None, None, value == "1", look
            elif kind in ("str", "e"):
                yield row, col, value, None, None, look
            elif value is not None:
                yield row, col, None, _float(value), None, look

    return _rows(
        docs, "r int, c int, v_str string, v_num double, v_bool boolean, number_format string",
        ["r", "c", "v_str", "v_num", "v_bool", "number_format"], read,
    )
