"""HTML pages as tables of nodes, cells and Markdown blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once, strip

DROPPED = ("script", "style", "meta", "link")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def without_scripts(html: Column) -> Column:
    """No script and style elements, meta and link tags."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return F.regexp_replace(out, r"(?i)<(?:meta|link)\b[^>]*>", "")


def without_comments(html: Column) -> Column:
    """No comments, declarations, processing instructions and character data sections."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?s)<!\[CDATA\[.*?\]\]>", "")
    return F.regexp_replace(F.regexp_replace(out, r"<![^>]*>", ""), r"<\?[^>]*>", "")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


#: Named entities that text is full of; the ampersand last.
ENTITIES = (
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("copy", "©"), ("reg", "®"), ("middot", "·"), ("bull", "•"),
    ("hellip", "…"), ("ndash", "–"), ("mdash", "—"), ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("times", "×"), ("amp", "&"),
)


def entities(text: Column) -> Column:
    """ENTITIES and numeric character references, decimal and hexadecimal, of code points that are no control characters,
    surrogates or byte order marks; each is resolved once."""

    def named(x: Column) -> Column:
        for name, sign in ENTITIES:
            x = F.replace(x, F.lit(f"&{name};"), F.lit(sign))
        return x

    def sign(x: Column) -> Column:
        body = F.substring(x, F.lit(3), F.length(x) - 3)
        hexa = F.lower(F.substring(body, 1, 1)) == "x"
        n = F.when(hexa, F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10).cast("bigint")).otherwise(body.cast("bigint"))
        good = (n >= 32) & ((n < 0xD800) | (n > 0xDFFF)) & (n <= 0x10FFFF) & (n != 0xFEFF) | n.isin(9, 10)
        # A code point's four bytes spell it.
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(x)

    def spelled(x: Column) -> Column:
        marks, gaps = F.regexp_extract_all(x, F.lit(NUMERIC), F.lit(0)), F.split(x, NUMERIC, -1)
        signs = F.concat(F.transform(marks, sign), F.array(F.lit("")))
        return F.concat_ws("", F.flatten(F.zip_with(F.transform(gaps, named), signs, lambda g, s: F.array(g, s))))

    return once(text, lambda x: F.when(x.contains("&#"), spelled(x)).when(x.contains("&"), named(x)).otherwise(x))


NUMERIC = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"

#: A link with an address in double quotes, single ones or none, and the three forms of the address.
LINK = r"""(?is)<a\b[^>]*\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>.*?</a>"""
HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, seq, href, label) of every link with an address."""
    found = F.regexp_extract_all(without_comments(without_scripts(F.col(html))), F.lit(LINK), F.lit(0))
    rows = pages.select(key, F.posexplode(found).alias("seq", "a"))
    address = F.concat(*[F.regexp_extract("a", HREF, k) for k in (1, 2, 3)])
    return rows.select(key, "seq", entities(address).alias("href"), entities(strip(without_tags(F.col("a")))).alias("label"))


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Builder(HTMLParser):
    """A tree of nodes and strings. What closes without having been opened is passed over; what was not closed
    ends with the element around it, and an inline element also where a block begins or ends."""

    INLINE = frozenset("b strong i em a span font u code".split())
    BLOCK = frozenset("p div section article table tr td th ul ol li h1 h2 h3 h4 h5 h6 pre br nav footer header body".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.stack = [self.root]
        self.dropped = 0

    def _settle(self) -> None:
        while len(self.stack) > 1 and self.stack[-1].tag in self.INLINE:
            self.stack.pop()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.dropped += 1
            return
        if tag in DROPPED or self.dropped:
            return
        if tag in self.BLOCK:
            self._settle()
        for same in (("p",), ("li",), ("tr",), ("td", "th")):
            if tag in same and self.stack[-1].tag in same:
                self.stack.pop()
        node = _Node(tag, dict(attrs))
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.dropped = max(0, self.dropped - 1)
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not self.dropped:
            self.stack[-1].kids.append(data)


def parsed(html: str) -> _Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def squeezed(text: str) -> str:
    return " ".join(text.split())


def inline(node: _Node, lists: bool = True) -> str:
    """Inline Markdown of what is below a node. Deep trees are walked with a stack, not by recursion."""
    out: list[str] = []
    open_: list[tuple] = [(node, iter(node.kids), out, lists)]
    while True:
        at, kids, own, with_lists = open_[-1]
        kid = next(kids, None)
        if kid is None:
            open_.pop()
            if not open_:
                return "".join(out)
            open_[-1][2].append(_marked(at, "".join(own)))
        elif isinstance(kid, str):
            own.append(kid)
        elif kid.tag == "br":
            own.append("<br>")
        elif kid.tag == "img":
            if src := kid.attrs.get("src"):
                own.append(f"![{kid.attrs.get('alt') or src.rsplit('/', 1)[-1]}]({src})")
        elif kid.tag not in ("ul", "ol"):
            open_.append((kid, iter(kid.kids), [], with_lists))
        elif with_lists:
            open_.append((kid, iter(kid.kids), [], True))


def _marked(node: _Node, body: str) -> str:
    mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}.get(node.tag, "")
    if node.tag == "a" and node.attrs.get("href") and body.strip():
        return f"[{squeezed(body)}]({node.attrs['href']})"
    return f"{mark}{body.strip()}{mark}" if mark and body.strip() else body


def grid(table: _Node) -> list[list[tuple[str, bool]]]:
    """Rows of (text, is the cell's own place). A row span repeats the text below, a column span leaves blanks beside it."""
    rows = [r for r in _below(table, "tr")]
    held: dict[tuple[int, int], str] = {}
    out: list[list[tuple[str, bool]]] = []
    for r, row in enumerate(rows):
        line: dict[int, tuple[str, bool]] = {c: (t, False) for (x, c), t in held.items() if x == r}
        c = 0
        for cell in (k for k in row.kids if isinstance(k, _Node) and k.tag in ("td", "th")):
            while c in line:
                c += 1
            text = squeezed(inline(cell))
            # As in browsers no cell is wider than 1000 columns; rows below the table's last are not there.
            across = min(max(_number(cell.attrs.get("colspan")), 1), 1000)
            down = min(max(_number(cell.attrs.get("rowspan")), 1), len(rows) - r)
            for d in range(across):
                line[c + d] = (text if d == 0 else "", d == 0)
                for x in range(1, down):
                    held[r + x, c + d] = text if d == 0 else ""
            c += across
        out.append([line.get(i, ("", False)) for i in range(max(line, default=-1) + 1)])
    return out


def _number(value) -> int:
    try:
        return int(value or 1)
    except (TypeError, ValueError):
        return 1


def _below(node: _Node, tag: str) -> Iterator[_Node]:
    """Nodes of a tag in document order, those of nested tables left to them."""
    open_ = [iter(node.kids)]
    while open_:
        kid = next(open_[-1], None)
        if kid is None:
            open_.pop()
        elif isinstance(kid, _Node):
            if kid.tag == tag:
                yield kid
            elif kid.tag != "table":
                open_.append(iter(kid.kids))


def table_markdown(table: _Node) -> str:
    rows = [[t.replace("|", "\\|") for t, _ in row] for row in grid(table)]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return "\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * width, *("| " + " | ".join(r) + " |" for r in rows[1:])])


def list_markdown(node: _Node) -> list[str]:
    """Items with their numbers along the lists around them, or bullets by depth."""
    out: list[str] = []
    open_: list[tuple[Iterator, tuple[int, ...], int]] = [(iter([node]), (), 0)]
    while open_:
        lists, path, depth = open_[-1]
        entry = next(lists, None)
        if entry is None:
            open_.pop()
        elif isinstance(entry, tuple):
            item, number = entry
            here = (*path, number) if number is not None else ()
            mark = f"{here[0]}. " if len(here) == 1 else ".".join(map(str, here)) + " " if here else "  " * (depth - 1) + "- "
            if text := squeezed(inline(item, lists=False)):
                out.append(mark + text)
            open_.append((iter([k for k in item.kids if isinstance(k, _Node) and k.tag in ("ul", "ol")]), here, depth))
        else:
            first = _number(entry.attrs.get("start")) if entry.tag == "ol" else None
            items = [k for k in entry.kids if isinstance(k, _Node) and k.tag == "li"]
            open_.append((iter([(k, None if first is None else first + i) for i, k in enumerate(items)]), path, depth + 1))
    return out


def blocks_of(node: _Node) -> Iterator[tuple[str, str]]:
    """(kind, Markdown) in document order. Deep trees are walked with a stack, not by recursion."""

    def flush(run: list) -> Iterator[tuple[str, str]]:
        box = _Node("", {})
        box.kids = run[:]
        run.clear()
        if text := squeezed(inline(box)):
            yield "paragraph", text

    open_: list[tuple[Iterator, list]] = [(iter(node.kids), [])]
    while open_:
        kids, run = open_[-1]
        kid = next(kids, None)
        if kid is None:
            yield from flush(run)
            open_.pop()
            continue
        if isinstance(kid, str) or kid.tag in _Builder.INLINE or kid.tag in ("img", "br"):
            run.append(kid)
            continue
        yield from flush(run)
        if kid.tag[0:1] == "h" and kid.tag[1:].isdigit() and 1 <= int(kid.tag[1:]) <= 6:
            if text := squeezed(inline(kid)):
                anchor = kid.attrs.get("id") or ""
                yield "heading", "#" * int(kid.tag[1:]) + " " + text + (f' <a id="{anchor}"></a>' if anchor else "")
        elif kid.tag == "table":
            if text := table_markdown(kid):
                yield "table", text
        elif kid.tag in ("ul", "ol"):
            if lines := list_markdown(kid):
                yield "list", "\n".join(lines)
        elif kid.tag == "pre":
            yield "code", "```\n" + "".join(_text(kid)).strip("\n") + "\n```"
        elif kid.tag == "p" and not any(isinstance(k, _Node) and k.tag in ("table", "ul", "ol", "pre", "p") for k in kid.kids):
            if text := squeezed(inline(kid)):
                yield "paragraph", text
        elif kid.tag not in ("title", "head"):
            open_.append((iter(kid.kids), []))


def _text(node: _Node) -> Iterator[str]:
    open_ = [iter(node.kids)]
    while open_:
        kid = next(open_[-1], None)
        if kid is None:
            open_.pop()
        elif isinstance(kid, str):
            yield kid
        else:
            open_.append(iter(kid.kids))


def page_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, seq, kind, md): blocks of every page, by an HTML parser; a null page has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, kind, md) for k, text in zip(batch[key], batch[html]) for i, (kind, md) in enumerate(blocks_of(parsed(text)))]
            yield pd.DataFrame(rows, columns=[key, "seq", "kind", "md"])

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, seq int, kind string, md string")


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, tbl, r, c, text, is_anchor): cells of every table with spans resolved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[html]):
                for t, table in enumerate(_below(parsed(text), "table")):
                    rows += [(k, t, r, c, x, own) for r, row in enumerate(grid(table)) for c, (x, own) in enumerate(row)]
            yield pd.DataFrame(rows, columns=[key, "tbl", "r", "c", "text", "is_anchor"])

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, tbl int, r int, c int, text string, is_anchor boolean")
