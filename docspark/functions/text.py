"""Text and markup functions: cleaning, escaping, predicates. All are expressions inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

_WS = K.WS


def once(c: Column, use) -> Column:
    """use(c), with c worked out once however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{_WS}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}+", "")


def normal_spaces(c: Column) -> Column:
    """White space of a text node: no-break and ideographic spaces become spaces, line breaks with the blanks
    around them and runs of tabs one space each; a node of layout white space only becomes empty."""

    def fold(t: Column) -> Column:
        folded = F.regexp_replace(F.regexp_replace(t, r"[ \t]*\r?\n[ \t\r\n]*", " "), r"\t+", " ")
        meant = t.rlike(r"[\x{A0}\x{3000}]")
        return once(folded, lambda f: F.when(~meant & ~f.rlike(K.NOT_WS), F.lit("")).otherwise(F.translate(f, "\u00a0\u3000", "  ")))

    return once(c, fold)


def without_spaces(c: Column) -> Column:
    """The key by which texts are aligned: no white space at all."""
    return F.regexp_replace(c, f"{_WS}+", "")


def without_blanks(c: Column) -> Column:
    """No ASCII and ideographic spaces."""
    return F.translate(c, " 　", "")


def tidy_markdown(c: Column) -> Column:
    """Drops leftovers of office markup, sets bold off from numbers, removes empty bold, limits empty lines."""
    out = F.regexp_replace(c, r"\[if !supportLists\]|\[endif\]|StartFragment|EndFragment", "")
    out = F.regexp_replace(out, r"(?m)^(\d+(?:\.\d+)*)(\*\*)", "$1 $2")
    out = F.regexp_replace(out, r"\*\*\*\*", "")
    return F.regexp_replace(out, r"\n{5,}", "\n\n\n\n")


def escape_line(c: Column) -> Column:
    """A backslash before lines that Markdown would take for a heading, quote, table or rule."""
    core = strip(c)
    rule = (F.length(core) >= 3) & core.rlike(r"^[-_*]+$")
    marked = c.rlike(f"^#{{1,6}}{_WS}") | c.startswith(">") | c.startswith("|")
    return F.when(marked | rule, F.concat(F.lit("\\"), c)).otherwise(c)


def table_cell(c: Column) -> Column:
    """A cell of a layout table: null is empty, ends stripped, pipes escaped, line breaks as <br>."""
    return F.replace(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def sheet_cell(c: Column) -> Column:
    """A cell of a sheet: pipes and angle brackets escaped."""
    out = F.replace(c, F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def number_text(v: Column, number_format: Column) -> Column:
    """A number as a sheet shows it: two decimals if its format says so, whole numbers without a point."""
    return (
        F.when(v.isNull(), F.lit(""))
        .when(F.coalesce(number_format, F.lit("")).contains(".00"), F.format_string("%.2f", v))
        .when(v == F.floor(v), v.cast("bigint").cast("string"))
        .otherwise(v.cast("string"))
    )


def string_text(c: Column) -> Column:
    """A string cell: line breaks as spaces, ends stripped, null empty."""
    return strip(F.translate(F.coalesce(c, F.lit("")), "\r\n", "  "))


def plain_title(c: Column) -> Column:
    """A heading without inline markup; a stand-in if nothing is left."""
    out = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)\s]+\)", "$1")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)\s]+\)", "$1")
    out = F.replace(F.replace(out, F.lit("**"), F.lit("")), F.lit("~~"), F.lit(""))
    out = F.regexp_replace(out, r"`([^`]*)`", "$1")
    out = strip(F.regexp_replace(out, r"(?<!\*)\*(?!\*)([^*]*)\*", "$1"))
    return F.when(out == "", F.lit(K.EMPTY_TITLE)).otherwise(out)


def safe_name(c: Column) -> Column:
    """A file name without characters that file systems refuse."""
    return F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f\x7f ]', "_")


def is_bold_font(c: Column) -> Column:
    """Whether a font's name says bold, also if its UTF-8 was read as Latin-1."""
    latin = ~c.rlike(r"[^\x{00}-\x{FF}]")
    raw = F.encode(F.when(latin, c).otherwise(F.lit("")), "ISO-8859-1")
    mended = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.lit(""))
    return F.coalesce(F.lower(c).rlike("bold|black|heavy") | mended.rlike("[黑粗]"), F.lit(False))


def is_separator_row(c: Column) -> Column:
    return (strip(c) != "") & strip(c).rlike(K.SEPARATOR_ROW)


def split_row(c: Column) -> Column:
    """Cells of a Markdown table row; a backslash keeps the next character, pipes included."""
    s = strip(c)
    s = F.regexp_replace(s, r"^\|", "")
    s = F.when(s.endswith("|") & ~s.endswith("\\|"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    # Escaped pipes step aside as a private-use character while the row is split.
    s = F.replace(s, F.lit("\\|"), F.lit("\ue000"))
    s = F.regexp_replace(s, r"\\(.)", "$1")
    return F.transform(F.split(s, r"\|", -1), lambda x: F.replace(strip(x), F.lit("\ue000"), F.lit("|")))


def front_matter_title(c: Column) -> Column:
    """The title of a leading block between lines of ---, without quotes; null if there is none."""
    block = F.regexp_extract(c, r"(?s)^---[^\n]*\n(.*?)\n---", 1)
    title = strip(F.regexp_extract(block, r"(?m)^title:[ \t]*(.*)$", 1))
    title = F.regexp_replace(title, r"""^(["'])(.*)\1$""", "$2")
    return F.when(title != "", title)


def auto_title(c: Column, stem: Column) -> Column:
    """Title of the front matter; none if the text opens with a first-level heading; else the file's stem."""
    opens = lstrip(c).rlike(r"^# ")
    return F.coalesce(front_matter_title(c), F.when(~opens, stem))


def curly_quotes(c: Column) -> Column:
    """A line's straight quotes in turn as opening and closing, if they are even in number and no comment is there."""
    parts = F.split(c, '"', -1)
    even = (F.size(parts) % 2 == 1) & ~c.contains("<!--")
    joined = F.aggregate(
        F.transform(parts, lambda x, i: F.concat(F.when(i == 0, F.lit("")).when(i % 2 == 1, F.lit("“")).otherwise(F.lit("”")), x)),
        F.lit(""),
        lambda a, x: F.concat(a, x),
    )
    return F.when(even, joined).otherwise(c)


def heading(level: Column, text: Column, anchor: Column) -> Column:
    """# marks, text, and an anchor if there is one."""
    mark = F.when(anchor.isNotNull() & (anchor != ""), F.concat(F.lit(' <a id="'), anchor, F.lit('"></a>'))).otherwise(F.lit(""))
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text, mark)


def numbered_heading_level(number: Column) -> Column:
    """1 -> 2, 1.1 -> 3, 1.1.1 -> 4."""
    return F.size(F.split(number, r"\.")) + 1


def figure_marks(c: Column) -> Column:
    """Comments that say which figure a page holds as image references; names in straight, curly or no quotes."""
    return F.regexp_replace(c, r"""<!--\s*本页含图[:：]\s*["“']?([^"”'>]*?)["”']?\s*-->""", "![$1]($1.png)")


def flat_media(c: Column, base: Column) -> Column:
    """References into base.files/media/ moved up to base.files/."""
    return F.replace(c, F.concat(base, F.lit(".files/media/")), F.concat(base, F.lit(".files/")))


def font_names(c: Column) -> Column:
    """Family names of a font's display name: the format in brackets goes, names are split at &."""
    bare = F.regexp_replace(c, r"\s*\((?:TrueType|OpenType|All res)\)\s*$", "")
    return F.filter(F.transform(F.split(bare, "&"), strip), lambda x: x != "")


def font_key(c: Column) -> Column:
    """What font names are compared by: no white space, lower case."""
    return F.lower(F.regexp_replace(c, f"[{_WS[1:-1]}_-]+", ""))


def fenced(c: Column, language: str) -> Column:
    """Contents of the first code fence of a language; empty if there is none."""
    return F.regexp_extract(c, rf"(?s)```{re.escape(language)}[ \t]*\n(.*?)```", 1)


def required_fence(c: Column, language: str) -> Column:
    """What the first fence of a language holds, without the blanks at its ends; an error if there is none or it is empty."""
    return once(strip(fenced(c, language)), lambda x: F.when(x != "", x).otherwise(F.raise_error(F.lit(f"no ```{language} block in the style"))))


def fence_entries(c: Column, language: str) -> Column:
    """Lines of the first fence of a language without blank and # lines."""
    return F.filter(F.transform(F.split(fenced(c, language), "\n"), strip), lambda x: (x != "") & ~x.startswith("#"))


def style_map(c: Column) -> Column:
    """The yaml fence as a map of dotted keys to values: two-space indents, one key a line."""
    lines = F.filter(F.split(fenced(c, "yaml"), "\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:") & ~strip(x).startswith("#"))
    empty = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        depth = F.floor(F.length(F.regexp_extract(line, r"^( *)", 1)) / 2).cast("int")
        key = F.regexp_extract(line, r"^\s*([\w-]+)\s*:", 1)
        value = F.regexp_replace(strip(F.regexp_extract(line, r":(.*)$", 1)), r"""^["'](.*)["']$""", "$1")
        path = F.concat(F.slice(acc["path"], F.lit(1), depth), F.array(key))
        entry = F.concat(F.concat_ws(".", path), F.lit("\u0001"), value)
        return F.struct(path.alias("path"), F.when(value == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(entry))).alias("out"))

    entries = F.aggregate(lines, empty, step, lambda acc: acc["out"])
    return F.map_from_entries(
        F.transform(entries, lambda e: F.struct(F.substring_index(e, "\u0001", 1), F.substring_index(e, "\u0001", -1)))
    )


def merged_style(defaults: Column, own: Column) -> Column:
    """Dotted keys of ``own`` over those of ``defaults``."""
    kept = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)


def line_spacing(points: Column, multiple: Column) -> Column:
    """A fixed spacing goes before a multiple one; single if neither is given."""
    return F.when(points.isNotNull(), F.concat(points.cast("string"), F.lit("pt"))).otherwise(
        F.concat(F.coalesce(multiple, F.lit(1.0)).cast("string"), F.lit("x"))
    )


def footer_parts(c: Column) -> Column:
    """What stands before and after the page number's place {N}."""
    return F.split(c, r"\{N\}", 2)


def pages_of(c: Column) -> Column:
    """Sorted distinct pages of a list like 1,3,5-7; null if it is malformed or a range falls."""
    bare = F.regexp_replace(c, r"\s+", "")
    bounds = F.transform(F.split(bare, ","), lambda p: F.transform(F.split(p, "-"), lambda x: x.try_cast("int")))
    good = bare.rlike(r"^\d+(-\d+)?(,\d+(-\d+)?)*$") & F.forall(bounds, lambda b: F.element_at(b, -1) >= F.element_at(b, 1))
    spread = F.flatten(F.transform(bounds, lambda b: F.sequence(F.element_at(b, 1), F.element_at(b, -1))))
    return F.when(good, F.array_sort(F.array_distinct(spread)))


def clamp_pages(first: Column, last: Column, total: Column) -> Column:
    """A page range within the document."""
    return F.struct(F.greatest(first, F.lit(1)).alias("first"), F.least(last, total).alias("last"))


def padded(n: Column, total: Column) -> Column:
    """A page number with leading zeros, at least two digits and as many as the last page has."""
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    text = n.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(text), F.lit(0))), text)


def crop_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Pixel box of a box in shares of the page; null unless 0 <= left < right <= 1 and likewise down."""
    good = (left >= 0) & (left < right) & (right <= 1) & (top >= 0) & (top < bottom) & (bottom <= 1)
    cell = lambda share, size, name: (share * size).cast("int").alias(name)
    return F.when(
        good, F.struct(cell(left, width, "x0"), cell(top, height, "y0"), cell(right, width, "x1"), cell(bottom, height, "y1"))
    )


def fitted_width(width: Column, height: Column) -> Column:
    """Inches an image is wide if it may be 6 by 8.5 inches at most and is never enlarged."""
    w, h = width / K.INCH_DOTS, height / K.INCH_DOTS
    return w * F.least(F.lit(1.0), F.lit(K.MAX_HEIGHT_IN) / h, F.lit(K.MAX_WIDTH_IN) / w)


def pdf_pages(content: Column) -> Column:
    """Pages that a PDF's bytes declare, at least one; null if they are no PDF."""
    body = F.decode(content, "ISO-8859-1")
    return F.when(body.startswith("%PDF-"), F.greatest(F.regexp_count(body, F.lit(r"/Type\s*/Page(?!s)")), F.lit(1)))


def title_patterns(patterns: list[str], c: Column) -> Column:
    """Whether any user pattern matches; malformed ones are refused here, on the driver."""
    for p in patterns:
        re.compile(p)
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def inline_tokens(c: Column) -> Column:
    """Inline runs of Markdown as array<struct<kind, text>>, plain stretches included."""
    gaps = F.split(c, K.INLINE, -1)
    tokens = F.regexp_extract_all(c, F.lit(K.INLINE), F.lit(0))

    def run(t: Column) -> Column:
        kind = (
            F.when(t.startswith("**"), F.lit("bold"))
            .when(t.startswith("~~"), F.lit("strike"))
            .when(t.startswith("`"), F.lit("code"))
            .when(t.startswith("*"), F.lit("italic"))
            .when(t.startswith("!["), F.lit("image"))
            .when(t.startswith("["), F.lit("link"))
            .when(t.startswith("<br"), F.lit("break"))
            .otherwise(F.lit("text"))
        )
        text = (
            F.when(kind.isin("bold", "strike"), F.substring(t, F.lit(3), F.length(t) - 4))
            .when(kind.isin("code", "italic"), F.substring(t, F.lit(2), F.length(t) - 2))
            .when(kind.isin("image", "link"), F.regexp_extract(t, r"^!?\[([^\]]*)\]", 1))
            .when(kind == "break", F.lit(""))
            .otherwise(F.replace(t, F.lit("&nbsp;"), F.lit(" ")))
        )
        href = F.regexp_extract(t, r"^!?\[[^\]]*\]\(([^)\s]+)\)$", 1)
        return F.struct(kind.alias("kind"), text.alias("text"), href.alias("href"))

    plain = lambda g: F.struct(F.lit("text").alias("kind"), g.alias("text"), F.lit("").alias("href"))
    pairs = F.transform(gaps, lambda g, i: F.array(plain(g), F.when(i < F.size(tokens), run(F.get(tokens, i)))))
    return F.filter(F.flatten(pairs), lambda r: r.isNotNull() & ((r["text"] != "") | (r["kind"] != "text")))
