"""Page layouts: lines, fonts, footers, headings, table geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import escape_line, is_bold_font, strip, title_patterns, without_blanks


def lines_of_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, txt, size, bold): a line's text, the size of its longest span (the first of equals), and whether over
    80 % of its characters are bold. spans: keys, span, text, size, font."""
    n = F.length(strip(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("span", "text")))
    bold = F.sum(F.when(is_bold_font(F.col("font")), n).otherwise(0)) / F.sum(n) > 0.8
    out = spans.groupBy(*keys).agg(
        F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("txt"),
        F.max_by("size", F.struct(n, -F.col("span"))).alias("size"),
        F.coalesce(bold, F.lit(False)).alias("bold"),
    )
    return out.where(strip(F.col("txt")) != "")


def body_size(spans: DataFrame, key: str) -> DataFrame:
    """(key, body_size): the rounded size that most characters have, the smaller of equals."""
    sizes = spans.groupBy(key, F.round("size", 1).alias("size")).agg(F.sum(F.length(strip(F.col("text")))).alias("n"))
    return sizes.groupBy(key).agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body_size"))


def fonts_of(spans: DataFrame, key: str, pages: int = 5, most: int = 8) -> DataFrame:
    """(key, fonts): sorted font names of the first pages."""
    return spans.where(F.col("page") <= pages).groupBy(key).agg(F.slice(F.array_sort(F.collect_set("font")), 1, most).alias("fonts"))


def with_footers(lines: DataFrame) -> DataFrame:
    """Adds is_footer, doc_page and doc_total: marks of page x of y, and bare numbers in the middle of a page's edge.

    lines: txt, x0, x1, y0, y1, width, height.
    """
    txt = F.col("txt")
    marked = txt.rlike(K.PAGE_OF_PAGES)
    of_pages = marked & (txt.contains(K.PRINT_DATE) | txt.rlike(f"^{K.PAGE_OF_PAGES}$"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    edge = cx.between(0.3 * F.col("width"), 0.7 * F.col("width")) & ((cy < 0.10 * F.col("height")) | (cy > 0.90 * F.col("height")))
    bare = txt.rlike(K.BARE_PAGE_NUMBER) & edge
    dated = txt.startswith(K.PRINT_DATE)
    page = F.when(of_pages, F.regexp_extract(txt, K.PAGE_OF_PAGES, 1)).when(bare, F.regexp_extract(txt, r"(\d{1,4})", 1))
    total = F.when(of_pages, F.regexp_extract(txt, K.PAGE_OF_PAGES, 2))
    return lines.withColumns({"is_footer": of_pages | dated | bare, "doc_page": page.try_cast("int"), "doc_total": total.try_cast("int")})


def heading_level(txt: Column, size: Column, bold: Column, body: Column, patterns: list[str] = [], documented: bool = False) -> Column:  # noqa: B006
    """2 for lines a point above the body, 3 for short bold ones; else by pattern 3 (never lower, unless ``documented``
    gives sections 2 and subsections 3). Lines that read like body text get null, unless a user pattern matches."""
    n = without_blanks(txt)
    level = F.when(size >= body + 1, F.lit(2)).when(bold & (size >= body) & (F.length(n) <= K.BOLD_HEADING_MAX_CHARS), F.lit(3))
    sections = title_patterns(list(K.HEADING_SECTIONS), n)
    subs = title_patterns(list(K.HEADING_SUBSECTIONS), n)
    level = F.coalesce(level, F.when(sections, F.lit(2 if documented else 3)).when(subs, F.lit(3 if documented else None).cast("int")))
    bad = F.lit(False)
    for start in K.BODY_STARTS:
        bad = bad | n.startswith(start)
    body_like = (F.length(n) > K.HEADING_MAX_CHARS) | bad | n.rlike(K.BODY_SIGNS) | n.contains("..") | n.contains("……")
    return F.when(title_patterns(patterns, n), F.lit(2)).when(~body_like, level)


def nested_tables(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Tables that lie in no other of their page; equal boxes remove each other. tables: keys, tbl, x0, y0, x1, y1."""
    o = tables.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(c).alias(f"o_{c}") for c in ("tbl", "x0", "y0", "x1", "y1")])
    inside = (
        (F.col("x0") >= F.col("o_x0")) & (F.col("y0") >= F.col("o_y0")) & (F.col("x1") <= F.col("o_x1"))
        & (F.col("y1") <= F.col("o_y1")) & (F.col("tbl") != F.col("o_tbl"))
    )
    same = [F.col(k) == F.col(f"o_{k}") for k in keys]
    return tables.join(o, [*same, inside], "left_anti")


def _centre_in(box: str, slack: float = 1.0) -> Column:
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return cx.between(F.col(f"{box}x0") - slack, F.col(f"{box}x1") + slack) & cy.between(F.col(f"{box}y0") - slack, F.col(f"{box}y1") + slack)


def _boxes(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *[F.col(c).alias(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")])


def _within(lines: DataFrame, boxes: DataFrame, keys: list[str], how: str) -> DataFrame:
    b = _boxes(boxes, keys, "b_")
    return lines.join(b, [*[F.col(k) == F.col(f"b_{k}") for k in keys], _centre_in("b_")], how)


def uncovered_pages(lines: DataFrame, tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Pages (keys) on which a line lies in a table but in none of its cells, by a point: they fall back to plain lines."""
    return _within(_within(lines, tables, keys, "left_semi"), cells, keys, "left_anti").select(*keys).distinct()


def lines_outside(lines: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Lines whose centre lies in no accepted table."""
    return _within(lines, tables, keys, "left_anti")


def assembled(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, md): a page's lines and tables from top to bottom; an empty line where the gap is over 20 points, and
    around tables. elements: keys, y0, x0, y1, is_table, md."""
    w = Window.partitionBy(*keys).orderBy("y0", "x0", "md")
    wide = (F.col("y0") - F.lag("y1").over(w)) > K.LINE_GAP
    table_near = F.col("is_table") | F.lag("is_table", 1, False).over(w)
    e = elements.withColumn("_gap", F.coalesce(wide, F.lit(False)) | (table_near & F.lag("y1").over(w).isNotNull()))
    e = e.withColumn("_n", F.row_number().over(w))
    rows = F.array_sort(F.collect_list(F.struct("_n", F.when(F.col("_gap"), F.concat(F.lit("\n"), F.col("md"))).otherwise(F.col("md")).alias("md"))))
    return e.groupBy(*keys).agg(F.concat_ws("\n", F.transform(rows, lambda r: r["md"])).alias("md"))


def line_markdown(txt: Column, level: Column) -> Column:
    return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), txt)).otherwise(escape_line(txt))


def page_mapping(pages: DataFrame, key: str) -> DataFrame:
    """(key, n_pages, n_mapped, offset, missing): whether printed page numbers differ from the file's by one offset, and
    pages without one. pages: key, page, doc_page."""
    diff = F.col("doc_page") - F.col("page")
    out = pages.groupBy(key).agg(
        F.count("*").alias("n_pages"),
        F.count("doc_page").alias("n_mapped"),
        F.collect_set(diff).alias("_diffs"),
        F.array_sort(F.collect_list(F.when(F.col("doc_page").isNull(), F.col("page")))).alias("missing"),
    )
    return out.withColumn("offset", F.when(F.size("_diffs") == 1, F.get("_diffs", F.lit(0)))).drop("_diffs")


def front_matter(docs: DataFrame, run_date: str) -> DataFrame:
    """Adds header: the front matter and note that open an extracted document. docs: name, n_pages, tables, offset, missing."""
    offset = F.coalesce(F.col("offset").cast("string"), F.lit("none"))
    missing = F.when(F.size("missing") == 0, F.lit(K.NOTHING)).otherwise(F.concat_ws(",", F.transform("missing", lambda p: p.cast("string"))))
    return docs.withColumn(
        "header",
        F.concat_ws(
            "\n", F.lit("---"), F.concat(F.lit("title: "), F.col("name")), F.lit(f"date: {run_date}"),
            F.concat(F.lit("pages: "), F.col("n_pages").cast("string")), F.lit("---"), F.lit(""),
            F.concat(F.lit("> Page offset: "), offset, F.lit("; without number: "), missing, F.lit("; tables: "), F.col("tables").cast("string")),
        ),
    )


def full_page_image(images: DataFrame, keys: list[str], cover: float = K.FULL_PAGE_COVER) -> DataFrame:
    """Per page the image that covers at least ``cover`` of it, the largest by cover and area. images: keys, img, cover, area."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cover"), F.desc("area"), "img"))
    return images.where(F.col("cover") >= cover).withColumn("_n", nth).where("_n = 1").drop("_n")


def extraction_summary(pages: DataFrame, headings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_pages, n_tables, fallback_pages, garbled_pages, n_footers, n_headings): what came out of a document.

    pages: keys, page, n_tables, falls_back, garbled, has_footer. headings: keys, level; those of level 2 count.
    """
    pick = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("page"))))
    out = pages.groupBy(*keys).agg(
        F.count("*").alias("n_pages"),
        F.coalesce(F.sum("n_tables"), F.lit(0)).alias("n_tables"),
        pick("falls_back").alias("fallback_pages"),
        pick("garbled").alias("garbled_pages"),
        F.count_if("has_footer").alias("n_footers"),
    )
    chapters = headings.where("level = 2").groupBy(*keys).agg(F.count("*").alias("n_headings"))
    return out.join(chapters, keys, "left").withColumn("n_headings", F.coalesce("n_headings", F.lit(0)))
