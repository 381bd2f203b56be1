"""Markdown blocks from lines."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import inline_tokens, is_separator_row, split_row, strip
from .lines import in_order


def classified(lines: DataFrame, key: str) -> DataFrame:
    """Adds kind to each line: code, blank, date, attachment, heading, rule, table, image, quote, bullet, ordered, paragraph.

    The front matter, if the document opens with one, is left out.
    """
    line = F.col("line")
    w = in_order(key)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.max((F.col("lineno") == 1) & (strip(line) == "---")).over(Window.partitionBy(key).orderBy("lineno").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    closing = (F.col("lineno") > 1) & (strip(line) == "---")
    closed = F.coalesce(F.sum(closing.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    last_close = F.max(closing).over(Window.partitionBy(key))
    lines = lines.where("TRUE").withColumn("_skip", opens & last_close & ~closed)
    lines = lines.where("NOT _skip").drop("_skip")
    lines = lines.withColumn("is_fence", line.rlike(K.FENCE))
    # A fence line closes what the odd number of fences above it opened.
    inside = F.coalesce(F.sum(F.col("is_fence").cast("int")).over(running), F.lit(0)) % 2 == 1
    table_row = strip(line).startswith("|")
    kind = (
        F.when(F.col("is_fence") | F.col("_inside"), F.lit("code"))
        .when(strip(line) == "", F.lit("blank"))
        .when(line.rlike(K.DATE_BLOCK), F.lit("date"))
        .when(line.rlike(K.ATTACHMENT_BLOCK), F.lit("attachment"))
        .when(line.rlike(K.ATX), F.lit("heading"))
        .when(line.rlike(K.RULE), F.lit("rule"))
        .when(table_row, F.lit("table"))
        .when(line.rlike(K.IMAGE_BLOCK), F.lit("image"))
        .when(line.rlike(K.QUOTE), F.lit("quote"))
        .when(line.rlike(K.BULLET), F.lit("bullet"))
        .when(line.rlike(K.ORDERED), F.lit("ordered"))
        .otherwise(F.lit("paragraph"))
    )
    return lines.withColumn("_inside", inside).withColumn("kind", kind).drop("_inside")


#: Kinds whose neighbouring lines make one block.
GROUPED = ("code", "table", "quote", "ordered", "bullet")


def blocks(lines: DataFrame, key: str) -> DataFrame:
    """(key, block from 1, kind, first_line, n_lines, level, text) in order, blank lines left out.

    Neighbouring lines of code, table, quote and list kinds are one block; a second fenced block starts anew.
    """
    w = in_order(key)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = classified(lines, key)
    was_close = F.lag(F.col("is_fence") & (F.col("_depth") % 2 == 0), 1, False).over(w)
    c = c.withColumn("_depth", F.sum(F.col("is_fence").cast("int")).over(running))
    same = (F.lag("kind").over(w) == F.col("kind")) & F.col("kind").isin(*GROUPED) & ~was_close
    c = c.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
    c = c.withColumn("_block", F.sum("_new").over(running)).where("kind <> 'blank'")
    level = F.length(F.regexp_extract("line", K.ATX, 1))
    text = (
        F.when(F.col("kind") == "heading", F.coalesce(F.regexp_extract("line", K.ATX, 2), F.lit("")))
        .when(F.col("kind") == "quote", F.regexp_replace("line", r"^\s*>+\s?", ""))
        .when(F.col("kind") == "bullet", F.regexp_extract("line", K.BULLET, 1))
        .when(F.col("kind") == "ordered", F.regexp_extract("line", K.ORDERED, 2))
        .when(F.col("kind") == "date", F.regexp_extract("line", K.DATE_BLOCK, 1))
        .when(F.col("kind") == "attachment", F.regexp_extract("line", K.ATTACHMENT_BLOCK, 1))
        .otherwise(F.col("line"))
    )
    c = c.withColumn("_text", text).withColumn("_level", level)
    out = c.groupBy(key, "_block", "kind").agg(
        F.min("lineno").alias("first_line"),
        F.count("*").alias("n_lines"),
        F.max("_level").alias("level"),
        F.array_sort(F.collect_list(F.struct("lineno", "_text"))).alias("_all"),
    )
    nth = F.row_number().over(Window.partitionBy(key).orderBy("first_line"))
    return out.select(
        key, nth.alias("block"), "kind", "first_line", "n_lines", "level",
        F.concat_ws("\n", F.transform("_all", lambda p: p["_text"])).alias("text"),
    )


def inline_html(line: Column) -> Column:
    """Inline Markdown as HTML; text is escaped."""

    def escaped(c: Column) -> Column:
        for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
            c = F.replace(c, F.lit(sign), F.lit(f"&{name};"))
        return c

    def tag(t: Column) -> Column:
        text, kind = escaped(t["text"]), t["kind"]
        out = F.when(kind == "break", F.lit("<br>"))
        for name, element in (("bold", "strong"), ("italic", "em"), ("strike", "del"), ("code", "code")):
            out = out.when(kind == name, F.concat(F.lit(f"<{element}>"), text, F.lit(f"</{element}>")))
        out = out.when(kind == "link", F.concat(F.lit('<a href="'), escaped(t["href"]), F.lit('">'), text, F.lit("</a>")))
        out = out.when(kind == "image", F.concat(F.lit('<img src="'), escaped(t["href"]), F.lit('" alt="'), text, F.lit('">')))
        return out.otherwise(text)

    return F.concat_ws("", F.transform(inline_tokens(line), tag))


def html_documents(blocks: DataFrame, key: str, css: str = "", title: str = "") -> DataFrame:
    """(key, html): Markdown blocks as one page with a style sheet, as a browser prints them. blocks: as :func:`blocks`
    gives them. The first row of a table is its head and the rule below it goes; code is shown as it is."""
    lines = F.split("text", "\n", -1)
    wrapped = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    items = lambda a, b: F.concat_ws("", F.transform(lines, lambda x: wrapped(a, inline_html(x), b)))
    row = lambda x, e: wrapped("<tr>", F.concat_ws("", F.transform(split_row(x), lambda c: wrapped(f"<{e}>", inline_html(c), f"</{e}>"))), "</tr>")
    body = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~is_separator_row(x))
    table = wrapped("<table>", F.concat(row(F.get(lines, F.lit(0)), "th"), F.concat_ws("", F.transform(body, lambda x: row(x, "td")))), "</table>")
    plain = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    code = wrapped("<pre><code>", F.regexp_replace(plain, r"^\s*(?:```|~~~)[^\n]*\n?|\n?\s*(?:```|~~~)\s*$", ""), "</code></pre>")
    level = F.coalesce(F.col("level"), F.lit(1)).cast("string")
    heading = F.concat(F.lit("<h"), level, F.lit(">"), inline_html(F.col("text")), F.lit("</h"), level, F.lit(">"))
    kind = F.col("kind")
    html = (
        F.when(kind == "heading", heading)
        .when(kind == "table", table)
        .when(kind == "code", code)
        .when(kind == "rule", F.lit("<hr>"))
        .when(kind == "bullet", wrapped("<ul>", items("<li>", "</li>"), "</ul>"))
        .when(kind == "ordered", wrapped("<ol>", items("<li>", "</li>"), "</ol>"))
        .when(kind == "quote", wrapped("<blockquote>", items("<p>", "</p>"), "</blockquote>"))
        .otherwise(wrapped("<p>", inline_html(F.col("text")), "</p>"))
    )
    parts = blocks.select(key, F.col("block").alias("_block"), html.alias("_html"))
    out = document_order(parts, key, ["_block"], "_html", "\n")
    head = f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{escape(title)}</title><style>\n{css}\n</style></head><body>\n'
    return out.select(key, F.concat(F.lit(head), F.col("text"), F.lit("\n</body></html>\n")).alias("html"))


def renumbered(lines: DataFrame, key: str) -> DataFrame:
    """Items of ordered lists with numbers from 1 in each run, whatever the source says: (key, lineno, number, text)."""
    c = classified(lines, key)
    w = in_order(key)
    new = F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lit(True))
    c = c.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    items = c.where("kind = 'ordered'")
    number = F.row_number().over(Window.partitionBy(key, "_run").orderBy("lineno"))
    return items.select(key, "lineno", number.alias("number"), F.regexp_extract("line", K.ORDERED, 2).alias("text"))


def document_order(parts: DataFrame, key: str, order: list[str], text: str, separator: str = "\n\n") -> DataFrame:
    """Parts of a document (pages, turns) joined in order; each array is as large as its document."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_text"))))
    return parts.groupBy(key).agg(F.concat_ws(separator, F.transform(rows, lambda r: r["_text"])).alias("text"), F.count("*").alias("n_parts"))
