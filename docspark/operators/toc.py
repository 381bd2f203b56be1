"""Tables of contents: extraction, matching to headings, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import strip, without_spaces


def office_entries(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, seq, level, anchor, label, page): paragraphs of the office classes, with the page that stands in their
    field comments. Comments must still be there."""
    block = rf"(?is)<p[^>]*class=[\"']?{K.TOC_CLASS}[\"']?[^>]*>.*?</p>"
    rows = docs.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(block), F.lit(0))).alias("seq", "p"))
    bare = F.regexp_replace(F.regexp_replace("p", r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")
    page = F.regexp_extract(F.regexp_replace("p", r"<[^>!]*>", ""), r"(\d+)\s*(?:<!--.*?-->\s*)*$", 1)
    return rows.select(
        key,
        "seq",
        F.regexp_extract("p", rf"(?i){K.TOC_CLASS}", 1).cast("int").alias("level"),
        F.regexp_extract("p", r"(?i)href=[\"']?#?(_Toc\d+)", 1).alias("anchor"),
        strip(F.regexp_replace(bare, r"[.\s…]*\d*\s*$", "")).alias("label"),
        F.when(page != "", page).alias("page"),
    )


def entry_parts(label: Column) -> Column:
    """struct<number, title>: a chapter mark or dotted digits before white space are the number."""
    number = F.regexp_extract(label, K.TOC_NUMBER, 1)
    return F.struct(
        F.when(number != "", number).alias("number"),
        F.when(number != "", F.regexp_extract(label, K.TOC_NUMBER, 2)).otherwise(label).alias("title"),
    )


def longest_link_run(paragraphs: DataFrame, headings: DataFrame, key: str, least: int = K.TOC_MIN_RUN) -> DataFrame:
    """(key, seq, anchor, label) of the longest run of neighbouring paragraphs that are nothing but a link to a heading.

    paragraphs: key, seq, anchor (null unless the paragraph is one link), label. headings: key, anchor. Runs under
    ``least`` don't count; of equals the first is taken.
    """
    hits = paragraphs.where("anchor IS NOT NULL").join(headings.select(key, "anchor").distinct(), [key, "anchor"], "left_semi")
    w = Window.partitionBy(key).orderBy("seq")
    runs = hits.withColumn("_run", F.col("seq") - F.row_number().over(w))
    one = Window.partitionBy(key, "_run")
    runs = runs.withColumn("_n", F.count("*").over(one)).withColumn("_start", F.min("seq").over(one)).where(F.col("_n") >= least)
    best = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("_n"), "_start"))
    return runs.withColumn("_best", best).where("_best = 1").select(key, "seq", "anchor", "label")


def entries_to_headings(entries: DataFrame, headings: DataFrame, key: str) -> DataFrame:
    """(key, seq, number, title, heading_seq, matched): each entry's heading, by anchor, else by a title that only one
    heading has; a heading is used once, by the first entry. matched: anchor, title, already (numbered) or null.

    entries: key, seq, anchor, number, title. headings: key, seq, anchor, text.
    """
    title_key = without_spaces(F.col("title"))
    h = headings.select(key, F.col("seq").alias("heading_seq"), F.col("anchor").alias("h_anchor"), F.col("text").alias("h_text"))
    h = h.withColumn("h_key", without_spaces(F.regexp_replace("h_text", r"^\d+(?:\.\d+)*\s*", "")))
    by_anchor = h.where("h_anchor IS NOT NULL AND h_anchor <> ''")
    first = F.row_number().over(Window.partitionBy(key, "h_anchor").orderBy("heading_seq"))
    by_anchor = by_anchor.withColumn("_n", first).where("_n = 1").select(key, F.col("h_anchor").alias("anchor"), F.col("heading_seq").alias("a_seq"), F.col("h_text").alias("a_text"))
    by_title = h.groupBy(key, F.col("h_key").alias("_key")).agg(F.count("*").alias("_n"), F.min("heading_seq").alias("t_seq"), F.min("h_text").alias("t_text")).where("_n = 1").drop("_n")
    e = entries.withColumn("_key", title_key).join(by_anchor, [key, "anchor"], "left").join(by_title, [key, "_key"], "left")
    e = e.withColumn("heading_seq", F.coalesce("a_seq", "t_seq")).withColumn("_text", F.coalesce("a_text", "t_text"))
    nth = F.row_number().over(Window.partitionBy(key, "heading_seq").orderBy("seq"))
    e = e.withColumn("_nth", F.when(F.col("heading_seq").isNotNull(), nth))
    used = F.col("heading_seq").isNotNull() & (F.col("_nth") == 1)
    matched = (
        F.when(used & already_numbered(F.col("_text"), F.col("number")), F.lit("already"))
        .when(used & F.col("a_seq").isNotNull(), F.lit("anchor"))
        .when(used, F.lit("title"))
    )
    return e.select(key, "seq", "number", "title", F.when(used, F.col("heading_seq")).alias("heading_seq"), matched.alias("matched"))


def already_numbered(text: Column, number: Column) -> Column:
    """Whether a heading begins with the number, and not as part of a longer one."""
    after = F.substring(text, F.length(number) + 1, F.lit(1))
    return F.coalesce(text.startswith(number) & ~after.rlike(r"[\d.]"), F.lit(False))


def rendered_entries(entries: DataFrame, key: str) -> DataFrame:
    """(key, toc): entries as a nested list of links with their pages."""
    label = F.concat_ws(" ", "number", "title")
    link = F.when(F.coalesce("anchor", F.lit("")) != "", F.concat(F.lit("["), label, F.lit("](#"), F.col("anchor"), F.lit(")"))).otherwise(label)
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(" · "), F.col("page"))).otherwise(F.lit(""))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), link, page)
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return entries.groupBy(key).agg(F.concat_ws("\n", F.transform(rows, lambda r: r["line"])).alias("toc"))


def placed(text: Column, placeholder: str, toc: Column) -> Column:
    """The text with the first placeholder replaced and the others removed."""
    parts = F.split(text, placeholder, -1) if placeholder.isalnum() else F.split(text, rf"\Q{placeholder}\E", -1)
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "")
    return F.when(F.size(parts) > 1, F.concat(F.get(parts, 0), F.coalesce(toc, F.lit("")), rest)).otherwise(text)
