"""Operators on the lines of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import lstrip, rstrip, strip


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lineno from 1, line): one row per line of a text."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("lineno", "line")).withColumn("lineno", F.col("lineno") + 1)


def in_order(key: str):
    return Window.partitionBy(key).orderBy("lineno")


def with_fences(lines: DataFrame, key: str) -> DataFrame:
    """Adds is_fence, and in_code: whether an odd number of fences stands above."""
    fence = strip(F.col("line")).startswith("```")
    above = in_order(key).rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("is_fence", fence)
    return lines.withColumn("in_code", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(above), F.lit(0)) % 2 == 1)


def joined(lines: DataFrame, key: str, column: str = "line", name: str = "text", count: str | None = None) -> DataFrame:
    """Lines put together in order, and their number as ``count`` if that is named; the array is as large as the document."""
    pairs = F.array_sort(F.collect_list(F.struct("lineno", column)))
    text = F.concat_ws("\n", F.transform(pairs, lambda p: p[column])).alias(name)
    return lines.groupBy(key).agg(text, *([F.count("*").alias(count)] if count else []))


def without_indents(lines: DataFrame, key: str) -> DataFrame:
    """Leading white space goes outside code, except before list items, quotes and tables; so does trailing."""
    line = F.col("line")
    kept = line.rlike(rf"^{K.WS}*(?:[-*+]|\d+\.|>|\|)")
    out = F.when(F.col("is_fence") | F.col("in_code"), line).when(kept, rstrip(line)).otherwise(rstrip(lstrip(line)))
    return with_fences(lines, key).withColumn("line", out).drop("is_fence", "in_code")


def captions_into_images(lines: DataFrame, key: str) -> DataFrame:
    """An image line takes the next line that isn't blank as its alt text, if that is a caption."""
    line = F.col("line")
    # Read upwards: a frame down to the last line would be gone through anew for every line.
    below = Window.partitionBy(key).orderBy(F.desc("lineno")).rowsBetween(Window.unboundedPreceding, -1)
    bare = strip(line)
    lines = lines.withColumn("_next", F.last(F.when(bare != "", bare), ignorenulls=True).over(below))
    caption = F.translate(strip(F.regexp_extract("_next", K.CAPTION, 1)), "[]", "（）")
    is_image = line.rlike(K.IMAGE_LINE) & F.col("_next").rlike(K.CAPTION)
    new = F.concat(F.lit("!["), caption, F.lit("]("), F.regexp_extract(line, K.IMAGE_LINE, 2), F.lit(")"))
    return lines.withColumn("line", F.when(F.coalesce(is_image, F.lit(False)), new).otherwise(line)).drop("_next")


def image_texts_placed(lines: DataFrame, images: DataFrame, key: str, keep_missing: bool = True) -> DataFrame:
    """Image lines replaced by what was read from the image. images: key, src, md. Lines of images without a text
    stay, or go if they are not to be kept."""
    src = F.when(F.col("line").rlike(K.IMAGE_LINE), F.regexp_extract("line", K.IMAGE_LINE, 2))
    found = lines.withColumn("src", src).join(images.select(key, "src", "md"), [key, "src"], "left")
    if not keep_missing:
        found = found.where("src IS NULL OR md IS NOT NULL")
    return found.select(key, "lineno", F.coalesce("md", "line").alias("line"))


def glued_tokens(lines: DataFrame, key: str) -> DataFrame:
    """(key, lineno, token, context): long tokens in which words or numbers ran together, first place in each document."""
    tokens = lines.where(~F.col("line").rlike(K.SKIPPED_LINE)).select(
        key, "lineno", "line", F.posexplode(F.regexp_extract_all("line", F.lit(K.GLUED_TOKEN), F.lit(0))).alias("pos", "token")
    )
    first = F.row_number().over(Window.partitionBy(key, "token").orderBy("lineno", "pos"))
    found = tokens.where(F.col("token").rlike(K.GLUE)).withColumn("_n", first).where("_n = 1")
    return found.select(key, "lineno", "token", F.substring(strip(F.col("line")), 1, 60).alias("context"))


def soft_breaks(lines: DataFrame, key: str) -> DataFrame:
    """(key, lineno, tail, head): a line that ends in a word before one that begins with one."""
    cur, nxt = rstrip(F.col("line")), lstrip(F.lead("line").over(in_order(key)))
    pairs = lines.select(key, "lineno", cur.alias("cur"), nxt.alias("nxt")).where("nxt IS NOT NULL")
    good = ~F.col("cur").rlike(K.SKIPPED_LINE) & ~F.col("nxt").rlike(K.SKIPPED_LINE)
    hit = pairs.where(good & F.col("cur").rlike(K.TAIL_WORD) & F.col("nxt").rlike(K.HEAD_WORD))
    tail = F.substring(F.col("cur"), F.greatest(F.length("cur") - 39, F.lit(1)), F.lit(40))
    return hit.select(key, "lineno", tail.alias("tail"), F.substring("nxt", 1, 20).alias("head"))


def residues(lines: DataFrame, key: str) -> DataFrame:
    """(key, lineno, kind, context): leftovers of fields and styles, numbers and captions glued to text, outside code."""
    line, bare = F.col("line"), strip(F.col("line"))
    kind = (
        F.when(line.rlike(K.RESIDUE), F.lit("residue"))
        .when(bare.rlike(K.GLUED_NUMBER) & ~line.rlike(K.SKIPPED_LINE), F.lit("glued number"))
        .when(bare.rlike(K.GLUED_CAPTION), F.lit("glued caption"))
    )
    out = with_fences(lines, key).where("NOT is_fence AND NOT in_code").withColumn("kind", kind).where("kind IS NOT NULL")
    return out.select(key, "lineno", "kind", F.substring(bare, 1, 60).alias("context"))


def checklist(lines: DataFrame, key: str, missed: DataFrame | None = None) -> DataFrame:
    """(key, report): a document's findings in sections; an empty section says so. missed: key, context."""
    parts = [
        ("Glued tokens", glued_tokens(lines, key).select(key, "lineno", F.concat_ws(": ", "token", "context").alias("entry"))),
        ("Broken lines", soft_breaks(lines, key).select(key, "lineno", F.concat_ws(" / ", "tail", "head").alias("entry"))),
        ("Residues", residues(lines, key).select(key, "lineno", F.concat_ws(": ", "kind", "context").alias("entry"))),
    ]
    if missed is not None:
        parts.append(("Missed numbers", missed.select(key, F.lit(0).alias("lineno"), F.col("context").alias("entry"))))
    found = None
    for i, (_, part) in enumerate(parts):
        part = part.withColumn("section", F.lit(i))
        found = part if found is None else found.unionByName(part)
    written = F.concat(F.lit("- line "), F.col("lineno").cast("string"), F.lit(": "), F.col("entry"))
    found = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "lineno", written.alias("text")))).alias("all"))
    docs = lines.select(key).distinct().join(found, key, "left")

    def section(i: int, title: str) -> Column:
        own = F.filter(F.coalesce("all", F.array().cast("array<struct<section:int,lineno:int,text:string>>")), lambda e: e["section"] == i)
        body = F.when(F.size(own) == 0, F.lit(K.NOTHING)).otherwise(F.concat_ws("\n", F.transform(own, lambda e: e["text"])))
        return F.concat(F.lit(f"## {title}\n\n"), body)

    return docs.select(key, F.concat_ws("\n\n", *[section(i, t) for i, (t, _) in enumerate(parts)]).alias("report"))
