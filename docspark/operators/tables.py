"""Tables: grids, rendering, continuation rows, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import once, sheet_cell, strip, table_cell


def row_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", cells), F.lit(" |"))


def rendered_rows(rows: Column) -> Column:
    """Markdown of array<array<string>>: cells cleaned, empty rows dropped, short rows padded, a separator below
    the first; null if nothing is left."""
    clean = F.transform(rows, lambda r: F.transform(r, table_cell))

    def render(full: Column, width: Column) -> Column:
        line = lambda r: row_line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        rest = F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0)))
        head = F.array(line(F.get(full, 0)), F.concat(F.lit("|"), F.repeat(F.lit("---|"), width)))
        return F.when(F.size(full) > 0, F.concat_ws("\n", F.concat(head, F.transform(rest, line))))

    # Cells are cleaned once, and the width is found once, not for every row anew.
    full = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    return once(full, lambda f: once(F.array_max(F.transform(f, F.size)), lambda w: render(f, w)))


def table_candidates(tables: DataFrame) -> DataFrame:
    """At least two rows and two to twelve columns: n_rows, n_cols."""
    return tables.where("n_rows >= 2 AND n_cols BETWEEN 2 AND 12")


def pseudo_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, filled_share, longest, is_pseudo): text that merely looks like a table has at most half of its columns
    filled and no cell over 60 characters. cells: keys, c, n_cols, text."""
    t = strip(F.coalesce("text", F.lit("")))
    out = cells.groupBy(*keys).agg(
        (F.count_distinct(F.when(t != "", F.col("c"))) / F.max("n_cols")).alias("filled_share"), F.max(F.length(t)).alias("longest")
    )
    return out.withColumn("is_pseudo", (F.col("filled_share") <= 0.5) & (F.col("longest") <= 60))


def merged_continuations(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, c, text): rows without a first cell are what others were broken into, and go back to them.

    cells: keys, r, c, text for the data rows, every r with every c. A piece between two rows belongs, column by
    column, to the row below if the row above has text there (also if it got some) and the row below has none,
    else to the row above; without a row below or above it goes to the one there is. Pieces are joined by <br>.
    """
    text = strip(F.coalesce("text", F.lit("")))
    by_row = Window.partitionBy(*keys, "r")
    d = cells.select(*keys, "r", "c", text.alias("text"))
    d = d.withColumn("_anchor", F.max(F.when((F.col("c") == 0) & (F.col("text") != ""), 1).otherwise(0)).over(by_row))
    # Number of the anchor at or above each row, by column.
    w = Window.partitionBy(*keys, "c").orderBy("r")
    d = d.withColumn("_a", F.sum("_anchor").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.when((F.col("_anchor") == 0) & (F.col("text") != ""), F.struct("r", "text"))))
    own = d.groupBy(*keys, "c", "_a").agg(
        F.max(F.when(F.col("_anchor") == 1, F.col("r"))).alias("r"),
        F.max(F.when(F.col("_anchor") == 1, F.col("text"))).alias("text"),
        F.concat_ws("<br>", F.transform(pieces, lambda p: p["text"])).alias("_frag"),
    )
    # The row above the first anchor (_a = 0) has pieces only; they go down. Those below the last one go up.
    a = Window.partitionBy(*keys, "c").orderBy("_a")
    upto = a.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_filled", F.coalesce(F.col("text") != "", F.lit(False)))
    own = own.withColumn("_in", F.lag("_frag").over(a)).withColumn("_in", F.coalesce(F.nullif("_in", F.lit("")), F.lit(None)))
    own = own.withColumn("_first_up", F.coalesce(F.lag("r").over(a).isNull(), F.lit(True)))
    # Filled after what came in from above: a text of its own, or pieces that the row above could not take.
    start = F.col("_first_up") & F.col("_in").isNotNull()
    stop = F.when(~F.col("_filled") & ((F.col("_in").isNull()) | (F.col("_first_up") & ~start)), F.col("_a"))
    go = F.when(F.col("_filled") | start, F.col("_a"))
    own = own.withColumn("_kf", F.max(go).over(upto)).withColumn("_kb", F.max(stop).over(upto))
    own = own.withColumn("_full", F.col("_kf").isNotNull() & (F.col("_kb").isNull() | (F.col("_kf") > F.col("_kb"))))
    above = F.coalesce(F.lag("_full").over(a), F.lit(False))
    take = F.col("_in").isNotNull() & (F.col("_first_up") | (~F.col("_filled") & above))
    own = own.withColumn("_take", take)
    below_takes = F.coalesce(F.lead("_take").over(a), F.lit(False))
    own = own.withColumn("_keep", (F.col("_frag") != "") & ~below_takes)
    parts = F.array(F.when(F.col("_take"), F.col("_in")), F.nullif("text", F.lit("")), F.when(F.col("_keep"), F.col("_frag")))
    return own.where("r IS NOT NULL").select(*keys, "r", "c", F.array_join(F.array_compact(parts), "<br>").alias("text"))


def sectioned(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, heading, n_rows, table): a sheet's rows by section, each as a Markdown table under the header.

    cells: keys, r from 1, texts array<string>. Row 1 is the title and row 2 the header; later, a first cell without
    a second one is a section's heading, rows with neither are passed over.
    """
    first, second = F.get("texts", 0), F.get("texts", 1)
    rows = cells.where("r > 2").withColumn("_a", first != "").withColumn("_b", F.coalesce(second != "", F.lit(False)))
    rows = rows.where("_a OR _b").withColumn("_head", F.col("_a") & ~F.col("_b"))
    w = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum(F.col("_head").cast("int")).over(w))
    line = row_line(F.transform("texts", sheet_cell))
    body = F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("r", line.alias("line")))))
    out = rows.groupBy(*keys, "section").agg(
        F.max(F.when(F.col("_head"), first)).alias("heading"),
        F.count_if(~F.col("_head")).alias("n_rows"),
        F.transform(body, lambda p: p["line"]).alias("_body"),
    )
    header = cells.where("r = 2").select(
        *keys,
        row_line(F.transform("texts", sheet_cell)).alias("_header"),
        row_line(F.transform("texts", lambda _: F.lit("---"))).alias("_rule"),
    )
    table = F.when(F.size("_body") > 0, F.concat_ws("\n", "_header", "_rule", F.array_join("_body", "\n"))).otherwise(F.lit(""))
    return out.join(header, keys).select(*keys, "section", "heading", "n_rows", table.alias("table"))


def sheet_title(c: Column) -> Column:
    """struct<title, description> of a title cell: its first line, and the others that aren't blank."""
    parts = F.split(c, "\n", -1)
    rest = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), strip), lambda x: x != "")
    return F.struct(strip(F.get(parts, 0)).alias("title"), F.concat_ws("\n", rest).alias("description"))


def sheet_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, md): a sheet as one text: the title, its description, and each section's heading and table.

    cells: as for :func:`sectioned`. The first cell of row 1 is the title. Rows before the first heading are a table
    without one; a sheet without rows has its title only.
    """
    top = cells.where("r = 1").select(*keys, sheet_title(F.coalesce(F.get("texts", 0), F.lit(""))).alias("_top"))
    heading = F.when(F.col("heading").isNotNull(), F.concat(F.lit("## "), F.col("heading")))
    part = F.concat_ws("\n\n", heading, F.nullif("table", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("section", part.alias("md"))))
    body = sectioned(cells, keys).groupBy(*keys).agg(F.concat_ws("\n\n", F.transform(parts, lambda p: p["md"])).alias("_body"))
    title = F.concat(F.lit("# "), F.col("_top.title"))
    md = F.concat_ws("\n\n", title, F.nullif("_top.description", F.lit("")), F.nullif("_body", F.lit("")))
    return top.join(body, keys, "left").select(*keys, F.concat(md, F.lit("\n")).alias("md"))


def merged_across_pages(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Adds merged: number of the table that a table continues. Neighbours with one header and no text between
    them are one. tables: keys, tbl in order, header, gap (lines between it and the table before)."""
    w = Window.partitionBy(*keys).orderBy("tbl")
    new = ~F.coalesce((F.lag("header").over(w) == F.col("header")) & (F.col("gap") <= 1), F.lit(False))
    return tables.withColumn("merged", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
