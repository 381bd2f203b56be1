"""Audits: coverage, continuity, reconciliation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import numbered_heading_level


def overlap(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """(key, n_a, n_b, n_both, share): how much of a's items, as a multiset, b has."""
    x = a.groupBy(key, item).agg(F.count("*").alias("n"))
    y = b.groupBy(key, item).agg(F.count("*").alias("m"))
    both = x.join(y, [key, item], "full_outer")
    out = both.groupBy(key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("n_b"),
        F.coalesce(F.sum(F.least(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))), F.lit(0)).alias("n_both"),
    )
    return out.withColumn("share", F.when(F.col("n_a") > 0, F.col("n_both") / F.col("n_a")))


def matched_share(pairs: DataFrame, key: str, source: str, result: str, alarm: float = 98.5) -> DataFrame:
    """(key, percent, low): characters of ``source`` in matching blocks of ``result``, in order, and whether that is
    under the alarm. One pair of texts at a time, without white space."""
    @F.pandas_udf("double")
    def percent(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def share(x: str, y: str) -> float:
            x, y = "".join((x or "").split()), "".join((y or "").split())
            if not x:
                return 100.0
            return 100.0 * sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) / len(x)

        return pd.Series([share(x, y) for x, y in zip(a, b)])

    return pairs.select(key, percent(source, result).alias("percent")).withColumn("low", F.col("percent") < alarm)


def gaps(numbers: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, after, before, missing, kind): where a run of whole numbers skips or repeats."""
    w = Window.partitionBy(*keys).orderBy(n)
    rows = numbers.withColumn("_before", F.lag(n).over(w)).where(F.col("_before").isNotNull() & (F.col(n) != F.col("_before") + 1))
    return rows.select(
        *keys,
        F.col("_before").alias("after"),
        F.col(n).alias("before"),
        F.greatest(F.col(n) - F.col("_before") - 1, F.lit(0)).alias("missing"),
        F.when(F.col(n) == F.col("_before"), F.lit("repeat")).otherwise(F.lit("gap")).alias("kind"),
    )


def column_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows, n_widths, ragged): whether a table's rows differ in the number of cells. rows: keys, n_cells."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("n_cells").alias("n_widths"))
    return out.withColumn("ragged", F.col("n_widths") > 1)


def heading_depths(headings: DataFrame) -> DataFrame:
    """Adds expected, and keeps the rows whose level differs: numbered headings are as deep as their number.
    headings: level, text and further columns."""
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)\.?(?:\s|$)", 1)
    rows = headings.withColumn("expected", F.when(number != "", numbered_heading_level(number)))
    return rows.where("expected <> level")


def split_tables(rows: DataFrame, key: str) -> DataFrame:
    """Table lines after one other line that follows a table line: a table may have been cut there. rows: key, lineno, is_row."""
    w = Window.partitionBy(key).orderBy("lineno")
    cut = F.col("is_row") & ~F.lag("is_row").over(w) & F.lag("is_row", 2).over(w)
    return rows.where("TRUE").withColumn("_cut", cut).where("_cut").select(key, "lineno")


def sums_hold(parts: list[Column], total: Column, tolerance: float = 0.005) -> Column:
    """Whether a row's parts add up to its total."""
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return F.abs(out - total) <= tolerance


def reconciled(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_a, n_b, equal): counts by key on both sides, missing ones as 0."""
    x = a.groupBy(*keys).agg(F.count("*").alias("n_a"))
    y = b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    out = x.join(y, keys, "full_outer").select(*keys, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return out.withColumn("equal", F.col("n_a") == F.col("n_b"))


def missing_names(required: DataFrame, present: DataFrame | list[DataFrame], column: str, key) -> DataFrame:
    """Rows of ``required`` none of whose alternatives is present, compared by ``key``. required: id, column. What is
    present may come from several places, as fonts do."""
    have = None
    for place in present if isinstance(present, list) else [present]:
        names = place.select(key(F.col(column)).alias("_key"))
        have = names if have is None else have.unionAll(names)
    have = have.distinct()
    found = required.withColumn("_key", key(F.col(column))).join(have, "_key", "left_semi").select("id").distinct()
    return required.join(found, "id", "left_anti")


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, a_seq, b_seq, item, equal): each of a's items with the next of b's that has its text, never going back.

    a, b: key, seq, item, number. Sequential, so one document at a time.
    """
    def merge(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values("seq"), y.sort_values("seq")
        places: dict = {}
        ys, items, numbers = y["seq"].tolist(), y["item"].tolist(), y["number"].tolist()
        for i, item in enumerate(items):
            places.setdefault(item, []).append(i)
        at, out = 0, []
        from bisect import bisect_left

        for k, seq, item, number in zip(x[key], x["seq"], x["item"], x["number"]):
            found = places.get(item, [])
            i = bisect_left(found, at)
            if i < len(found):
                out.append((k, seq, ys[found[i]], item, numbers[found[i]] == number))
                at = found[i] + 1
            else:
                out.append((k, seq, None, item, False))
        return pd.DataFrame(out, columns=[key, "a_seq", "b_seq", "item", "equal"]).astype({"b_seq": "Int64"})

    kind = dict(a.dtypes)[key]
    return a.groupBy(key).cogroup(b.groupBy(key)).applyInPandas(merge, f"{key} {kind}, a_seq long, b_seq long, item string, equal boolean")
