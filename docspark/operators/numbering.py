"""Multi-level list numbers as window functions.

A list's paragraphs count by level. A paragraph resets the counters of deeper levels, unless a
level restarts only after a given one; an override pins the first value of a level. A level
that was never used shows its start, one that was reset shows 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.counters import counter

LEVELS = 9

#: Bytes of input files for one task's sort: some hundred thousand rows of compressed Parquet.
PART_BYTES = 4 << 20
MOST_PARTS = 20_000


def effective_levels(abstract: DataFrame, redefined: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, num_id, ilvl, start, fmt, lvl_text, restart, is_lgl, override): a list's own definition of a level goes
    before the abstract one, as a whole if it defines the level anew.

    abstract: keys, num_id, ilvl, start, fmt, lvl_text, restart, is_lgl; keys name the document, as every document
    counts its lists from 1. redefined: the same columns and override, null where the list says nothing.
    """
    columns = ("start", "fmt", "lvl_text", "restart", "is_lgl")
    on = [*keys, "num_id", "ilvl"]
    r = redefined.select(*on, "override", *[F.col(c).alias(f"r_{c}") for c in columns])
    both = abstract.join(r, on, "full_outer")
    return both.select(*on, *[F.coalesce(f"r_{c}", c).alias(c) for c in columns], "override")


def style_numbering(styles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, style_id, num_id, ilvl): the first style along ``based_on`` that has a num_id; a cycle gives none.

    styles: keys (document), style_id, based_on, num_id, ilvl. Chains are followed to their end, each style once, one
    document's styles at a time. Of styles that repeat an id the first by based_on, num_id and ilvl counts.
    """

    def follow(t: pd.DataFrame) -> pd.DataFrame:
        t = t.astype(object).where(t.notna(), None)
        rows = sorted(zip(t["style_id"], t["based_on"], t["num_id"], t["ilvl"]), key=lambda r: [(x is None, "" if x is None else x) for x in r[1:]])
        own: dict = {}
        for name, *rest in rows:
            own.setdefault(name, rest)
        found: dict = {name: (num, level or 0) for name, (_, num, level) in own.items() if num is not None}
        for name in own:
            path, at = {}, name
            while at in own and at not in found and at not in path:
                path[at] = None
                at = own[at][0]
            end = found.get(at) if at is not None else None
            for x in path:
                found[x] = end
        keep = [(name, *found[name]) for name in own if found[name] is not None]
        out = pd.DataFrame(keep, columns=["style_id", "num_id", "ilvl"])
        for i, k in enumerate(keys):
            out.insert(i, k, [t[k].iloc[0]] * len(out))
        return out

    kind = dict(styles.dtypes)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in [*keys, "style_id", "num_id", "ilvl"])
    return styles.select(*keys, "style_id", "based_on", "num_id", "ilvl").groupBy(*keys).applyInPandas(follow, schema)


def paragraph_numbering(paragraphs: DataFrame, styles: DataFrame, keys: list[str]) -> DataFrame:
    """Adds num_id and ilvl: a paragraph's own numbering if it has any, else its style's.

    paragraphs: keys (document), has_numpr, own_num_id, own_ilvl, style_id and further columns. Paragraphs whose own
    numbering names no list get none; num_id 0 is left out, as are deleted and fallback paragraphs where these columns are.
    """
    s = styles.select(*keys, "style_id", F.col("num_id").alias("s_num_id"), F.col("ilvl").alias("s_ilvl"))
    for c in ("deleted", "fallback"):
        if c in paragraphs.columns:
            paragraphs = paragraphs.where(~F.coalesce(F.col(c), F.lit(False)))
    p = paragraphs.join(s, [*keys, "style_id"], "left")
    p = p.withColumn("num_id", F.when(F.col("has_numpr"), F.col("own_num_id")).otherwise(F.col("s_num_id")))
    p = p.withColumn("ilvl", F.coalesce(F.when(F.col("has_numpr"), F.col("own_ilvl")).otherwise(F.col("s_ilvl")), F.lit(0)))
    return p.where("num_id IS NOT NULL AND num_id <> 0").drop("s_num_id", "s_ilvl")


def document_numbers(paragraphs: DataFrame, levels: DataFrame, styles: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered paragraphs with their number and abstract_id, from the tables of a package reader; keys name the document.

    levels: keys, num_id, abstract_id, ilvl, start, fmt, lvl_text, restart, is_lgl, override, own.
    """
    numbered = paragraph_numbering(paragraphs, style_numbering(styles, keys), keys)
    own = F.coalesce(F.col("own"), F.lit(False))
    spec = effective_levels(levels.where(~own).drop("override", "own", "abstract_id"), levels.where(own), keys)
    names = levels.groupBy(*keys, "num_id").agg(F.first("abstract_id", ignorenulls=True).alias("abstract_id"))
    return numbers(numbered, spec, [*keys, "num_id"]).join(names, [*keys, "num_id"], "left")


def by_abstract_list(numbered: DataFrame, keys: list[str], abstract_id: str) -> tuple[DataFrame, DataFrame]:
    """The paragraphs of one abstract list, and of the others (keys, abstract_id, n, n_in_table, n_outside): how many there are.

    numbered: keys, num_id, abstract_id, number, in_table. Paragraphs that show no number count on neither side.
    """
    # An array of at most one number: a filter on the number would be taken through all windows by the optimizer,
    # which then takes minutes to plan.
    one = F.array_compact(F.array("number"))
    shown = numbered.select(*[c for c in numbered.columns if c != "number"], F.explode(one).alias("number"))
    mine = F.col("abstract_id").eqNullSafe(F.lit(abstract_id))
    inside = F.coalesce(F.col("in_table"), F.lit(False))
    others = shown.where(~mine).groupBy(*keys, "abstract_id")
    return shown.where(mine), others.agg(F.count("*").alias("n"), F.count_if(inside).alias("n_in_table"), F.count_if(~inside).alias("n_outside"))


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by ``keys`` into as many parts as the input has ``PART_BYTES``, at least the session's number.

    Left alone, the parts of an exchange are of the session's number or put together up to a size in bytes that is small
    on the wire and large in a sort, with a list's levels beside each row. The size is that of the files below; where
    it is unknown the session's number holds.
    """
    return rows.repartition(_parts(rows), *keys)


def _parts(rows: DataFrame) -> int:
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        size = int(leaves.apply(i).stats().sizeInBytes())
        total += size if size < 1 << 50 else 0
    parts = min(-(-total // PART_BYTES), MOST_PARTS)
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)


def _with_spec(paragraphs: DataFrame, levels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Paragraphs with their list's levels. Both sides are dealt alike: a join goes by the side that needs no exchange."""
    n = _parts(paragraphs)
    return dealt(paragraphs, keys).join(_spec(levels.repartition(n, *keys), keys, columns), keys, "left")


def level_values(paragraphs: DataFrame, levels: DataFrame, keys: list[str], depth: int = LEVELS) -> DataFrame:
    """Adds v0, v1, ... the counters of all levels after each paragraph.

    paragraphs: keys (document and list), seq, ilvl. levels: keys, ilvl, start, restart, override. One exchange and
    one sort: every window has the same partitioning and order.
    """
    return _values(_with_spec(paragraphs, levels, keys, ["start", "restart", "override"]), keys, depth).drop("spec")


def numbers(paragraphs: DataFrame, levels: DataFrame, keys: list[str], depth: int = LEVELS) -> DataFrame:
    """:func:`level_values` and :func:`rendered` with one join for both; the counters are left out."""
    p = _rendered(_values(_with_spec(paragraphs, levels, keys, ["start", "restart", "override", "fmt", "lvl_text", "is_lgl"]), keys, depth), depth)
    return p.drop(*[f"v{k}" for k in range(depth)])


def _spec(levels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, spec): a list's levels as a map."""
    one = F.map_from_entries(F.collect_list(F.struct(F.col("ilvl"), F.struct(*columns).alias("d"))))
    return levels.groupBy(*keys).agg(one.alias("spec"))


def _values(p: DataFrame, keys: list[str], depth: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("seq")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level, t = F.col("ilvl"), F.row_number().over(w)
    p = p.withColumn("_t", t)
    t = F.col("_t")
    part = {}
    for k in range(depth):
        d = F.col("spec")[k]
        r, o = d["restart"], d["override"]
        reset = (level < k) & (r.isNull() | ((r != 0) & (r == level)))
        part[f"_co{k}"] = F.sum((level == k).cast("int")).over(running)
        part[f"_rs{k}"] = F.coalesce(reset, F.lit(False))
        part[f"_e{k}"] = F.min(F.when((level == k) | (o.isNotNull() & (level >= k)), t)).over(running)
        part[f"_tk{k}"] = F.min(F.when(level >= k, t)).over(running)
        part[f"_f{k}"] = F.min(F.when(level == k, t)).over(running)
    p = p.withColumns(part)
    part = {}
    for k in range(depth):
        part[f"_n{k}"] = F.col(f"_co{k}") - F.coalesce(F.max(F.when(F.col(f"_rs{k}"), F.col(f"_co{k}"))).over(running), F.lit(0))
        part[f"_lr{k}"] = F.coalesce(F.max(F.when(F.col(f"_rs{k}"), t)).over(running), F.lit(-1))
    p = p.withColumns(part)
    out = {}
    for k in range(depth):
        d = F.col("spec")[k]
        s, o = F.coalesce(d["start"], F.lit(1)), d["override"]
        n, lr, e, tk, f = (F.col(f"_{c}{k}") for c in ("n", "lr", "e", "tk", "f"))
        m = n - F.when(f == tk, 1).otherwise(0)
        # A start of 0 stays there: 0 counts as reset.
        pinned = F.when((m == 0) | f.isNull(), o).otherwise(F.when(o == 0, F.when(s == 0, 0).otherwise(s + m - 1)).otherwise(o + m))
        out[f"v{k}"] = (
            F.when(o.isNotNull() & tk.isNotNull() & (tk > lr), pinned)
            .when(n > 0, F.when(s == 0, 0).otherwise(s + n - 1))
            .when(e <= t, F.lit(0))
            .otherwise(s)
            .cast("int")
        )
    p = p.withColumns(out)
    return p.select(*[c for c in p.columns if not c.startswith("_")])


def rendered(values: DataFrame, levels: DataFrame, keys: list[str], depth: int = LEVELS) -> DataFrame:
    """Adds number: the level's text with %1, %2, ... replaced by the counters in their formats.

    levels: keys, ilvl, fmt, lvl_text, is_lgl. Bullets and levels without a number give null; a level with is_lgl
    shows all counters as decimals.
    """
    return _rendered(values.join(_spec(levels, keys, ["fmt", "lvl_text", "is_lgl"]), keys, "left"), depth)


def _rendered(p: DataFrame, depth: int) -> DataFrame:
    own = F.element_at(F.col("spec"), F.col("ilvl"))
    each = []
    for k in range(depth):
        fmt = F.when(own["is_lgl"], F.lit("decimal")).otherwise(F.coalesce(F.col("spec")[k]["fmt"], F.lit("decimal")))
        each.append(F.struct(F.lit(f"%{k + 1}").alias("mark"), F.col(f"v{k}").alias("v"), fmt.alias("fmt")))
    # The formats are one expression inside the lambda, and the texts are used in one place, so that a filter on the
    # number does not multiply them in the plan.
    text = F.aggregate(F.array(*each), own["lvl_text"], lambda text, x: F.replace(text, x["mark"], counter(x["v"], x["fmt"])))
    shown = ~own["fmt"].isin("bullet", "none")
    return p.withColumn("number", F.when(shown, text)).drop("spec")


def take_in_order(items: DataFrame, numbers: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which each number is used once, in order, by items of the same key.

    items, numbers: keys, seq; numbers also number. Items beyond the numbers of their key get null.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    n = numbers.withColumn("occ", nth).select(*keys, "occ", "number")
    return items.withColumn("occ", nth).join(n, [*keys, "occ"], "left")


def histogram(numbered: DataFrame, by: list[Column], top: int = 10) -> DataFrame:
    """The ``top`` most frequent values, first seen first among equals."""
    return numbered.groupBy(*by).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(top)
