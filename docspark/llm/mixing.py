"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, row_order, table, text_of, whole_row

WEIGHTS = (3, 1, 2)
#: Rows that one task orders within a source; a larger source is dealt into as many bins as it needs.
ROWS_PER_BIN = 1000
#: A source with more than one in so many documents is joined by broadcast: there are fewer such sources than that.
MOST_LARGE = 1000


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn. ``share`` times all
    words is divided by weight; a target stops at ``cap`` times its source, and what
    is over goes to the others by weight until none is above. With the sources in the
    order in which they reach their caps, the common level is the largest of the levels
    that result if the first 0, 1, 2, ... of them are held at their caps.

    The windows here see one row per source, not documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sources.withColumn("weight", pick)
    s = s.withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    s = s.withColumn("held", F.sum("source_size").over(by_cap) - F.col("source_size"))
    s = s.withColumn("open_weight", F.sum("weight").over(every) - F.sum("weight").over(by_cap) + F.col("weight"))
    level = (share * F.sum("source_size").over(every) - cap * F.col("held")) / F.col("open_weight")
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max("level").over(every))
    return s.withColumn("target", F.least(cap * F.col("source_size"), F.col("level") * F.col("weight"))).drop(
        "full_at", "held", "open_weight", "level"
    )


def _uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) with 52 random bits, fixed by key and seed."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix:") -> DataFrame:
    """doc_id, source, size, source_size, target, inclusion, copies, text_hash, taken for every document.

    size counts words (runs of anything but 0x20 and 0x09-0x0D; null text: 0). Each
    document first gets floor(target / source_size) certain whole copies. The words
    still missing come from a Pareto sample of the source. ``inclusion`` is a document's
    chance of a further copy: it grows with the square root of its size up to 1, and
    chances times sizes add up to the missing words. Documents of chance 1 are taken. With u
    uniform by doc_id, the others are ranked by the random odds u / (1 - u) divided by
    the inclusion odds, and taken whole in that order as long as the middle of
    the document lies within the missing words. So a source misses its target by half
    its largest document at most, and no document is taken more than ``cap`` times.
    Ties are broken by doc_id and a hash of the text. Documents without words get the certain copies and take
    0 words. A null source is a source of its own; null ids share one random number.
    """
    text = text_of(docs)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_hash"),
    )
    return _mix(cut(rows), weights, share, cap, seed)


def _lift() -> Column:
    """What inclusion chances are in proportion to, as a whole number so that sums are the same in any order."""
    return F.floor(1000.0 * F.sqrt(F.col("size").cast("double")))


def _chances(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: ``slope``, by which _lift() gives the inclusion chance, the words of the documents whose chance
    is 1, and of the others how many there are and their mean chance.

    sizes: source, size, n, with one row per size that occurs in a source. If all documents
    over some size are certain, the others' chances add up to the words that are left
    for them with a certain slope. The right one is the largest of these.
    """
    lift = _lift().cast("decimal(38,0)")
    up_to = Window.partitionBy("source").orderBy("size")
    s = sizes.where("size > 0").join(sources.select(F.col("source").alias("own"), "source_size", "missing"), F.col("source").eqNullSafe(F.col("own")))
    above = F.col("source_size") - F.sum(F.col("n") * F.col("size")).over(up_to)
    rest = F.sum(F.col("n") * F.col("size") * lift).over(up_to).cast("double")
    s = s.withColumn("slope", (F.col("missing") - above.cast("double")) / rest)
    s = s.withColumn("slope", F.greatest(F.max("slope").over(Window.partitionBy("source")), F.lit(0.0)))
    chance = F.col("slope") * _lift()
    open_ = F.when(chance < 1.0, F.col("n"))
    return s.groupBy("own").agg(
        F.first("slope").alias("slope"),
        F.coalesce(F.sum(F.when(chance >= 1.0, F.col("n") * F.col("size"))), F.lit(0)).alias("certain"),
        F.coalesce(F.sum(open_), F.lit(0)).alias("n_open"),
        (F.sum(open_ * chance) / F.sum(open_)).alias("mean_chance"),
    )


def _mix(rows: DataFrame, weights, share, cap, seed) -> DataFrame:
    sizes = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    sources = targets(sources, weights, share, cap).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    sources = cut(sources.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")))
    sources = sources.join(_chances(sizes, sources), F.col("source").eqNullSafe(F.col("own")), "left").drop("own")
    sources = sources.withColumn("bins", F.ceil(F.col("n_open") / ROWS_PER_BIN))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    sources = cut(sources.withColumn("skey", key).drop("source"))
    # A source may hold a third of the documents. Those with more than one in MOST_LARGE, which are fewer than
    # that, are broadcast; no source that is left is a hot key.
    total = sources.agg(F.sum("n_docs")).first()[0] or 0
    sized = sources.withColumn("large", F.col("n_docs") * MOST_LARGE > total)
    large, others = F.broadcast(sized.where("large")), sized.where("NOT large").hint("merge")
    keyed = rows.withColumn("skey", key)
    ranked = keyed.join(large, "skey").unionByName(keyed.join(large.select("skey"), "skey", "left_anti").join(others, "skey"))
    u = _uniform(F.col("doc_id"), seed)
    ranked = ranked.withColumn("inclusion", F.when(F.col("size") > 0, F.least(F.col("slope") * _lift(), F.lit(1.0))).otherwise(0.0))
    drawn = (F.col("inclusion") > 0) & (F.col("inclusion") < 1)
    ranked = ranked.withColumn("rank", F.when(drawn, u / (1.0 - u) * ((1.0 - F.col("inclusion")) / F.col("inclusion"))))
    scaled = F.col("rank") * (F.col("mean_chance") / (1.0 - F.col("mean_chance")))
    ranked = ranked.withColumn("bin", F.least(F.floor(scaled / (1.0 + scaled) * F.col("bins")), F.col("bins") - 1))
    ranked = cut(ranked)
    bins = ranked.where("rank IS NOT NULL").groupBy("skey", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("skey").orderBy("bin")
    bins = bins.select("skey", "bin", (F.sum("bin_size").over(before) - F.col("bin_size")).alias("bin_from"))
    within = Window.partitionBy("skey", "bin").orderBy("rank", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.where("rank IS NOT NULL").join(bins, ["skey", "bin"])
    middle = F.col("certain") + F.col("bin_from") + F.sum("size").over(within) - F.col("size") / 2.0
    out = out.withColumn("more", (middle <= F.col("missing")).cast("long"))
    rest = ranked.where("rank IS NULL").withColumn("more", (F.col("inclusion") >= 1).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "inclusion", "whole", "more", "text_hash"]
    out = out.select(*columns).unionAll(rest.select(*columns)).withColumn("copies", (F.col("whole") + F.col("more")).cast("long"))
    return out.drop("whole", "more").withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it, with all their columns."""
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias("taken_id"), F.col("text_hash").alias("taken_hash"))
    taken = taken.agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0").hint("merge")
    rows = docs.select(whole_row(docs), docs["doc_id"].cast("long").alias("id"), F.xxhash64(text_of(docs)).alias("hash"))
    # Rows that repeat an id and a text share what all of them were taken for; the one of the smallest hash stands for them.
    rows = rows.join(taken, rows["id"].eqNullSafe(F.col("taken_id")) & (F.col("hash") == F.col("taken_hash")))
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy(row_order(rows)))
    rows = rows.withColumn("nth", nth).where("nth = 1")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM w),
h AS (SELECT *, sum(source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT - source_size AS held,
             sum(weight) OVER () - sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS UNBOUNDED PRECEDING) + weight AS open_weight FROM f),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - 2.0::DOUBLE * held) / open_weight AS lvl FROM h),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(lvl) OVER () * weight) AS target FROM l),
q AS (SELECT d.doc_id, d.size, t.*, floor(1000.0::DOUBLE * sqrt(size::DOUBLE))::BIGINT AS lift,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
             (('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, target - whole * source_size AS missing FROM q),
k AS (SELECT *, (missing - (source_size - sum(size) OVER (PARTITION BY source ORDER BY size))::DOUBLE)
                / (sum(size::HUGEINT * lift) OVER (PARTITION BY source ORDER BY size))::DOUBLE AS slope FROM m WHERE size > 0),
p AS (SELECT *, least(1.0::DOUBLE, greatest(max(slope) OVER (PARTITION BY source), 0.0::DOUBLE) * lift) AS inclusion FROM k),
r AS (SELECT *, sum(size) OVER (PARTITION BY source, inclusion > 0
             ORDER BY CASE WHEN inclusion >= 1 THEN -1 ELSE u / (1.0::DOUBLE - u) * ((1.0::DOUBLE - inclusion) / nullif(inclusion, 0)) END, doc_id
             ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle FROM p)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN inclusion >= 1 OR (inclusion > 0 AND middle <= missing) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
UNION ALL SELECT doc_id, size, source_size, target, 0::BIGINT FROM m WHERE size = 0
"""
