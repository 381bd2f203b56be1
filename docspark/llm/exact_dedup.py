"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row
per digest, sort-merge anti-joined against the index, and what is new is appended,
so an append that is run again adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, parts_for, row_order, table, text_of, whole_row

_BLANKS = " \t\n\x0b\x0c\r"


class DigestIndex:
    """A digest index in the warehouse, or under ``path`` where one is given.

    Columns: text_sha256, keep_id, keep_chars, batch that brought it. One row per digest ever seen.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None):
        self.spark, self.name = spark, name
        where = f"LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (text_sha256 STRING, keep_id BIGINT, keep_chars BIGINT, batch STRING)"
            f" USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS {where}"
        )
        self.buckets = buckets

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, winners: DataFrame, batch: str) -> None:
        """Adds those rows of (text_sha256, keep_id, keep_chars), unique by digest, whose digest is new."""
        fresh = winners.join(self.read().hint("merge").select("text_sha256"), "text_sha256", "left_anti")
        (
            fresh.select("text_sha256", "keep_id", "keep_chars", F.lit(batch).alias("batch"))
            .write.format("parquet")
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .mode("append")
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of the text without ASCII white space, n_chars code points of the original."""
    text = text_of(docs)
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.sha2(F.translate(text, _BLANKS, ""), 256).alias("text_sha256"),
        F.length(text).cast("long").alias("n_chars"),
    )


def dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without the characters 0x20 and 0x09-0x0D.
    Of equal rows of a batch the one with the most code points, then the smallest
    doc_id stays (null ids last), unless the index already holds the digest from another
    batch: then keep_id is the id in the index and no row of the batch is kept. A batch
    given again under its name, as after a driver is lost, gets the result it got or
    would have got; without a name a batch is a new one. Null text counts
    as empty, and empty texts are equal to each other. Of rows that repeat both
    doc_id and text exactly one is kept. group_size counts rows of the batch. An
    empty table gives an empty result; further columns are ignored.
    """
    batch = batch or uuid.uuid4().hex
    rows = cut(digests(docs))
    winners = cut(
        rows.groupBy("text_sha256").agg(
            F.count("*").alias("group_size"),
            F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id")).alias("keep_id"),
            F.max("n_chars").alias("keep_chars"),
        )
    )
    index.append(winners, batch)
    seen = index.read().select("text_sha256", "keep_id", "keep_chars", (F.col("batch") != batch).alias("known"))
    groups = winners.select("text_sha256", "group_size").join(seen.hint("merge"), "text_sha256")
    # A digest may hold a third of the rows. With the second key no side comes
    # ready-partitioned, so both are exchanged and large partitions can be split.
    groups = cut(groups).withColumn("head", F.substring("text_sha256", 1, 4))
    out = rows.withColumn("head", F.substring("text_sha256", 1, 4)).join(groups, ["text_sha256", "head"])
    first = F.row_number().over(Window.partitionBy("doc_id", "text_sha256", "n_chars").orderBy("group_size"))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (
            F.col("doc_id").eqNullSafe(F.col("keep_id"))
            & (F.col("n_chars") == F.col("keep_chars"))
            & ~F.col("known")
            & (first == 1)
        ).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`dedup` keeps, with all their columns."""
    kept = dedup(docs, index, batch).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).hint("merge")
    text = text_of(docs)
    rows = docs.select(
        whole_row(docs),
        docs["doc_id"].cast("long").alias("id"),
        F.sha2(F.translate(text, _BLANKS, ""), 256).alias("sha"),
        F.length(text).alias("n_chars"),
    )
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["kept_id"]) & (rows["sha"] == kept["kept_sha"]), "left_semi")
    # Rows that repeat an id and a text: the longest, as in the index, and of equal ones that of the smallest hash.
    nth = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.col("n_chars").desc(), row_order(rows)))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")


def new_index(docs: DataFrame, name: str = "exact_dedup") -> DigestIndex:
    """An index for one run, under a name that no other has; :meth:`DigestIndex.drop` removes it."""
    return DigestIndex(docs.sparkSession, f"{name}_{uuid.uuid4().hex[:12]}", buckets=parts_for(docs, 64 << 20))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as one batch against an index of its own, which goes as soon as its answers are written."""
    docs = table(spark, sf_dir, "documents")
    index = new_index(docs)
    out = dedup(docs, index)
    index.drop()
    return out


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, arg_min(doc_id, {'a': -n, 'b': doc_id}) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
