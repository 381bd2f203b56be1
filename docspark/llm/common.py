"""Shared plumbing of the training-data operators: reading, sizing, cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in every operator of this subpackage.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A machine-local one is taken only by a session that runs in one process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = os.path.join(tempfile.gettempdir(), "docspark-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that losing an executor
    costs at most the tasks that were running. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of ``df`` in bytes; for a scan, the size of its files. 0 if it knows none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions of about ``bytes_each`` bytes of input, at least the session's number."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, -(-input_bytes(df) // bytes_each))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``row``, so that no column added beside it can clash with one of them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row")


def row_order(df: DataFrame) -> Column:
    """A hash of the whole ``row``: decides between rows that agree in all that matters. Maps cannot be hashed."""
    return F.lit(0) if "map<" in df.schema["row"].dataType.simpleString() else F.xxhash64("row")


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def keyed(docs: DataFrame, groups: int) -> DataFrame:
    """(grp, doc_id, th, text): documents dealt into ``groups`` by a hash of the id.

    A null id counts as the smallest one and a null text as empty. ``th`` is a hash
    of the text: it orders rows that repeat an id, and rows that repeat both id and
    text stand for one document.
    """
    text = text_of(docs)
    doc_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    return docs.select(
        F.pmod(F.xxhash64(doc_id), F.lit(groups)).cast("int").alias("grp"),
        doc_id.alias("doc_id"),
        F.xxhash64(text).alias("th"),
        text.alias("text"),
    )


def real_id(column: Column) -> Column:
    """Undoes the stand-in that :func:`keyed` gives to a null id."""
    return F.when(column != F.lit(-(2**63)), column)
