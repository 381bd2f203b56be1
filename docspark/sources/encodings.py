"""Bytes to text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tried in this order; the first that decodes wins.
ORDER = ("utf-8", "gb2312", "gbk", "gb18030")


def decoded(content: Column, detector: Callable[[bytes], str | None] | None = None) -> Column:
    """struct<text, encoding> of bytes; UTF-8 with replacements if no encoding fits.

    detector: a function that guesses the name of an encoding. Its guess is tried before the others; none, and one that
    Python doesn't know or that doesn't fit, are passed over.
    """

    @F.pandas_udf("text string, encoding string")
    def decode(raw: pd.Series) -> pd.DataFrame:
        def one(b):
            if b is None:
                return None, None
            guess = detector(b) if detector else None
            for name in ((guess.lower(),) if guess else ()) + ORDER:
                try:
                    return b.decode(name), name
                except (UnicodeDecodeError, LookupError):
                    continue
            return b.decode("utf-8", "replace"), "replaced"

        return pd.DataFrame([one(b) for b in raw], columns=["text", "encoding"])

    return decode(content)


def markdown_text(content: Column) -> Column:
    """Text of Markdown bytes without a byte order mark: UTF-8 inside the JVM, other encodings as above."""
    utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(decoded(content)["text"])
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files under a path, by Spark's own reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def html_files(spark: SparkSession, path: str, detector: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """(path, html, encoding)."""
    d = files(spark, path, "*.{html,htm}").withColumn("_d", decoded(F.col("content"), detector))
    return d.select("path", F.col("_d.text").alias("html"), F.col("_d.encoding").alias("encoding"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text)."""
    return files(spark, path, "*.md").select("path", markdown_text(F.col("content")).alias("text"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of image files; whoever shows them sorts them by path."""
    return files(spark, path, "*.{png,jpg,jpeg,gif,bmp,webp}").select("path", "length")
