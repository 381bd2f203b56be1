"""Files as a stream, as they arrive. An extension: batch readers do the same for what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.encodings import markdown_text


def markdown_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, text) of Markdown files under ``path``."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.md")
        .load(path)
    )
    return raw.select("path", "modificationTime", markdown_text(F.col("content")).alias("text"))


def ingest_available(docs: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Writes all that has arrived to Parquet and stops; the next call goes on from there."""
    return docs.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
