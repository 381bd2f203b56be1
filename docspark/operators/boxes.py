"""Recognised text boxes: rows, columns, and what an image is."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K


def rows_of_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """Adds row (from 1): a box, in reading order, joins the first row whose mean centre is near enough, by its height.

    The means move with each box, so this is a fold over one image at a time, as large as the image's boxes.
    boxes: key, seq, x0, y0, x1, y1, text.
    """
    names = boxes.columns
    at = [names.index(c) for c in (key, "y0", "y1")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema.fields) + ", row int"

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image: list[tuple] = []
        done: list[tuple] = []
        kinds: list = []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            arrays = [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int32()])]
            return pa.record_batch(arrays, names=[*names, "row"])

        for b in batches:
            kinds[:] = b.schema.types
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if image and image[-1][at[0]] != r[at[0]]:
                    done += _rows(image, at[1], at[2])
                    image.clear()
                image.append(r)
            if done:
                yield emit()
        done += _rows(image, at[1], at[2])
        if done:
            yield emit()

    in_order = boxes.repartition(key).sortWithinPartitions(key, "y0", "x0", "seq")
    return in_order.mapInArrow(cluster, schema)


def _rows(image: list[tuple], y0: int, y1: int) -> list[tuple]:
    """The boxes of one image in reading order, each with the number of its row."""
    sums: list[float] = []
    counts: list[int] = []
    tops: list[float] = []
    found = []
    for box in image:
        centre = (box[y0] + box[y1]) / 2
        reach = max(box[y1] - box[y0], 6) * K.ROW_TOLERANCE * 2 + 4
        row = next((i for i, (s, n) in enumerate(zip(sums, counts)) if abs(centre - s / n) <= reach), len(sums))
        if row == len(sums):
            sums.append(0.0)
            counts.append(0)
            tops.append(box[y0])
        sums[row] += centre
        counts[row] += 1
        tops[row] = min(tops[row], box[y0])
        found.append(row)
    order = {old: new for new, old in enumerate(sorted(range(len(sums)), key=lambda i: (tops[i], i)), 1)}
    return [(*box, order[row]) for box, row in zip(image, found)]


def columns_of_boxes(boxes: DataFrame, key: str, gap: float = K.COLUMN_GAP) -> DataFrame:
    """(key, col, x0, x1): unions of the boxes' extents across, with gaps up to ``gap`` closed."""
    w = Window.partitionBy(key).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = boxes.withColumn("_new", F.coalesce(F.col("x0") - reach > gap, F.lit(True)).cast("int"))
    b = b.withColumn("col", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy(key, "col").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def triage(rows: DataFrame, key: str, gap: float = K.COLUMN_GAP) -> DataFrame:
    """(key, category, boxes, char_count, n_rows, n_cols, avg_chars, reason) of every image. rows: boxes with their row."""
    per_row = rows.groupBy(key, "row").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    stats = per_row.groupBy(key).agg(
        F.sum("n").alias("boxes"),
        F.sum("chars").alias("char_count"),
        F.count("*").alias("n_rows"),
        F.avg(F.when(F.col("n") >= 2, 1.0).otherwise(0.0)).alias("_multi"),
    )
    cols = columns_of_boxes(rows, key, gap).groupBy(key).agg(F.count("*").alias("n_cols"))
    s = stats.join(cols, key).withColumn("_avg", F.col("char_count") / F.col("boxes"))
    is_table = (F.col("n_cols") >= 2) & (F.col("n_rows") >= 2) & (F.col("_multi") >= K.TABLE_ROW_SHARE)
    reason = (
        F.when(is_table & (F.col("_avg") <= 5) & (F.col("boxes") >= 30), F.lit("many short labels"))
        .when(is_table, F.lit("table structure"))
        .when((F.col("char_count") >= 30) & (F.col("_avg") >= 3), F.lit("enough text"))
        .when((F.col("_avg") >= 15) & (F.col("char_count") >= 15), F.lit("one dense block"))
        .otherwise(F.lit("sparse labels"))
    )
    kinds = F.create_map(*[F.lit(x) for x in ("many short labels", "image", "table structure", "table", "enough text", "text", "one dense block", "text", "sparse labels", "image")])
    s = s.withColumn("reason", reason)
    return s.select(key, kinds[F.col("reason")].alias("category"), "boxes", "char_count", "n_rows", "n_cols", F.round("_avg", 1).alias("avg_chars"), "reason")


def recognised(images: DataFrame, key: str, engine: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """(key, seq, x0, y0, x1, y1, text): what any recognition engine reads in images. images: key, content.

    engine: a function from an image's bytes to (x0, y0, x1, y1, text) of its boxes, sent to the executors; it may keep
    what it loads in a global of its own. A null image, and one that the engine raises ValueError for, has no boxes.
    """

    def read(content) -> list[tuple]:
        try:
            return [] if content is None else list(engine(bytes(content)))
        except ValueError:
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *map(float, box[:4]), str(box[4])) for k, content in zip(batch[key], batch["content"]) for i, box in enumerate(read(content))]
            yield pd.DataFrame(rows, columns=[key, "seq", "x0", "y0", "x1", "y1", "text"])

    kind = dict(images.dtypes)[key]
    return images.select(key, "content").mapInPandas(run, f"{key} {kind}, seq long, x0 double, y0 double, x1 double, y1 double, text string")


def category_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("category").agg(F.count("*").alias("n"))


def category_summary(images: DataFrame) -> DataFrame:
    """(summary): one row that names the categories with their counts, the largest first."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "category", "n")))
    line = F.concat_ws(" | ", F.transform(entries, lambda e: F.concat_ws(": ", e["category"], e["n"].cast("string"))))
    return category_counts(images).agg(line.alias("summary"))


def text_of_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): boxes of a row joined by spaces, rows by line feeds."""
    line = F.array_sort(F.collect_list(F.struct("x0", "seq", "text")))
    per_row = rows.groupBy(key, "row").agg(F.concat_ws(" ", F.transform(line, lambda b: b["text"])).alias("line"))
    all_ = F.array_sort(F.collect_list(F.struct("row", "line")))
    return per_row.groupBy(key).agg(F.concat_ws("\n", F.transform(all_, lambda r: r["line"])).alias("text"))
