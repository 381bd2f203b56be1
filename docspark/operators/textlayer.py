"""Whether the text that pages carry can be used, or the pages have to be recognised anew."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import garble
from ..functions.text import strip

#: White space, invalid characters, Latin-1 characters, in the notation of Python.
_KINDS = [re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{m[1]:0>8}", p)) for p in (K.WS, K.INVALID_CHARS, K.LATIN_CHARS)]


def signals(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, chars, n, n_invalid, n_latin, top, n_top, mojibake, reasons, suspect_ratio) of every page.

    keys name a page. A page's characters are counted where the page is read, so that no row per character is made or
    sent, and each pattern sees a character once. The most frequent character is the one of the smallest code point
    among equals. A null text gives nulls: the page could not be read.
    """
    t = F.col(text)
    cid = F.aggregate(F.regexp_extract_all(t, F.lit(K.CID), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    measured = pages.select(
        *keys,
        F.length(strip(t)).alias("chars"),
        F.when(t.contains("(cid:"), cid).otherwise(F.when(t.isNotNull(), 0)).alias("cid"),
        t.contains(K.MOJIBAKE).alias("mojibake"),
        t.cast("binary").alias("_text"),
    )
    kept = measured.columns[:-1]
    counts = ("n", "n_invalid", "n_latin", "top", "n_top")
    schema = T.StructType([*measured.schema.fields[:-1], *[T.StructField(c, T.StringType() if c == "top" else T.IntegerType()) for c in counts]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, tuple[bool, bool, bool]] = {}
        for b in batches:
            # Texts become Python strings one at a time.
            rows = [_counted(x.as_py(), kinds) for x in b.column("_text")]
            arrays = [pa.array([r[i] for r in rows], pa.string() if c == "top" else pa.int32()) for i, c in enumerate(counts)]
            yield pa.record_batch([*b.columns[:-1], *arrays], names=[*kept, *counts])

    out = measured.mapInArrow(count, schema)
    out = out.select(*kept, "n", (F.col("n_invalid") + F.col("cid")).alias("n_invalid"), "n_latin", "top", "n_top")
    out = out.select(*keys, "chars", "n", "n_invalid", "n_latin", "top", "n_top", "mojibake")
    read = F.col("chars").isNotNull()
    n, i, l, m = (F.col(c) for c in ("n", "n_invalid", "n_latin", "n_top"))
    why = garble.reasons(n, i, l, F.coalesce("top", F.lit("")), m, F.col("mojibake"))
    return out.withColumns({"reasons": F.when(read, why), "suspect_ratio": F.when(read, garble.suspect_ratio(n, i, l, m))})


def _counted(text: bytes | None, kinds: dict[str, tuple[bool, bool, bool]]) -> tuple:
    """(n, n_invalid, n_latin, top, n_top) of one text; kinds keeps what each character is."""
    if text is None:
        return (None,) * 5
    n = n_invalid = n_latin = n_top = 0
    top = None
    for x, k in Counter(text.decode("utf-8", "replace")).items():
        if x not in kinds:
            kinds[x] = tuple(bool(p.match(x)) for p in _KINDS)
        space, invalid, latin = kinds[x]
        if space:
            continue
        n += k
        n_invalid += k * invalid
        n_latin += k * latin
        if k > n_top or (k == n_top and x < top):
            top, n_top = x, k
    return n, n_invalid, n_latin, top, n_top


def verdicts(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """(keys, n_pages, chars, n_filled, empty_pages, garbled_pages, has_text, garbled, route, code) of every document.

    pages: keys, page and the columns of :func:`signals`. There is a text layer if at least half of the pages have
    text, of over 100 characters together; it is garbled if that is so of 5 % of the pages that have enough text
    to tell. Such documents and those without a text layer go to recognition, and a document none of whose pages
    could be read is an error. code: 0 text, 1 no text, 2 error, 3 garbled.
    """
    n, has = F.col("n"), F.size("reasons") > 0
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(page))))
    out = pages.groupBy(*keys).agg(
        F.count("*").alias("n_pages"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.count_if(n > 0).alias("n_filled"),
        pick((n == 0) | n.isNull()).alias("empty_pages"),
        pick(has).alias("garbled_pages"),
        F.count_if(n >= K.GARBLE_MIN_CHARS).alias("_judged"),
        F.count_if(n.isNotNull()).alias("_read"),
    )
    out = out.withColumn("has_text", (F.col("chars") > K.TEXT_LAYER_MIN_CHARS) & (F.col("n_filled") >= F.col("n_pages") * K.TEXT_LAYER_PAGE_SHARE))
    share = F.size("garbled_pages") / F.nullif("_judged", F.lit(0))
    out = out.withColumn("garbled", F.col("has_text") & F.coalesce(share >= K.GARBLE_DOCUMENT_SHARE, F.lit(False)))
    code = F.when(F.col("_read") == 0, 2).when(~F.col("has_text"), 1).when(F.col("garbled"), 3).otherwise(0)
    route = F.when(code == 2, F.lit("error")).when(code == 0, F.lit("text")).otherwise(F.lit("image"))
    return out.withColumns({"route": route, "code": code}).drop("_judged", "_read")
