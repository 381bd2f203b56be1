"""Document fingerprints by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import input_bytes, keyed, real_id, table

U64 = np.uint64
#: A shared run of GRAM + WINDOW - 1 code points always leaves a shared fingerprint.
GRAM, WINDOW = 8, 16
_PIECE = 1 << 19
#: Runs of neighbouring documents into which the whole table is cut at most.
MOST_PARTS = 1 << 16


def winnow(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and places of the chosen grams of a text given as code points.

    In each run of ``window`` grams the one with the smallest hash is chosen, the rightmost
    of equals. With fewer grams the smallest of all is chosen, and a text shorter than a
    gram is one gram itself. An empty text has none.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    gram = min(gram, n)
    window = min(window, n - gram + 1)
    hashes, places = [], []
    # Long texts in pieces; each run of grams lies in exactly one.
    for a in range(0, max(1, n - gram - window + 2), _PIECE):
        b = min(n, a + _PIECE + gram + window - 2)
        h = tc.mix64(tc.roll(tc.mix64(points[a:b].astype(U64) + U64(1)), gram)) >> U64(32)
        m = len(h)
        key = (h << U64(32)) | (U64(m) - np.arange(m, dtype=U64))
        best = m - (tc.sliding_min(key, window) & U64(0xFFFFFFFF)).astype(np.int64)
        best = best[np.concatenate([[True], best[1:] != best[:-1]])]
        hashes.append(h[best].astype(np.uint32))
        places.append(best + a)
    h, p = np.concatenate(hashes), np.concatenate(places)
    new = np.concatenate([[True], p[1:] != p[:-1]])
    return h[new], p[new]


def written(h: np.ndarray, p: np.ndarray) -> str:
    """hash@place for each chosen gram, hashes as eight hex digits, separated by spaces."""
    x = h.astype(">u4").tobytes().hex()
    return " ".join([f"{x[8 * i : 8 * i + 8]}@{q}" for i, q in enumerate(p.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def with_next(docs: DataFrame, bytes_each: int = 2 << 20) -> DataFrame:
    """keyed() documents in ``part``s of neighbours by (doc_id, th), in the order (part, halo, doc_id, th) within
    each partition; the first of the next part (after the last, of the first) comes along with ``halo``.

    There are as many parts as the input has portions of ``bytes_each`` bytes, but MOST_PARTS at
    most, so the driver and each task hold at most that many first rows (16 bytes each). Parts
    are read as a stream: they may be of any size, and rows of one id may lie in several.
    """
    rows = keyed(docs, 1).drop("grp")
    n = min(MOST_PARTS, max(1, -(-input_bytes(docs) // bytes_each)))
    dealt = rows.select("doc_id", "th").repartitionByRange(n, "doc_id", "th")
    first = dealt.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    first = [tuple(r) for r in first.select("first.*").collect()] or [(0, 0)]
    starts = np.unique(_ordered(*np.array(first, np.int64).T))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _ordered(b.column(0).to_numpy(), b.column(1).to_numpy())
            k = np.searchsorted(starts, keys, "right") - 1
            halo = np.where(starts[k] == keys, (k - 1) % len(starts), -1)
            yield pa.record_batch([*b.columns[:3], pa.array(k, pa.int32()), pa.array(halo, pa.int32())], names)

    names = ["doc_id", "th", "text", "part", "next_to"]
    placed = rows.mapInArrow(place, "doc_id long, th long, text string, part int, next_to int")
    copies = F.array(
        F.struct(F.col("part").alias("part"), F.lit(False).alias("halo")),
        F.struct(F.col("next_to").alias("part"), F.lit(True).alias("halo")),
    )
    copies = placed.select(F.explode(F.filter(copies, lambda s: s["part"] >= 0)).alias("to"), "doc_id", "th", "text")
    dealt = copies.select("to.part", "to.halo", "doc_id", "th", "text").repartition("part")
    return dealt.sortWithinPartitions("part", "halo", "doc_id", "th")


def _ordered(ids: np.ndarray, ths: np.ndarray) -> np.ndarray:
    """Pairs of numbers as strings of 16 bytes in the same order."""
    both = np.stack([ids, ths], axis=1).astype(np.int64).view(U64) ^ U64(1 << 63)
    return both.astype(">u8").view("S16").ravel()


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document beside the next one of its part; the row with ``halo`` comes after the last. One is held at a time."""
    import hashlib

    rows: dict[str, list] = {f.name: [] for f in RESULT}
    size, part, before = 0, None, None
    for b in batches:
        for p, halo, doc_id, _, after in zip(*(c.to_pylist() for c in b.columns)):
            if p != part:
                part, before = p, None
            elif before is None:
                # Rows that repeat the first of the next part.
                continue
            h, places = winnow(_points(after))
            if before is not None:
                own_id, text, mine, fingerprint, m = before
                n = len(text)
                edited = text[: n - n // 4] + after[: n // 4]
                eh, ep = winnow(_points(edited))
                values = (
                    own_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint,
                    written(eh, ep), likeness(mine, np.unique(eh)), likeness(mine, np.unique(h)),
                )
                for c, v in zip(rows.values(), values):
                    c.append(v)
                size += m
                if size > _PIECE:
                    yield pa.RecordBatch.from_pydict(rows, schema=RESULT)
                    rows, size = {f.name: [] for f in RESULT}, 0
            before = None if halo else (doc_id, after, np.unique(h), written(h, places), len(after) + 16)
    yield pa.RecordBatch.from_pydict(rows, schema=RESULT)


def fingerprints(docs: DataFrame, bytes_each: int = 2 << 20) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 4) code points replaced by as many (or
    all) of the start of the next document by doc_id; the first follows the last. Null
    text counts as empty, a null doc_id comes before all others, rows that repeat a
    doc_id follow each other by a hash of their text. A lone document is its own next
    one. An empty table gives an empty result; further columns are ignored.
    """
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = with_next(docs, bytes_each).mapInArrow(_compare, kind)
    return out.withColumn("doc_id", real_id(F.col("doc_id")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
