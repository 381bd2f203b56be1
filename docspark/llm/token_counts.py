"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: Counts of pieces kept by each worker; a full memory is emptied. Longer pieces are counted anew each time.
MEMORY, LONGEST_KEPT = 400_000, 48


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a byte's own character if it shows, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in shown else next(spare)): b for b in range(256)}


def load(path: str) -> dict:
    """Merges of a byte-level BPE file of the tokenizers library: {"first": symbol of each byte, "merge":
    {(left, right): (rank, symbol)}, "special": [strings], "pattern": ...}."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    letters = _byte_letters()
    first = [0] * 256
    for letter, byte in letters.items():
        first[byte] = vocab[letter]
    merge: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, (a, b) in enumerate(merges):
        merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
    special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return {"first": first, "merge": merge, "special": special}


def count_piece(data: bytes, model: dict) -> int:
    """Symbols left of one piece: the adjacent pair of lowest rank, leftmost of equals, is merged until none is left."""
    merge = model["merge"]
    symbol = [model["first"][b] for b in data]
    n = count = len(symbol)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # (rank, place, symbol made, left, right); stale once either symbol is no longer there.
    heap = [
        (found[0], i, found[1], symbol[i], symbol[i + 1])
        for i in range(n - 1)
        if (found := merge.get((symbol[i], symbol[i + 1])))
    ]
    heapq.heapify(heap)
    while heap:
        _, i, made, left, right = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != left or j >= n or symbol[j] != right:
            continue
        symbol[i], symbol[j] = made, -1
        after[i] = k = after[j]
        count -= 1
        if k < n:
            before[k] = i
            if found := merge.get((made, symbol[k])):
                heapq.heappush(heap, (found[0], i, found[1], made, symbol[k]))
        h = before[i]
        if h >= 0 and (found := merge.get((symbol[h], made))):
            heapq.heappush(heap, (found[0], h, found[1], symbol[h], made))
    return count


class _Counts(dict):
    def __init__(self, model: dict):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> int:
        n = count_piece(piece.encode("utf-8", "surrogatepass"), self.model)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = n
        return n


def counter(model: dict, pattern: str):
    """A function from a text to its number of tokens."""
    import regex

    find = regex.compile(pattern).findall
    counts = _Counts(model)
    special = regex.compile("|".join(regex.escape(s) for s in model["special"])) if model["special"] else None

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return sum(map(counts.__getitem__, find(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, find(p))) for p in parts)

    return count


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Tokens are those of the byte-level BPE file at ``path`` without begin, end, truncation
    or padding; a special string inside a text is one token. Null text counts as empty and
    has no tokens; rows that repeat are counted each; a null doc_id stays null; an empty
    table gives an empty result; further columns are ignored. The merges, as large as the
    vocabulary, are read by the driver and broadcast.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(load(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens = counter(model.value, pattern)
        for b in batches:
            counts = [n_tokens(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = text_of(docs)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
