"""Removal of repeated word windows by fixed-block anchors.

Every document is cut into non-overlapping blocks of words, which make the index; every
rolling window of a block's length in any document probes it. Blocks are so short that
each window of the threshold's length holds a whole block of its own document. So if a
window occurs twice, the block in either of them is hit by a probe out of the other.
A block that only its own probe hits ends there. Around the others the hit is extended to
all windows of full length that hold the block, and those that are found twice are the
maximal exact repeats, window by window.

Probes and windows travel as sorted sets of hashes for each group of documents, coded by
differences, and answers as one bit for each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import input_bytes, keyed, parts_for, real_id, table
from .suffix_dedup import GROUP, SENT, SENT_SQL, SLICE, _batch, _sorted_docs, _table

U64 = np.uint64


def _second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another hash of every word, independent of that of :func:`_words`, worked out in slices of words."""
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 8 * SLICE, "right")))
        out.append(tc.word_hashes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i], tc.SECOND_VALUE))
        i = j
    return np.concatenate(out) if out else np.empty(0, U64)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (in data) of every word, and the first word of each document (n+1)."""
    hs, ss, es = [], [], []
    for i, j in tc.slices(np.diff(at), SLICE):
        lo, hi = int(at[i]), int(at[j])
        # A piece of a long text ends where a word ends, so that no word is cut.
        while lo < hi:
            stop = min(hi, lo + 8 * SLICE)
            while stop < hi and not tc._IS_SPACE[data[stop - 1]]:
                stop += 1
            s, e = tc.words(data[lo:stop])
            # Texts touch here: a word may run on into the next text.
            edge = at[i + 1 : j] - lo
            edge = edge[(edge > 0) & (edge < stop - lo)]
            if len(edge):
                k = np.searchsorted(s, edge, "left") - 1
                cut = (k >= 0) & (e[np.maximum(k, 0)] > edge)
                edge = np.unique(edge[cut])
                s, e = np.sort(np.concatenate([s, edge])), np.sort(np.concatenate([e, edge]))
            hs.append(tc.word_hashes(data[lo:stop], s, e))
            ss.append(s + lo)
            es.append(e + lo)
            lo = stop
    if not hs:
        none = np.empty(0, np.int64)
        return np.empty(0, U64), none, none, np.zeros(len(at), np.int64)
    h, s, e = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
    return h, s, e, np.searchsorted(s, at)


def _valid(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of the n-k+1 runs of k words, whether it lies within one document."""
    ok = np.ones(max(0, n - k + 1), bool)
    for d in range(1, k):
        x = first - d
        ok[x[(x >= 0) & (x < len(ok))]] = False
    return ok


def _aligned(first: np.ndarray, n: int, block: int) -> np.ndarray:
    """For each of n words, its place in its document modulo ``block``."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return (np.arange(n) - first[doc]) % block


def repeated(
    docs: DataFrame, window: int = 35, groups: int | None = None, parts: int | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_words, spans array<struct<start, end>> (words) to remove, kept binary sha-256.

    Words are runs of anything but 0x20 and 0x09-0x0D. A word is removed if a window of
    ``window`` words that covers it also starts anywhere else. Null text counts as empty.
    Rows that repeat a doc_id are documents of their own; rows that repeat doc_id and
    text stand for one document (each gets its result). Texts under ``window`` words have
    no spans; an empty table gives an empty result; further columns are ignored.

    A group sends a row to each part that it has probes or windows for: never more rows than groups times parts,
    nor than distinct probes, which grow with the input.
    """
    block = (window + 1) // 2
    groups = groups or parts_for(docs, GROUP)
    parts = parts or parts_for(docs, GROUP)
    # Wide enough that a probe hits a foreign block by chance once in about 2**17 times. Such a hit costs
    # work only: windows are told apart by 64 bits made from one hash of their words and 32 from another.
    bits = min(60, max(36, math.ceil(math.log2(max(2, input_bytes(docs) / 4 / block))) + 17))
    texts = keyed(docs, groups)

    def probes(t: pa.Table):
        _, _, data, at = _sorted_docs(t, once=True)
        h, starts, ends, first = _words(data, at)
        p = tc.mix64(tc.roll(h, block)) >> U64(64 - bits)
        ok = _valid(first, len(h), block)
        return h, first, p, ok, lambda: _second_hashes(data, starts, ends)

    def send_probes(t: pa.Table) -> pa.Table:
        grp = t.column("grp")[0].as_py()
        h, first, p, ok, _ = probes(t)
        blocks = np.unique(p[ok & (_aligned(first, len(h), block)[: len(p)] == 0)])
        values, counts = np.unique(p[ok], return_counts=True)
        rows = []
        for x, a, b in zip(*(x.tolist() for x in tc.dealt(values, parts, bits))):
            twice = np.packbits(counts[a:b] > 1).tobytes()
            # Every block is a probe of its own document.
            c, d = np.searchsorted(blocks, values[a]), np.searchsorted(blocks, values[b - 1], "right")
            rows.append((x, grp, tc.pack_sorted(values[a:b]), len(twice).to_bytes(4, "little") + twice + tc.pack_sorted(blocks[c:d])))
        return _table(rows, SENT)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        index, sets, twice = [], [], []
        for r in rows:
            n = int.from_bytes(r["b"][:4], "little")
            sets.append(tc.unpack_sorted(r["a"]))
            twice.append(np.unpackbits(np.frombuffer(r["b"], np.uint8, n, 4), count=len(sets[-1])).astype(np.uint8))
            index.append(tc.unpack_sorted(r["b"][4 + n :]))
        index = np.unique(np.concatenate(index))
        if not len(index):
            index = np.zeros(1, U64)
            found = np.zeros(1, np.int64)
        else:
            found = np.zeros(len(index), np.int64)
        places = []
        for s, two in zip(sets, twice):
            x = np.minimum(np.searchsorted(index, s), len(index) - 1)
            places.append(np.where(index[x] == s, x, -1))
            hit = places[-1] >= 0
            found[places[-1][hit]] += 1 + two[hit]
        for r, x in zip(rows, places):
            bits_ = np.packbits((x >= 0) & (found[x] > 1)).tobytes()
            yield _batch([(r["bucket"], r["grp"], bits_, b"")], SENT)

    def candidates(t: pa.Table, answers: pa.Table):
        """Words, first words, and the windows around hit blocks: place, high and low hash, in order of the hash."""
        h, first, p, ok, second = probes(t)
        values = np.unique(p[ok])
        hit = np.zeros(len(values) + 1, bool)
        _set_bits(hit, tc.dealt(values, parts, bits), answers)
        if not hit.any() or len(h) < window:
            return None
        own = np.flatnonzero(ok & (_aligned(first, len(h), block)[: len(p)] == 0))
        own = own[hit[np.searchsorted(values, p[own])]]
        del p, ok, values
        # Windows that hold the block, wherever it lies in them.
        held = np.zeros(len(h) + 1, np.int32)
        np.add.at(held, np.maximum(own - (window - block), 0), 1)
        np.add.at(held, own + 1, -1)
        ok = _valid(first, len(h), window)
        places = np.flatnonzero((np.cumsum(held)[: len(ok)] > 0) & ok)
        w = tc.roll(h, window)[places]
        high = tc.mix64(w)
        low = (tc.mix64(tc.roll(second(), window, 0xD1342543DE82EF95)[places]) & U64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((low, high))
        return h, first, places[order], high[order], low[order]

    def send_windows(t: pa.Table, answers: pa.Table) -> pa.Table:
        got = candidates(t, answers) if answers.num_rows and t.num_rows else None
        if got is None or not len(got[2]):
            return _table([], SENT)
        grp = t.column("grp")[0].as_py()
        _, _, _, high, low = got
        new, twice = _distinct(high, low)
        high, low = high[new], low[new]
        rows = [
            (x, grp, tc.pack_sorted(high[a:b]), low[a:b].tobytes() + np.packbits(twice[a:b]).tobytes())
            for x, a, b in zip(*(x.tolist() for x in tc.dealt(high, parts)))
        ]
        # The answers go along to the last step, which has to find the same windows again.
        for x, b in zip(answers.column("bucket").to_pylist(), answers.column("a").to_pylist()):
            rows.append((x, -1 - grp, b, b""))
        return _table(rows, SENT)

    def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, highs, lows, twice = [], [], [], []
        for b in batches:
            for r in b.to_pylist():
                if r["grp"] < 0:
                    yield _batch([(r["bucket"], -1 - r["grp"], r["a"], b"")], SENT)
                    continue
                high = tc.unpack_sorted(r["a"])
                rows.append((r["bucket"], r["grp"]))
                highs.append(high)
                lows.append(np.frombuffer(r["b"], np.uint32, len(high)))
                twice.append(np.unpackbits(np.frombuffer(r["b"], np.uint8, offset=4 * len(high)), count=len(high)).astype(bool))
        if not rows:
            return
        high, low = np.concatenate(highs), np.concatenate(lows)
        order = np.lexsort((low, high))
        new, several = _distinct(high[order], low[order])
        hit = np.empty(len(high), bool)
        hit[order] = np.repeat(several, np.diff(np.append(new, len(order))))
        hit |= _any_of_equal(np.concatenate(twice), order, new)
        at = 0
        for (bucket, grp), s in zip(rows, highs):
            yield _batch([(bucket, grp, np.packbits(hit[at : at + len(s)]).tobytes(), b"w")], SENT)
            at += len(s)

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        ids, ths, data, at = _sorted_docs(t)
        _, starts, ends, first = _words(data, at)
        removed = np.zeros(len(starts) + 1, np.int32)
        if answers.num_rows:
            kind = np.array([b == b"w" for b in answers.column("b").to_pylist()])
            got = candidates(t, answers.filter(pa.array(~kind)))
            windows = answers.filter(pa.array(kind))
            if got is not None and windows.num_rows:
                _, once_first, places, high, low = got
                new, _ = _distinct(high, low)
                hit = np.zeros(len(new), bool)
                _set_bits(hit, tc.dealt(high[new], parts), windows)
                places = places[np.repeat(hit, np.diff(np.append(new, len(places))))]
                if len(first) != len(once_first):
                    # Rows that repeat id and text were sent once: carry their windows over to each.
                    fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])])
                    source = np.cumsum(fresh) - 1
                    doc = np.searchsorted(once_first, places, "right") - 1
                    parts_ = [places[doc == source[x]] - once_first[source[x]] + first[x] for x in range(len(ids))]
                    places = np.concatenate(parts_) if parts_ else places
                np.add.at(removed, places, 1)
                np.add.at(removed, places + window, -1)
        gone = np.cumsum(removed)[: len(starts)] > 0
        spans, shas, raw = [], [], memoryview(data)
        for x in range(len(ids)):
            a, b = int(first[x]), int(first[x + 1])
            g = gone[a:b]
            step = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
            keep = np.flatnonzero(~g) + a
            shas.append(hashlib.sha256(_joined(raw, data, starts[keep], ends[keep])).digest())
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(np.diff(first), pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(shas, pa.binary()),
            }
        )

    by_group = texts.groupBy("grp")
    sent = by_group.applyInArrow(send_probes, SENT_SQL).repartition(parts, "bucket")
    hits = sent.mapInArrow(match, SENT_SQL)
    around = by_group.cogroup(hits.groupBy("grp")).applyInArrow(send_windows, SENT_SQL).repartition(parts, "bucket")
    twice = around.mapInArrow(count_windows, SENT_SQL)
    out = by_group.cogroup(twice.groupBy("grp")).applyInArrow(
        finish, "doc_id long, n_words long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return out.withColumn("doc_id", real_id(F.col("doc_id")))


def _set_bits(hit: np.ndarray, dealt: tuple[np.ndarray, ...], answers: pa.Table) -> None:
    """Sets ``hit`` where the answers of the parts have a bit."""
    numbers, starts, ends = dealt
    for p, bits in zip(answers.column("bucket").to_pylist(), answers.column("a").to_pylist()):
        x = np.searchsorted(numbers, p)
        lo, hi = int(starts[x]), int(ends[x])
        hit[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted pairs, the first of each value, and whether the value occurs more than once."""
    new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])[: len(high)])
    return new, np.diff(np.append(new, len(high))) > 1


def _any_of_equal(flags: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row, whether a row of equal value has the flag."""
    out = np.empty(len(flags), bool)
    any_ = np.logical_or.reduceat(flags[order], new)
    out[order] = np.repeat(any_, np.diff(np.append(new, len(order))))
    return out


def _joined(raw: memoryview, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by single spaces."""
    if not len(starts):
        return b""
    # Words that stand one space apart in the text are copied together.
    cut = np.flatnonzero((starts[1:] - ends[:-1] != 1) | (data[ends[:-1]] != 32)) if len(starts) > 1 else np.empty(0, np.int64)
    s, e = np.append(starts[:1], starts[cut + 1]), np.append(ends[cut], ends[-1:])
    return b" ".join(raw[a:b] for a, b in zip(s.tolist(), e.tolist()))


def op6_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.lower(F.hex("kept")).alias("kept_sha256"),
    )


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w)),
hit AS (SELECT doc_id, s FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
cov AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM hit)),
one AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM one ANTI JOIN cov USING (doc_id, p) GROUP BY 1),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
