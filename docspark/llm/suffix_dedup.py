"""Removal of repeated byte windows by depth-limited radix sorting of suffixes.

Suffixes are ordered through their first ``window`` bytes only, most significant digit
first. The first digit of a suffix is not its first bytes but the hash of its window's
anchor, the smallest k-gram of the window by a random order, and where that lies. Equal
windows have equal anchors there, so this digit may come first, and it does two things:
an anchor that is found once in all documents rules out its windows before anything is
sorted, and it deals the others over tasks. Consecutive windows with one anchor travel
as one string. Equal strings are reduced to their first before the remaining digits,
eight bytes each, split the groups further; a group with one member is done. The groups
that are left are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import keyed, parts_for, real_id, table

U64 = np.uint64
#: Bytes of text worked on at once, and the bytes of Parquet that make a group of documents.
SLICE, GROUP = 1 << 19, 4 << 20
#: Windows sorted at once.
PORTION = 1 << 18


def _anchors(data: np.ndarray, at: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For slices of documents: document, first and last window start with one anchor (in the document), the
    anchor's place there and its hash."""
    reach = window - k + 1
    for i, j in tc.slices(np.diff(at), SLICE):
        lo, hi = int(at[i]), int(at[j])
        # Pieces overlap by window-1 bytes, so each window lies in exactly one of them.
        for a in range(lo, hi, SLICE) if j == i + 1 else (lo,):
            b = min(hi, a + SLICE + window - 1) if j == i + 1 else hi
            if b - a < window:
                continue
            h = tc.mix64(tc.roll(tc.BYTE_VALUE[data[a:b]], k))
            order = (h & U64(~0xFFFFF & tc.MASK)) | np.arange(len(h), dtype=U64)
            best = (tc.sliding_min(order, reach) & U64(0xFFFFF)).astype(np.int64)
            start = np.arange(a, a + len(best))
            doc = np.repeat(np.arange(i, j), np.diff(np.clip(at[i : j + 1], a, a + len(best))))
            good = np.flatnonzero(start + window <= at[doc + 1])
            if not len(good):
                continue
            p = best[good]
            new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (np.diff(good) != 1)]))
            first, last = good[new], good[np.append(new[1:], len(good)) - 1]
            d, p = doc[first], p[new]
            # Smallest hashes crowd at the low end; spread again, they can be dealt out by range.
            yield d, first + a - at[d], last + a - at[d], p + a - at[d], tc.mix64(h[p])


def _sorted_docs(t: pa.Table, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, th, bytes and offsets in the order of (doc_id, th); rows that repeat both only once if asked."""
    t = t.sort_by([("doc_id", "ascending"), ("th", "ascending")])
    if once:
        i, h = t.column("doc_id").to_numpy(), t.column("th").to_numpy()
        new = np.concatenate([[True], (i[1:] != i[:-1]) | (h[1:] != h[:-1])])
        t = t if new.all() else t.filter(pa.array(new))
    data, at = tc.text_bytes(t.column("text"))
    return t.column("doc_id").to_numpy(), t.column("th").to_numpy(), data, at


def _own_anchors(t: pa.Table, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The group's distinct anchors in order, and whether each occurs there more than once."""
    _, _, data, at = _sorted_docs(t, once=True)
    h = [x[4] for x in _anchors(data, at, window, k)]
    values, counts = np.unique(np.concatenate(h) if h else np.empty(0, U64), return_counts=True)
    return values, counts > 1


def repeated(
    docs: DataFrame, window: int = 100, k: int = 32, groups: int | None = None, parts: int | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans array<struct<start, end>> (bytes) to remove, kept binary sha-256.

    A byte is removed if a window that covers it also starts earlier, in a smaller
    doc_id or earlier in the same document. Null text counts as empty; a null doc_id
    comes before all others. Rows that repeat a doc_id are ordered by a hash of their
    text, and rows that repeat both stand for one document (each gets its result).
    Texts under ``window`` bytes have no spans; an empty table gives an empty result;
    further columns are ignored.

    A group sends a row to each part that it has anchors for: never more rows than groups times parts, nor than
    distinct anchors, which grow with the input.
    """
    groups = groups or parts_for(docs, GROUP)
    parts = parts or parts_for(docs, GROUP)
    texts = keyed(docs, groups)

    def send_anchors(t: pa.Table) -> pa.Table:
        grp = t.column("grp")[0].as_py()
        values, twice = _own_anchors(t, window, k)
        rows = [
            (p, grp, tc.pack_sorted(values[a:b]), np.packbits(twice[a:b]).tobytes())
            for p, a, b in zip(*(x.tolist() for x in tc.dealt(values, parts)))
        ]
        return _table(rows, SENT)

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        sets = [tc.unpack_sorted(r["a"]) for r in rows]
        twice = np.concatenate(
            [np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(s)).astype(bool) for r, s in zip(rows, sets)]
        )
        _, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        hit = twice | (counts[back] > 1)
        at = 0
        for r, s in zip(rows, sets):
            mine = np.packbits(hit[at : at + len(s)]).tobytes()
            at += len(s)
            yield _batch([(r["bucket"], r["grp"], mine, b"")], SENT)

    def send_strings(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return _table([], SENT)
        grp = t.column("grp")[0].as_py()
        values, _ = _own_anchors(t, window, k)
        hit = _answers(values, answers, parts)
        if not len(hit):
            return _table([], SENT)
        ids, ths, data, at = _sorted_docs(t, once=True)
        seen: dict[bytes, int] = {}
        out, again = [], []
        for d, first, last, p, h in _anchors(data, at, window, k):
            keep = np.flatnonzero(hit[np.minimum(np.searchsorted(hit, h), len(hit) - 1)] == h)
            d, first, last, p, h = d[keep], first[keep], last[keep], p[keep], h[keep]
            lo, hi = (at[d] + first).tolist(), (at[d] + last + window).tolist()
            for x, (a, b) in enumerate(zip(lo, hi)):
                s = data[a:b].tobytes()
                # Anything equal in this group comes later than the one kept here.
                if s in seen:
                    again.append((d[x], first[x], last[x] + window))
                else:
                    seen[s] = 1
                    out.append((h[x], p[x] - first[x], s, d[x], first[x]))
        rows = []
        if again:
            x = np.array(again, np.int64)
            rows.append((grp % parts, grp, _spans(ids[x[:, 0]], ths[x[:, 0]], x[:, 1], x[:, 2]), b""))
        if out:
            h = np.array([x[0] for x in out], U64)
            order = np.argsort(h, kind="stable")
            for p, a, b in zip(*(x.tolist() for x in tc.dealt(h[order], parts))):
                mine = [out[x] for x in order[a:b]]
                d = np.array([x[3] for x in mine])
                fixed = np.rec.fromarrays(
                    [
                        np.array([x[0] for x in mine], U64),
                        np.array([x[1] for x in mine], np.uint16),
                        np.array([len(x[2]) for x in mine], np.uint16),
                        ids[d],
                        ths[d],
                        np.array([x[4] for x in mine], np.int64),
                    ],
                    names="h,off,len,id,th,start",
                )
                rows.append((p, grp, fixed.tobytes(), b"".join(x[2] for x in mine)))
        return _table(rows, SENT)

    def sort_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, data, grps = [], [], []
        for b in batches:
            for r in b.to_pylist():
                if not r["b"]:
                    yield _batch([(0, r["grp"], r["a"], b"")], SENT)
                    continue
                fixed.append(np.frombuffer(r["a"], STRING))
                data.append(r["b"])
                grps.append(np.full(len(fixed[-1]), r["grp"]))
        if not fixed:
            return
        f, grp = np.concatenate(fixed), np.concatenate(grps)
        owner, lo, hi = _radix(f, np.frombuffer(b"".join(data), np.uint8), window)
        start, end = f["start"][owner] + lo, f["start"][owner] + hi
        g = grp[owner]
        for x in np.unique(g):
            m = g == x
            yield _batch([(0, int(x), _spans(f["id"][owner[m]], f["th"][owner[m]], start[m], end[m]), b"")], SENT)

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        ids, ths, data, at = _sorted_docs(t)
        got = [np.frombuffer(b, SPAN) for b in answers.column("a").to_pylist()]
        spans = np.concatenate(got) if got else np.empty(0, SPAN)
        key = {(i, h): x for x, (i, h) in reversed(list(enumerate(zip(ids.tolist(), ths.tolist()))))}
        by_doc: dict[int, list[int]] = {}
        for x, pair in enumerate(zip(spans["id"].tolist(), spans["th"].tolist())):
            by_doc.setdefault(key[pair], []).append(x)
        removed, shas = [], []
        for x, pair in enumerate(zip(ids.tolist(), ths.tolist())):
            mine = by_doc.get(key[pair])
            body = memoryview(data[at[x] : at[x + 1]])
            if mine is None:
                removed.append([])
                shas.append(hashlib.sha256(body).digest())
                continue
            s, e = tc.merge_spans(spans["start"][mine], spans["end"][mine])
            sha, done = hashlib.sha256(), 0
            for a, b in zip(s.tolist(), e.tolist()):
                sha.update(body[done:a])
                done = b
            sha.update(body[done:])
            removed.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())])
            shas.append(sha.digest())
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_bytes": pa.array(np.diff(at), pa.int64()),
                "spans": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(shas, pa.binary()),
            }
        )

    by_group = texts.groupBy("grp")
    sent = by_group.applyInArrow(send_anchors, SENT_SQL).repartition(parts, "bucket")
    hits = sent.mapInArrow(count_anchors, SENT_SQL)
    strings = by_group.cogroup(hits.groupBy("grp")).applyInArrow(send_strings, SENT_SQL).repartition(parts, "bucket")
    spans = strings.mapInArrow(sort_strings, SENT_SQL)
    out = by_group.cogroup(spans.groupBy("grp")).applyInArrow(
        finish, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return out.withColumn("doc_id", real_id(F.col("doc_id")))


SENT_SQL = "bucket int, grp int, a binary, b binary"
SENT = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
STRING = np.dtype([("h", "<u8"), ("off", "<u2"), ("len", "<u2"), ("id", "<i8"), ("th", "<i8"), ("start", "<i8")])
SPAN = np.dtype([("id", "<i8"), ("th", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[x] for r in rows], f.type) for x, f in enumerate(schema)], schema=schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[x] for r in rows], f.type) for x, f in enumerate(schema)], schema=schema)


def _spans(ids, ths, start, end) -> bytes:
    """Spans of documents, joined where they touch."""
    out = np.empty(len(ids), SPAN)
    out["id"], out["th"], out["start"], out["end"] = ids, ths, start, end
    out.sort(order=["id", "th", "start"])
    same = (out["id"][1:] == out["id"][:-1]) & (out["th"][1:] == out["th"][:-1])
    # Sorted by start, ends don't fall back within a document: the spans are runs of windows of one length.
    new = np.flatnonzero(np.concatenate([[True], ~same | (out["start"][1:] > out["end"][:-1])])[: len(out)])
    joined = out[new].copy()
    joined["end"] = out["end"][np.append(new[1:], len(out)) - 1] if len(new) else joined["end"]
    return joined.tobytes()


def _answers(values: np.ndarray, answers: pa.Table, parts: int) -> np.ndarray:
    """Those of a group's sorted values whose bit is set in the answers of the buckets."""
    numbers, starts, ends = tc.dealt(values, parts)
    hit = np.zeros(len(values), bool)
    for p, bits in zip(answers.column("bucket").to_pylist(), answers.column("a").to_pylist()):
        x = np.searchsorted(numbers, p)
        a, b = int(starts[x]), int(ends[x])
        hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return values[hit]


def _radix(f: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner (index in ``f``) and range of bytes in its string for every run of windows that has an earlier equal.

    f: strings in any order, their bytes one after another in data.
    """
    begin = np.concatenate([[0], np.cumsum(f["len"].astype(np.int64))])
    # Order in the corpus: later comparisons of owners are comparisons of rank.
    by_place = np.lexsort((f["start"], f["th"], f["id"]))
    rank = np.empty(len(f), np.int64)
    rank[by_place] = np.arange(len(f))
    # Equal strings with one anchor: only the first goes on, the others are repeats throughout.
    first: dict[tuple[int, bytes], int] = {}
    whole, go = [], []
    raw = data.tobytes()
    hs, lo = f["h"].tolist(), begin.tolist()
    for x in by_place.tolist():
        key = (hs[x], raw[lo[x] : lo[x + 1]])
        if key in first:
            whole.append(x)
        else:
            first[key] = x
            go.append(x)
    del first
    go = np.array(go, np.int64)
    whole = np.array(whole, np.int64)
    # Of what goes on, anchors with a single string are done.
    h, counts = np.unique(f["h"][go], return_counts=True)
    go = go[counts[np.searchsorted(h, f["h"][go])] > 1]
    owners, starts, ends = [whole], [np.zeros(len(whole), np.int64)], [f["len"][whole].astype(np.int64)]
    # Anchors are sorted in portions that bound the windows in memory.
    order = go[np.argsort(f["h"][go], kind="stable")]
    windows = f["len"][order].astype(np.int64) - window + 1
    total = np.cumsum(windows)
    new_anchor = np.flatnonzero(np.concatenate([[True], f["h"][order][1:] != f["h"][order][:-1]])) if len(order) else []
    bounds, last = [0], 0
    for a, b in zip(list(new_anchor), [*list(new_anchor)[1:], len(order)]):
        if total[b - 1] - last > PORTION and a > bounds[-1]:
            bounds.append(int(a))
            last = total[a - 1]
    bounds.append(len(order))
    for a, b in zip(bounds[:-1], bounds[1:]):
        for owner, offset in _first_digits(f, order[a:b], windows[a:b]):
            o, s = _radix_portion(f, data, begin, rank, owner, offset, window)
            if len(o):
                new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (np.diff(s) != 1)]))
                owners.append(o[new])
                starts.append(s[new])
                ends.append(s[np.append(new[1:], len(s)) - 1] + window)
    return np.concatenate(owners), np.concatenate(starts), np.concatenate(ends)


def _first_digits(f, strings: np.ndarray, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of some strings (owner and place in the string), in one go or, if these are the strings of a
    frequent anchor, by the anchor's place in the window."""
    if not len(strings):
        return
    if windows.sum() <= 2 * PORTION:
        yield np.repeat(strings, windows), np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        return
    off = f["off"][strings].astype(np.int64)
    least, most = int((off - windows + 1).min()), int(off.max())
    step = max(1, PORTION // len(strings))
    for a in range(least, most + 1, step):
        some = [np.flatnonzero((off >= w) & (off - w < windows)) for w in range(a, min(a + step, most + 1))]
        at = np.repeat(np.arange(a, a + len(some)), [len(x) for x in some])
        x = np.concatenate(some)
        yield strings[x], off[x] - at


def _radix_portion(f, data, begin, rank, owner, offset, window) -> tuple[np.ndarray, np.ndarray]:
    # First digit: the anchor and its place in the window.
    where = f["off"][owner].astype(np.int64) - offset
    order = np.lexsort((rank[owner], where, f["h"][owner]))
    owner, offset, where = owner[order], offset[order], where[order]
    h = f["h"][owner]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (where[1:] != where[:-1])])
    del h, where, order
    at = begin[owner] + offset
    for depth in range(0, window, 8):
        # Groups of one are done.
        alone = new & np.append(new[1:], True)
        if alone.any():
            stay = ~alone
            owner, offset, at, new = owner[stay], offset[stay], at[stay], new[stay]
        if not len(owner):
            break
        digit = np.zeros(len(at), U64)
        for x in range(depth, min(depth + 8, window)):
            digit <<= U64(8)
            digit |= data[at + x].astype(U64)
        group = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        if (digit != digit[firsts][group]).any():
            # Stable: within equal digits the order in the corpus is kept.
            order = np.lexsort((digit, group))
            owner, offset, at, digit = owner[order], offset[order], at[order], digit[order]
            new = new | np.concatenate([[True], digit[1:] != digit[:-1]])
    # Groups are ordered by place; all but the first of each have an earlier equal.
    later = np.flatnonzero(~new) if len(owner) else np.empty(0, np.int64)
    o, s = owner[later], offset[later]
    order = np.lexsort((s, o))
    return o[order], s[order]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.lower(F.hex("kept")).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d)),
hit AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
run AS (SELECT doc_id, s, sum(CASE WHEN s <= last + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS r
  FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS last FROM hit)),
span AS (SELECT doc_id, r, min(s) AS a, max(s) + 100 AS b FROM run GROUP BY ALL),
edge AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM span),
parts AS (SELECT d.doc_id, from_ AS o, substr(h, 2 * from_ + 1, 2 * (a - from_)) AS x FROM edge JOIN d USING (doc_id)
  UNION ALL SELECT d.doc_id, coalesce(e, 0), substr(h, 2 * coalesce(e, 0) + 1) FROM d LEFT JOIN (SELECT doc_id, max(b) AS e FROM span GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(x, '' ORDER BY o))) AS kept_sha256 FROM parts GROUP BY 1),
n AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
