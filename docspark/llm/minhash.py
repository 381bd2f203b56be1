"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import cut, keyed, parts_for, real_id, table

U64 = np.uint64


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles.

    A-Z are lowered, words are runs of anything but 0x20 and 0x09-0x0D. A text with fewer
    words than ``size`` has one shingle of all its words, a text without words none.
    """
    for i, j in tc.slices(np.diff(at), 1 << 19):
        buf = tc.LOWER[data[at[i] : at[j]]]
        for x in range(i, j):
            own = buf[at[x] - at[i] : at[x + 1] - at[i]]
            s, e = tc.words(own)
            h = tc.word_hashes(own, s, e)
            if len(h) >= size:
                yield np.unique(tc.mix64(tc.roll(h, size)))
            elif len(h):
                yield tc.mix64(tc.roll(h, len(h)) + U64(len(h)))
            else:
                yield h


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: the first permutation scatters the shingles over the ring of 64-bit numbers, the
    second, shifted along the ring for each coordinate, is minimised over them."""
    first = tc.mix64(shingles * U64(0xA0761D6478BD642F) + U64(0x8EBC6AF09C88C6E3))
    out = np.empty(coordinates, U64)
    step = MASK // coordinates
    # A few coordinates at a time, so that the shifted rows stay in the processor's cache.
    rows = max(1, (1 << 14) // max(1, len(first)))
    for a in range(0, coordinates, rows):
        shift = np.arange(a, min(coordinates, a + rows), dtype=U64) * U64(step)
        second = tc.mix64(first[None, :] + shift[:, None])
        second.min(axis=1, out=out[a : a + rows])
    return out


MASK = (1 << 64) - 1


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = len(sig) // rows
    h = tc.roll(sig[: bands * rows], rows)[::rows]
    return tc.mix64(h + tc.randoms(bands, 77))


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
#: Bytes of shingle sets that one comparison holds; larger buckets are compared block against block.
BLOCK_BYTES = 16 << 20


def signed(docs: DataFrame, coordinates: int, rows: int, size: int) -> DataFrame:
    """Per row: number of shingles, a 128-bit hash of the set, and its band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tc.text_bytes(b.column("text"))
            n, sa, sb, bands = [], [], [], []
            for s in shingle_sets(data, at, size):
                n.append(len(s))
                sa.append(int(tc.mix64(s).sum(dtype=U64)))
                sb.append(int(tc.mix64(s ^ U64(0x94D049BB133111EB)).sum(dtype=U64)))
                bands.append(band_keys(signature(s, coordinates), rows).view(np.int64) if len(s) else np.empty(0, np.int64))
            lens = np.cumsum([0] + [len(x) for x in bands])
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(sa, U64).view(np.int64)),
                    pa.array(np.array(sb, U64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(flat, pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return keyed(docs, 1).select("doc_id", "text").mapInArrow(sign, SIGNED)


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, id, blocks): members of the band buckets with two or more, each set of members once."""
    member = reps.select(F.col("doc_id").alias("id"), "n_shingles", F.explode("bands").alias("bucket"))
    member = cut(member.dropDuplicates(["bucket", "id"]))
    full = (
        member.groupBy("bucket")
        .agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("id")).alias("x"),
            F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
            F.sum("n_shingles").alias("shingles"),
        )
        .where("n > 1")
    )
    full = full.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.max("shingles").alias("shingles"))
    blocks = F.ceil(F.col("shingles") * 8 / BLOCK_BYTES).cast("int")
    full = cut(full.select("bucket", blocks.alias("blocks")))
    return member.select("bucket", "id").join(full, "bucket")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, n, shingles binary) of the documents in ``ids``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tc.text_bytes(b.column("text"))
            sets = list(shingle_sets(data, at, size))
            yield pa.record_batch(
                [b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([tc.pack_sorted(s) for s in sets], pa.binary())],
                ["id", "n", "shingles"],
            )

    # A merge join at every size: ids grow with the documents and are not broadcast while they are few.
    wanted = keyed(docs, 1).select(F.col("doc_id").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    return wanted.mapInArrow(make, "id long, n long, shingles binary")


def _components(ids: np.ndarray, sets: list[np.ndarray], block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Star edges of the components that exact links make; with two blocks only links between them are looked for."""
    m = len(ids)
    n = np.array([len(s) for s in sets])
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(place) > 1
    number = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(m), n)
    use = shared[place]
    width = max(1, -(-int(shared.sum()) // 64))
    label = np.arange(m)
    across = block.min() != block.max()
    dense = m * width * 8 <= 4 * BLOCK_BYTES
    if dense:
        bits = np.zeros(m * width * 8, np.uint8)
        at = number[place[use]]
        np.bitwise_or.at(bits, owner[use] * width * 8 + (at >> 3), (1 << (at & 7)).astype(np.uint8))
        bits = bits.reshape(m, width * 8).view(U64)
    del place, owner, use
    for i in range(m - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        # Neither set can be much larger than the other.
        j = j[(100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])) & (not across or block[j] != block[i])]
        if not len(j):
            continue
        if dense:
            common = np.concatenate([np.bitwise_count(bits[x] & bits[i]).sum(axis=1, dtype=np.int64) for x in np.array_split(j, -(-len(j) * width // (1 << 18)))])
        else:
            common = np.array([np.isin(sets[i], sets[x], assume_unique=True).sum() for x in j])
        linked = j[100 * common >= percent * (n[j] + n[i] - common)]
        if len(linked):
            label[np.isin(label, label[linked])] = label[i]
    out = []
    for x in np.unique(label):
        mine = np.sort(ids[label == x])
        out += [(int(mine[0]), int(y)) for y in mine[1:]]
    return out


def links(members: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b) with a < b: star edges of the components found in each bucket, confirmed on full sets."""
    rows = members.hint("merge").join(sets, "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "shingles")
    rows = rows.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group) -> list[tuple[int, int]]:
            ids = np.array([r["id"] for r in group], np.int64)
            sets = [tc.unpack_sorted(r["shingles"]) for r in group]
            return _components(ids, sets, np.array([r["own"] for r in group]), percent)

        key, group, found = None, [], set()
        for b in batches:
            for r in b.to_pylist():
                k = (r["bucket"], r["lo"], r["hi"])
                if k != key:
                    if len(group) > 1:
                        found.update(done(group))
                    key, group = k, []
                group.append(r)
            if found:
                yield _pairs(found)
                found = set()
        if len(group) > 1 and (last := done(group)):
            yield _pairs(last)

    return rows.mapInArrow(compare, "a long, b long").where("a < b").distinct()


def _pairs(found) -> pa.RecordBatch:
    found = list(found)
    return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of the component, for every id in ``edges`` (a, b), by alternating stars.

    Each step hangs the larger (then the smaller) neighbours of every node on its smallest
    neighbour, until nothing moves. Edges are kept in the shared folder between steps.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = cut(edges.select("a", "b"))
    was = state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join exchanges both sides anew and a node with very many neighbours can be split.
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = cut(large)
        least = cut(large.groupBy("b").agg(F.min("a").alias("m")))
        hung = large.join(least, "b")
        small = hung.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").unionAll(least.select(F.col("m").alias("a"), "b"))
        edges = cut(small.distinct())
        now = state(edges)
        if now == was:
            return edges.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("id"), "label")
        was = now


def near_duplicates(
    docs: DataFrame, percent: int = 80, size: int = 5, coordinates: int = 125, rows: int = 5, parts: int | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of word
    shingles (see :func:`shingle_sets`). Candidates share a band of the circulant
    signature; with 25 bands of 5 a pair at 80 % is missed once in 20,000 times, at 85 %
    once in two million. component_id is the smallest doc_id reachable over links, itself
    included, and kept says that it is the document's own. Equal sets are reduced to one
    before banding. Texts without words are linked with nothing. Null text counts as
    empty; a null doc_id comes before all others and its component_id is null. Rows that
    repeat a doc_id count as one document in links, and those of a kept doc_id are all
    kept. An empty table gives an empty result; further columns are ignored.
    """
    parts = parts or parts_for(docs, 4 << 20)
    sigs = cut(signed(docs, coordinates, rows, size))
    classes = cut(
        sigs.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    )
    first = classes.select("set_a", "set_b", F.col("rep").alias("doc_id"))
    reps = sigs.join(first, ["set_a", "set_b", "doc_id"], "left_semi")
    members = cut(buckets(reps))
    sets = cut(sets_of(docs, members.select("id").distinct(), size).dropDuplicates(["id", "shingles"]))
    labels = components(links(members, sets, percent, parts))
    labels = cut(labels)
    # A class may hold a third of the rows: with both sides exchanged, large partitions can be split.
    labelled = cut(
        classes.join(labels, classes["rep"] == labels["id"], "left").select("set_a", "set_b", F.coalesce("label", "rep").alias("c"))
    )
    out = sigs.select("doc_id", "n_shingles", "set_a", "set_b").join(labelled, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return out.select(
        real_id(F.col("doc_id")).alias("doc_id"),
        "n_shingles",
        real_id(component).alias("component_id"),
        (component == F.col("doc_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns."""
    kept = near_duplicates(docs, percent, **options).where("kept").select(F.col("doc_id").alias("_id")).distinct().hint("merge")
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]), "left_semi")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[s:s + 4], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""
