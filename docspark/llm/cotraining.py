"""Quality classifier by co-training a text-content view and a page-metadata view."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import cut, table, text_of, whole_row

SOURCES, LANGS, LENGTHS = 64, 16, 24
STATS = 16
COLUMNS = ("text", "lang", "source", "n_chars")
#: Steps into which the range of a view's scores is cut to find its most extreme documents.
BINS = 4096
#: Sums (0.7 MB a row) that one task, or the driver at the end, adds up.
FAN_IN = 16


def text_features(texts: list[str]) -> np.ndarray:
    """One row per text: the share of each byte, and how words and lines repeat and are written."""
    out = np.zeros((len(texts), 256 + STATS), np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        n = len(data)
        if not n:
            continue
        # Long texts in slices, so that only counts of them stay.
        counts, n_words, letters, upper_words, plain_words, seen = np.zeros(256), 0, 0, 0, 0, []
        for a in range(0, n, 1 << 22):
            piece = data[a : a + (1 << 22)]
            counts += np.bincount(piece, minlength=256)
            s, e = tc.words(piece)
            n_words += len(s)
            letters += int((e - s).sum())
            first, last = piece[s], piece[np.maximum(e - 1, 0)]
            upper_words += int(((first >= 65) & (first <= 90) & (e - s > 1) & (piece[np.minimum(s + 1, len(piece) - 1)] >= 65) & (piece[np.minimum(s + 1, len(piece) - 1)] <= 90)).sum())
            plain_words += int((((last >= 97) & (last <= 122)) | (last >= 128)).sum())
            seen.append(np.unique(tc.word_hashes(piece, s, e), return_counts=True))
        h, where = np.unique(np.concatenate([x[0] for x in seen]), return_inverse=True)
        c = np.bincount(where, np.concatenate([x[1] for x in seen])) if len(h) else np.zeros(1)
        lines = counts[10] + 1
        share = counts / n
        out[i, :256] = np.sqrt(share)
        w = max(n_words, 1)
        out[i, 256:] = (
            np.log1p(n),
            len(h) / w,
            len(h) / np.sqrt(w),
            c.max() / w,
            (c * (c > 1)).sum() / w,
            letters / w,
            upper_words / w,
            plain_words / w,
            share[65:91].sum(),
            share[48:58].sum(),
            share[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]].sum(),
            share[128:].sum(),
            w / lines,
            np.log1p(lines),
            np.log1p(w),
            float(w < 5),
        )
    return out


def page_features(langs, sources, lengths) -> np.ndarray:
    """One row per page: hashed language and source, and the length's power of two."""
    import zlib

    out = np.zeros((len(langs), SOURCES + LANGS + LENGTHS), np.float32)
    for i, (lang, source, n) in enumerate(zip(langs, sources, lengths)):
        out[i, zlib.crc32(repr(source).encode("utf-8", "surrogatepass")) % SOURCES] = 1
        out[i, SOURCES + zlib.crc32(repr(lang).encode("utf-8", "surrogatepass")) % LANGS] = 1
        out[i, SOURCES + LANGS + min(LENGTHS - 1, int(max(n or 0, 0)).bit_length())] = 1
    return out


@dataclass
class View:
    """Ridge regression on standardised features with a calibrated output; exact sums make it mergeable."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: float = 1.0
    shift: float = 0.0

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * (self.design(x) @ self.weights) + self.shift, -30, 30)


def _sums(design: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Gram matrix with the targets as a further column, and the weights of rows added up."""
    full = np.concatenate([design, y[:, None]], axis=1)
    return full.T @ (full * np.reshape(weight, (-1, 1)))


def _solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    g = sums[:-1, :-1] + ridge * np.eye(len(sums) - 1)
    return np.linalg.solve(g, sums[:-1, -1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Newton's method for a few coefficients; the last one is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
    return w


def ordered(odds: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs of a good and a bad row in which the good one is placed higher; ties count half."""
    _, at, n = np.unique(odds, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    good = int(y.sum())
    return float((rank[y == 1].sum() - good * (good + 1) / 2) / max(good * (len(y) - good), 1))


def reliance(odds: np.ndarray, y: np.ndarray, least: float = 0.05) -> float:
    """How much a view's order of good before bad rows is worth: 1 if all pairs are right, ``least`` if only half are.

    A standard error of chance is taken off, so that a view which happens to order few rows well lends little.
    """
    good = int(y.sum())
    chance = math.sqrt((1 / max(good, 1) + 1 / max(len(y) - good, 1)) / 12)
    return max(least, 2 * (ordered(odds, y) - chance) - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    views: list[View]
    combine: np.ndarray
    prior: float = 1.0

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of good quality by text, by page, and by both."""
        if not self.views:
            p = np.full(len(text), self.prior)
            return p, p, p
        a, b = self.views[0].log_odds(text), self.views[1].log_odds(page)
        z = self.combine[0] * a + self.combine[1] * b + self.combine[2]
        return _sigmoid(a), _sigmoid(b), _sigmoid(np.clip(z, -30, 30))


def _feature_rows(batch) -> tuple[np.ndarray, np.ndarray]:
    text, lang, source, n = (batch.column(c).to_pylist() for c in COLUMNS)
    return text_features(text), page_features(lang, source, [len(t) if k is None else k for t, k in zip(text, n)])


def _inputs(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        text_of(docs).alias("text"),
        docs["lang"].cast("string").alias("lang"),
        docs["source"].cast("string").alias("source"),
        docs["n_chars"].cast("long").alias("n_chars"),
        *more,
    )


def fit(
    docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, rounds: int = 2, share: float = 0.1, ridge: float = 3.0
) -> Model:
    """Trains both views. Labelled rows are at most ``most_labelled``, those of the smallest hash of doc_id.

    A tenth of them calibrates each view, another tenth fits how the views are combined, the rest teaches (with too
    few rows of either kind all do all). In each round every document without a label among them is
    scored by both views, and each view learns from the ``share`` of them that the other
    one places furthest at its two ends, split between the ends as the labels are between
    the kinds. Together they weigh no more than the labelled rows times the :func:`reliance`
    of the lending view, so that weak metadata lend rows without drowning the labels. Features are
    worked out once and written; what the rounds add up over them is of fixed size. Null labels and ids are passed over; of repeated labels of one
    document the lowest counts; without labels of both kinds the model gives
    every document the share of good labels (1 if there are none).
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(most_labelled)
    )
    known = {r.label_id: r.quality for r in known.collect()}
    if len(set(known.values())) < 2:
        return Model([], np.zeros(3), float(next(iter(known.values()), 1)))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                piece = b.slice(a, 512)
                ids = piece.column("doc_id").to_pylist()
                text, page = _feature_rows(piece)
                yield pa.record_batch(
                    [
                        piece.column("doc_id"),
                        pa.array([shared.value.get(i) for i in ids], pa.int32()),
                        pa.array([x.tobytes() for x in text], pa.binary()),
                        pa.array([x.tobytes() for x in page], pa.binary()),
                    ],
                    ["doc_id", "y", "text", "page"],
                )

    inputs = _inputs(docs, docs["doc_id"].cast("long").alias("doc_id"))
    features = cut(inputs.mapInArrow(featured, "doc_id long, y int, text binary, page binary"))
    rows = features.where("y IS NOT NULL").toArrow()
    if not rows.num_rows or len(set(rows.column("y").to_pylist())) < 2:
        return Model([], np.zeros(3), float(np.mean(rows.column("y").to_pylist() or [1])))
    y = rows.column("y").to_numpy().astype(float)
    x = [v.astype(float) for v in _unpacked(rows)]
    tenth = tc.mix64(rows.column("doc_id").to_numpy().view(np.uint64)) % np.uint64(10)
    held, both = tenth == 0, tenth == 1
    learn = tenth > 1
    if any(len(set(y[part])) < 2 for part in (held, both, learn)):
        held = both = learn = np.ones(len(y), bool)
    views = [View(v[learn].mean(0), np.maximum(v[learn].std(0), 1e-3)) for v in x]
    own = [_sums(v.design(f[learn]), 2 * y[learn] - 1) for v, f in zip(views, x)]

    def settle(view: View, sums: np.ndarray, f: np.ndarray) -> None:
        view.weights, view.slope, view.shift = _solve(sums, ridge), 1.0, 0.0
        raw = view.log_odds(f[held])
        view.slope, view.shift = logistic(raw[:, None], y[held])

    for v, s, f in zip(views, own, x):
        settle(v, s, f)
    new = features.where("y IS NULL").select("text", "page")
    for _ in range(rounds):
        lent = _exchange(new, views, share, float(y.mean()))
        if lent is None:
            break
        trust = [reliance(v.log_odds(f[held]), y[held]) for v, f in zip(views, x)]
        for v, s, f, more, t in zip(views, own, x, lent, trust[::-1]):
            # The constant's square counts rows.
            weight = t * min(1.0, s[-2, -2] / max(more[-2, -2], 1.0))
            settle(v, s + weight * more, f)
    logits = np.stack([v.log_odds(f[both]) for v, f in zip(views, x)], axis=1)
    return Model(views, logistic(logits, y[both], ridge=1.0))


def _unpacked(rows) -> list[np.ndarray]:
    """The features of both views, one row each."""
    return [np.frombuffer(b"".join(rows.column(c).to_pylist()), np.float32).reshape(rows.num_rows, -1) for c in ("text", "page")]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for b in batches:
        for a in range(0, b.num_rows, 512):
            yield _unpacked(b.slice(a, 512))


def _bins(odds: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.minimum((odds - low) * (BINS / (high - low)), BINS - 1).astype(int)


def _ends(counts: np.ndarray, bad: float, good: float) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the part of its rows among the ``bad`` lowest of all, and among the ``good`` highest.

    Rows of the bin at the edge, as equal scores are, all count in part.
    """
    n = np.maximum(counts, 1)
    up = np.clip(bad - (np.cumsum(counts) - counts), 0, counts) / n
    down = np.clip(good - (np.cumsum(counts[::-1])[::-1] - counts), 0, counts) / n
    return up, down


def _exchange(new: DataFrame, views: list[View], share: float, prior: float) -> list[np.ndarray] | None:
    """For each view the sums of the ``share`` of unlabelled documents that lie furthest at the other one's ends.

    ``prior`` of the share is taken as good from the top of the other view's own scores, the rest as bad from their
    bottom, however sure that view is. A view that scores all documents alike lends nothing.
    """

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[np.inf, -np.inf], [np.inf, -np.inf]]
        for x in _pieces(batches):
            for e, v, f in zip(ends, views, x):
                odds = v.log_odds(f)
                e[:] = min(e[0], odds.min()), max(e[1], odds.max())
        yield pa.record_batch([pa.array([e[k]]) for e in ends for k in (0, 1)], names)

    names = ["text_low", "text_high", "page_low", "page_high"]
    found = new.mapInArrow(reach, ", ".join(f"{c} double" for c in names)).agg(
        *[(F.max if c.endswith("high") else F.min)(c).alias(c) for c in names]
    ).first()
    if found is None or found[0] is None or found[0] > found[1]:
        return None
    spans = [(found[2 * k], found[2 * k + 1]) for k in (0, 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for x in _pieces(batches):
            for k, (v, f, (low, high)) in enumerate(zip(views, x, spans)):
                if low < high:
                    total[k] += np.bincount(_bins(v.log_odds(f), low, high), minlength=BINS)
        k, at = np.nonzero(total)
        yield pa.record_batch([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(total[k, at])], ["view", "bin", "n"])

    counts = np.zeros((2, BINS))
    for r in new.mapInArrow(count, "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["view"], r["bin"]] = r["n"]
    wanted = share * counts.sum(axis=1)
    ends = [_ends(c, (1 - prior) * m, prior * m) for c, m in zip(counts, wanted)]
    sizes = [len(v.mean) + 2 for v in views]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((n, n)) for n in sizes]
        for x in _pieces(batches):
            for k in (0, 1):
                low, high = spans[1 - k]
                if low == high:
                    continue
                at = _bins(views[1 - k].log_odds(x[1 - k]), low, high)
                for target, part in zip((-1.0, 1.0), ends[1 - k]):
                    weight = part[at]
                    use = weight > 0
                    if use.any():
                        total[k] += _sums(views[k].design(x[k][use]), np.full(use.sum(), target), weight[use])
        yield _total(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((n, n)) for n in sizes]
        for b in batches:
            for r in b.to_pylist():
                for k, c in enumerate(("text", "page")):
                    total[k] += np.frombuffer(r[c]).reshape(sizes[k], -1)
        yield _total(total)

    kind = "text binary, page binary"
    parts, n = new.mapInArrow(learn, kind), new.rdd.getNumPartitions()
    # One row of fixed size per task, added up FAN_IN at a time: a tree as deep as the logarithm of the tasks.
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(add, kind)
    some = parts.toArrow().to_pylist()
    return [sum(np.frombuffer(r[c]).reshape(sizes[k], -1) for r in some) for k, c in enumerate(("text", "page"))]


def _total(total: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([t.tobytes()], pa.binary()) for t in total], ["text", "page"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with further columns p_text, p_page and quality_score, which take the place of such columns of its own.

    Nulls count as empty text or a value of their own. A model of one kind of labels gives all documents one score.
    """
    own = [c for c in docs.columns if c not in ("p_text", "p_page", "quality_score")]
    return _scored(docs, model).select(*[F.col(f"row.`{c}`") for c in own], "score.*")


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): every row of ``docs`` as a struct beside its scores."""

    @F.pandas_udf("p_text double, p_page double, quality_score double")
    def score(text, lang, source, n):
        import pandas as pd

        parts = []
        for a in range(0, len(text), 512):
            t = text.iloc[a : a + 512].tolist()
            lengths = [len(x) if k != k or k is None else int(k) for x, k in zip(t, n.iloc[a : a + 512])]
            where = (list(v.iloc[a : a + 512].where(v.iloc[a : a + 512].notna(), None)) for v in (lang, source))
            parts.append(np.stack(model.scores(text_features(t), page_features(*where, lengths)), axis=1))
        flat = np.concatenate(parts) if parts else np.zeros((0, 3))
        return pd.DataFrame(flat, columns=["p_text", "p_page", "quality_score"])

    s = score(text_of(docs), docs["lang"].cast("string"), docs["source"].cast("string"), docs["n_chars"].cast("long"))
    return docs.select(whole_row(docs), s.alias("score"))


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose quality_score is at least ``least``, with all their columns.

    A model of one kind of labels keeps all rows, if those are good ones, or none.
    """
    return _scored(docs, model).where(F.col("score.quality_score") >= least).select("row.*")


def held_out_figures(docs: DataFrame, labels: DataFrame, most: int = 20_000, **options) -> dict[str, tuple[float, float]]:
    """(accuracy, area under the curve) of each view and of both together, on a fifth of the labels that :func:`fit` does
    not see. At most ``most`` scored labels come to the driver."""
    fifth = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("held out")), F.lit(5))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    model = fit(docs, known.where(fifth != 0), **options)
    held = known.where(fifth == 0).groupBy(F.col("doc_id").cast("long").alias("held_id")).agg(F.min("quality").alias("y"))
    own = docs.join(held, docs["doc_id"].cast("long") == held["held_id"])
    rows = _scored(own, model).select(F.col("row.y").alias("y"), "score.*").limit(most).collect()
    y = np.array([r["y"] for r in rows])
    found = {c: np.array([r[c] for r in rows]) for c in ("p_text", "p_page", "quality_score")}
    return {c: (float(((p >= 0.5) == (y == 1)).mean()), ordered(p, y)) for c, p in found.items()}


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_text, p_page, quality_score (0 to 1), accepted for every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, fit(docs, labels))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "p_text",
        "p_page",
        "quality_score",
        (F.col("quality_score") >= 0.5).alias("accepted"),
    )
