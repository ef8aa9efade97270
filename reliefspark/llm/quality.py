"""Quality classifier: Bradley-Terry ranking. Scores are learned from all pairs of a preferred and a rejected document by
logistic loss on the difference of their features; a quantile of the scores is the threshold."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialize, release, small, small_batches, values

#: Labelled rows up to which their features are held by the driver; more stay in a table that each step reads.
DRIVER_ROWS = 10_000
#: Buckets of the hashed words and word pairs, and what their shares' roots are multiplied by, to be as large as shape features.
NGRAMS, GRAM_SCALE = 1024, 32.0
#: Penalty on the squares of the weights; steps at most, and steps remembered, when they are learned.
RIDGE, STEPS, REMEMBERED = 1e-4, 25, 8
#: Latent scores are counted on points 1 / POINTS apart, up to BOUND on either side of zero, a score on the two beside it.
POINTS, BOUND, PARTS = 32, 64, 1024
#: At least this score is predicted 1.
CUT = 0.3

NAMES = ("log_bytes", "upper", "lower", "digit", "white", "newline", "high", "bar", "marks", "stops", "symbols", "brackets", "other", "word_length", "distinct_words", "distinct_lines", "log_words", "mean_line", "shouting", "short_words", "digit_words", "symbol_words", "top_word", "entropy", "one_letter", "repeated_pairs")


def _groups() -> np.ndarray:
    m = np.zeros((256, 12))
    for k, chars in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 11, 12, 13), (10,), range(128, 256), b"|", b"!?", b".,;:", b"#$%&*@^~=+_/\\", b"()[]{}<>\"'`-")):
        m[list(chars), k] = 1
    m[m.sum(axis=1) == 0, 11] = 1
    return m


GROUPS = _groups()


def features(data: bytes | None) -> np.ndarray:
    """Shape of the whole text: shares of kinds of bytes and words, repeats of words, word pairs and lines. Empty: zeros."""
    x = np.zeros(len(NAMES))
    words = (data or b"").split()
    if not words:
        return x
    n, w = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    x[0] = math.log1p(n) / 10
    x[1:13] = counts @ GROUPS / n
    lines = [s for s in data.split(b"\n") if s.strip()]
    distinct = set(words)
    sizes = np.fromiter(map(len, words), np.int64, w)
    p = counts[counts > 0] / n
    x[13] = min(float(sizes.mean()), 40) / 10
    x[14] = len(distinct) / w
    x[15] = len(set(lines)) / len(lines)
    x[16] = math.log1p(w) / 10
    x[17] = math.log1p(w / len(lines)) / 5
    x[18] = sum(map(bytes.isupper, words)) / w
    x[19] = float((sizes <= 3).mean())
    x[20] = sum(map(bytes.isdigit, words)) / w
    x[21] = float(counts[[33, 35, 36, 37, 38, 42, 64, 124]].sum()) / w
    x[22] = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / w
    x[23] = float(-(p * np.log2(p)).sum()) / 8
    x[24] = float((sizes == 1).mean())
    x[25] = 1 - len(set(zip(words, words[1:], strict=False))) / max(1, w - 1)
    return x


def word_grams(data: bytes | None, memo: WordHashes) -> np.ndarray:
    """Buckets of the words and pairs of neighbours of the whole text, A-Z lower-cased, one for each place."""
    words = (data or b"").lower().split()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9FB21C651E98DF25)) ^ h[1:]
    pairs ^= pairs >> np.uint64(31)
    return (np.concatenate([h, pairs]) >> np.uint64(7)).astype(np.int64) % NGRAMS


def gram_vector(grams: np.ndarray) -> np.ndarray:
    """Roots of the shares of the buckets, of length one: how often a text has a word counts little, how long it is not at all."""
    return np.sqrt(np.bincount(grams, minlength=NGRAMS) / max(1, len(grams)))


def _rows(texts: pa.Array) -> Iterator[np.ndarray]:
    memo = WordHashes()
    for t in values(texts):
        yield np.append(features(t), gram_vector(word_grams(t, memo)))


def feature_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(y, shape array<double>, grams binary: how often each bucket of n-grams occurs) of every row of docs, which has a label __y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column(1).to_pylist()
                counts = [np.bincount(word_grams(t, memo), minlength=NGRAMS) for t in texts]
                packed = [c.astype("<u2" if c.max() < 1 << 16 else "<u4").tobytes() for c in counts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([features(t) for t in texts], pa.list_(pa.float64())), pa.array(packed, pa.binary())], ["y", "shape", "grams"])
        release()

    return small_batches(docs).select(F.col("__y").cast("int").alias("y"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "y int, shape array<double>, grams binary")


@dataclass
class BradleyTerry:
    """grams: weights of the n-gram buckets; weights: of the centred and scaled shape features and their squares; slope, offset: from the latent score to the chance of label 1; threshold: the score at the quantile of rejected documents."""

    grams: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.latent(x)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    def latent(self, x: np.ndarray) -> np.ndarray:
        """x: rows of shape features, then n-gram vectors."""
        k = len(NAMES)
        return expand((x[:, :k] - self.mean) / self.scale) @ self.weights + np.einsum("ij,j->i", x[:, k:], self.grams)


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, bounded, with squares: junk is at either end."""
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z / 6])


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression without intercept."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(y, x) of rows of a feature_table, x as _rows gives it, a few hundred at a time."""
    for lo in range(0, b.num_rows, 512):
        part = b.slice(lo, 512)
        shape = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
        counts = np.stack([np.frombuffer(g, "<u2" if len(g) == 2 * NGRAMS else "<u4") for g in part.column(2).to_pylist()])
        yield part.column(0).to_numpy(), np.hstack([shape, np.sqrt(counts / np.maximum(counts.sum(axis=1, dtype=np.int64), 1)[:, None])])


class Labelled:
    """All labelled rows: a table of features, or the same rows at the driver if they are few."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.own = table.toArrow().combine_chunks().to_batches() if table.count() <= DRIVER_ROWS else None

    def total(self, one: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of one(y, x) over blocks of the rows: an array of doubles."""

        def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | float:
            return sum((one(y, x) for b in batches for y, x in _blocks(b)), 0.0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = add(batches)
            if isinstance(got, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array([got.tolist()], pa.list_(pa.float64()))], ["v"])
            release()

        if self.own is not None:
            return add(iter(self.own))
        return sum(np.array(v) for v in small_batches(self.table).mapInArrow(run, "v array<double>").toArrow()["v"].to_pylist())

    def latent(self, model: BradleyTerry, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """The different latent scores from low to below high, ascending, and how many rows have each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, x in _blocks(b):
                    s = model.latent(x)
                    yield pa.RecordBatch.from_arrays([pa.array(s[(s >= low) & (s < high)])], ["s"])
            release()

        if self.own is not None:
            return np.unique(np.concatenate([r.column(0).to_numpy() for r in run(iter(self.own))]), return_counts=True)
        got = small_batches(self.table).mapInArrow(run, "s double").groupBy("s").count().orderBy("s").toArrow()
        return got["s"].to_numpy(), got["count"].to_numpy()


def _places(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point at or below each score, and its share of the next one in PARTS."""
    at = (np.clip(s, -BOUND, BOUND - 1 / POINTS) + BOUND) * POINTS
    k = np.floor(at).astype(np.int64)
    return k, np.rint((at - k) * PARTS)


def _histogram(y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Scores on the points: of rows labelled 0, then of those labelled 1. Whole numbers, in parts, so sums do not depend on order."""
    n = 2 * BOUND * POINTS + 1
    k, share = _places(s)
    k = k + y * n
    return np.bincount(k, PARTS - share, 2 * n) + np.bincount(k + 1, share, 2 * n)


def _pair_loss(histogram: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean logistic loss of the difference over every pair of a row labelled 1 and one labelled 0, and its slope by the score of
    a row at each point (of rows labelled 0, then 1)."""
    bad, good = (h / h.sum() for h in np.split(histogram, 2))
    rows = histogram.reshape(2, -1).sum(axis=1) / PARTS
    n = len(bad)
    apart = np.arange(-(n - 1), n) / POINTS  # of a good row's score less a bad one's
    wrong = 1 / (1 + np.exp(apart))
    used_bad, used_good = np.flatnonzero(bad), np.flatnonzero(good)
    of_good, of_bad, loss = np.zeros(n), np.zeros(n), np.zeros(n)
    softplus = np.logaddexp(0, -apart)
    for k in used_bad:
        of_good += bad[k] * wrong[n - 1 - k : 2 * n - 1 - k]
        loss += bad[k] * softplus[n - 1 - k : 2 * n - 1 - k]
    for k in used_good:
        of_bad += good[k] * wrong[k : k + n][::-1]
    return float(loss @ good), np.concatenate([of_bad / rows[0], -of_good / rows[1]])


def fit(rows: Labelled) -> BradleyTerry:
    """With labels of one kind only, or none, every score is that kind's share of the labels (a half for none).

    Every pair of a row labelled 1 and one labelled 0 has a logistic loss on the difference of their scores. The losses of
    all pairs follow from how many rows of either label score what, so a step (L-BFGS) reads each row twice: for these
    counts, then for the slope. The calibration and the threshold are of all rows too."""
    k = len(NAMES)
    moments = rows.total(lambda y, x: np.concatenate([[len(y), y.sum()], x[:, :k].sum(axis=0)]))
    n, ones = (moments[0], moments[1]) if np.ndim(moments) else (0.0, 0.0)
    share = (ones + 0.5) / (n + 1)
    if not 0 < ones < n:
        return BradleyTerry(np.zeros(NGRAMS), np.zeros(k), np.ones(k), np.zeros(2 * k), 0.0, math.log(share / (1 - share)), share)
    mean = moments[2:] / n
    scale = np.maximum(np.sqrt(rows.total(lambda y, x: ((x[:, :k] - mean) ** 2).sum(axis=0)) / n), 1e-3)

    def model(w: np.ndarray) -> BradleyTerry:
        return BradleyTerry(w[2 * k :] * GRAM_SCALE, mean, scale, w[: 2 * k], 1.0, 0.0, 0.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        m = model(w)
        histogram = rows.total(lambda y, x: _histogram(y, m.latent(x)))
        value, slopes = _pair_loss(histogram)
        return value + RIDGE / 2 * float(w @ w), slopes, histogram

    def gradient(w: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        m, points = model(w), len(slopes) // 2

        def one(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            at, next_ = _places(m.latent(x))
            at, next_ = at + y * points, next_ / PARTS
            g = slopes[at] * (1 - next_) + slopes[at + 1] * next_
            return np.concatenate([g @ expand((x[:, :k] - mean) / scale), g @ x[:, k:] * GRAM_SCALE])

        return rows.total(one) + RIDGE * w

    w = np.zeros(2 * k + NGRAMS)
    value, slopes, histogram = loss(w)
    g = gradient(w, slopes)
    first, past = float(np.linalg.norm(g)), []
    for _ in range(STEPS):
        d, kept = -g, []
        for s, t in reversed(past):
            kept.append(float(s @ d) / float(s @ t))
            d = d - kept[-1] * t
        d = d * (float(past[-1][0] @ past[-1][1]) / float(past[-1][1] @ past[-1][1]) if past else 1 / first)
        for (s, t), a in zip(past, reversed(kept), strict=True):
            d = d + (a - float(t @ d) / float(s @ t)) * s
        step = 1.0
        after = loss(w + d)
        while after[0] > value + 1e-4 * step * float(g @ d) and step > 1e-3:
            step /= 2
            after = loss(w + step * d)
        if after[0] >= value:
            break
        now = gradient(w + step * d, after[1])
        if float(d @ (now - g)) > 0:
            past = [*past, (step * d, now - g)][-REMEMBERED:]
        w, g, value, histogram = w + step * d, now, after[0], after[2]
        if np.linalg.norm(g) < 1e-3 * first:
            break
    m = model(w)
    at = np.arange(len(histogram) // 2) / POINTS - BOUND
    m.slope, m.offset = map(float, _newton(np.column_stack([np.tile(at, 2), np.ones(len(histogram))]), np.repeat([0.0, 1.0], len(at)), histogram / histogram.sum(), ridge=1e-6))
    m.threshold = _quantile(rows, m, n, 1 - ones / n)
    return m


def _quantile(rows: Labelled, m: BradleyTerry, n: float, share: float) -> float:
    """The score of the rows at a share of them: halfway between the scores to both sides, which are read from the rows themselves."""
    width = 2 * BOUND * POINTS

    def one(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(_places(m.latent(x))[0], minlength=width).astype(float)

    upto = np.cumsum(rows.total(one))
    ranks = [math.floor((n - 1) * share + 1e-9), math.ceil((n - 1) * share - 1e-9)]
    lo, hi = (int(np.searchsorted(upto, r, side="right")) for r in ranks)
    low = -math.inf if lo == 0 else lo / POINTS - BOUND
    high = math.inf if hi >= width - 1 else (hi + 1) / POINTS - BOUND
    s, count = rows.latent(m, low, high)
    before = (upto[lo - 1] if lo else 0) + np.cumsum(count)
    got = np.array([s[int(np.searchsorted(before, r, side="right"))] for r in ranks])
    return float((1 / (1 + np.exp(-np.clip(m.slope * got + m.offset, -30, 30)))).mean())


def held_out(key: F.Column) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> BradleyTerry:
    """Fits labels.quality of all docs that are not held out. Null labels and ids are left out."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__y")).where(~held_out(F.col("__id"))).distinct()
    known = materialize(known, "labelled")
    own = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text")
    return fit(Labelled(materialize(feature_table(own.join(small(known, known.count()), F.col("__doc") == F.col("__id"))), "features")))


def _scores(model: BradleyTerry, texts: pa.Array) -> np.ndarray:
    """Scores of whole texts, a few hundred feature rows in memory."""
    out = [np.zeros(0)]
    for lo in range(0, len(texts), 256):
        part = texts.slice(lo, 256)
        out.append(model.score(np.array(list(_rows(part)))))
    return np.concatenate(out)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, above_quantile.

    Null and empty texts have features of zero and a score like any other; null ids are not held out; rows that repeat
    an id are scored each. Labels of documents that are not there are not used. Other columns are not looked at."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)))], ["doc_id", "score"])
        release()

    scored = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("t")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= model.threshold).alias("above_quantile"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without those scored below the threshold: the quantile of the fitted documents' scores that matches
    the share of rejected labels.

    Null and empty texts are scored like any other, with features of zero; null and repeated ids too, each row by its own
    text. Without labels of both kinds all rows stay. An empty table stays empty."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column(at).cast(pa.binary())) >= model.threshold - 1e-12))
        release()

    return small_batches(docs).mapInArrow(run, docs.schema)
