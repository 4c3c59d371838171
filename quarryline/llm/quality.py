"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text gives a fixed vector of statistics of all its bytes and words, transformed
so that shares and lengths lie on unbounded, even scales. The model is fitted on the
documents of about ``TRAIN_ROWS`` labels, chosen by a hash, which are broadcast: counts,
means and products per class are summed where the documents are, and the driver gets
these sums alone. Each class has a covariance shrunk towards the pooled variances,
kept as a Cholesky factor. A score is the logistic of the difference of the two log
densities, by Mahalanobis distances, and of the log prior. Scoring is one pass.

Null counts as empty; empty texts have statistics and a score like any other. Label
rows without a value or a document are passed over; repeated rows count again. With
no labels of one class the score is the smoothed share of label 1 for every text, and
an empty table of documents gives no rows. Further columns, whatever their names, are
kept by ``keep_good`` and passed over by ``quality_scores``. Very long texts are measured
in parts that end at white space; what stays of a part is a hash for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import CHUNK, WordHasher, chunks, word_bounds
from quarryline.llm.langid import held_out

#: Labelled documents that the model is fitted on, about.
TRAIN_ROWS = 20_000
#: Weight of the pooled variances in a class covariance, and the score from which a text is good.
SHRINK, GOOD = 0.1, 0.3
SEED = 41


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_SPACE = _set(b" \t\n\x0b\x0c\r")
_UPPER, _LOWER, _DIGIT = _set(bytes(range(65, 91))), _set(bytes(range(97, 123))), _set(b"0123456789")
_WIDE = _set(bytes(range(128, 256)))
_LETTER = _UPPER | _LOWER | _WIDE
_SETS = {
    "digit": _DIGIT, "wide": _WIDE, "stop": _set(b".,;:?"), "shout": _set(b"!"), "bar": _set(b"|"),
    "symbol": _set(b"#$%&*+/<=>@[]\\^_`{}~"), "quote": _set(b"\"'()-"), "line": _set(b"\n"),
}
FEATURES = ("bytes", "words", "mean_word", "sd_word", "upper", *_SETS, "distinct", "repeat", "top", "odd_end", "no_letter", "short", "entropy")


@cache
def _hasher() -> WordHasher:
    return WordHasher(SEED)


def _logit(share: np.ndarray, soft: float = 0.005) -> np.ndarray:
    return np.log((share + soft) / (1 - share + soft))


def _measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text the bytes of each value, words, and sums over the words: length, its square,
    equal to the last one, odd end, no letter, short. Then each word's hash, and its text."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    histogram = np.bincount(text * 256 + data, minlength=256 * n).reshape(n, 256).astype(float)
    starts, ends, first = word_bounds(~_SPACE[data], offsets)
    words = np.diff(first)
    of = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
    h = _hasher()(data, starts, ends)
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (of[1:] == of[:-1]))) if len(h) else np.zeros(0, bool)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd = ~(_LETTER | _DIGIT | _SETS["stop"])[last]
    kinds = (length, length**2, again, odd, letters[ends] == letters[starts], length <= 3)
    return histogram, words, np.column_stack([np.bincount(of, x.astype(float), n) for x in kinds]), h, of


def _measure_long(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``_measure`` for one text, in parts."""
    held, sums, at = [], None, 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        histogram, words, found, h, _ = _measure(data[at:end], np.array([0, len(data[at:end])]))
        if held and len(h) and len(held[-1]) and held[-1][-1] == h[0]:
            found[0, 2] += 1
        if len(h):
            held.append(h)
        sums = (histogram, words, found) if sums is None else tuple(a + b for a, b in zip(sums, (histogram, words, found), strict=True))
        at = end
    h = np.concatenate(held) if held else np.zeros(0, np.uint64)
    return *sums, h, np.zeros(len(h), np.int64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text, columns as ``FEATURES``."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    least = np.maximum(size, 1)
    histogram, words, sums, h, of = _measure_long(data) if n == 1 and len(data) > 2 * CHUNK else _measure(data, offsets)
    p = histogram / least[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    some = np.maximum(words, 1)
    length, square, again, odd, plain, short = sums.T
    mean = length / some
    sd = np.sqrt(np.maximum(square / some - mean**2, 0))
    order = np.lexsort((h, of))
    a, b = of[order], h[order]
    fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    distinct = np.bincount(a[fresh], minlength=n)
    runs = np.diff(np.concatenate((np.flatnonzero(fresh), [len(a)])))
    top = np.zeros(n)
    np.maximum.at(top, a[fresh], runs)
    cased = histogram[:, _UPPER | _LOWER].sum(axis=1)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(sd), _logit(histogram[:, _UPPER].sum(axis=1) / np.maximum(cased, 1)),
        *[_logit(histogram[:, s].sum(axis=1) / least) for s in _SETS.values()],
        np.log1p(distinct) / np.log(some + 1.0), _logit(again / some), _logit(top / some), _logit(odd / some),
        _logit(plain / some), _logit(short / some), entropy,
    ]
    return np.column_stack(columns)


def features(texts: pa.Array) -> np.ndarray:
    found = [statistics(data, offsets) for _, _, data, offsets in chunks(texts)]
    return np.concatenate(found) if found else np.zeros((0, len(FEATURES)))


class Discriminant:
    """Both classes' means and Cholesky factors; None if a class has no rows."""

    def __init__(self, count: np.ndarray, total: np.ndarray, product: np.ndarray, shrink: float = SHRINK):
        self.prior = float((count[1] + 1) / (count.sum() + 2))
        self.classes = None
        if count.min() < 1:
            return
        mean = total / count[:, None]
        cov = [product[c] / count[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
        pooled = np.diag(np.maximum((count[0] * np.diag(cov[0]) + count[1] * np.diag(cov[1])) / count.sum(), 1e-6))
        factors = [np.linalg.cholesky((1 - shrink) * c + shrink * pooled) for c in cov]
        self.classes = [(mean[c], np.linalg.inv(f), np.log(np.diag(f)).sum()) for c, f in enumerate(factors)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        bad, good = (-0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - logdet for mean, inverse, logdet in self.classes)
        z = good - bad + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Discriminant:
    """The model from (doc_id, text) and (doc_id, label) where ``usable`` holds of the id."""
    d = len(FEATURES)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & usable).groupBy("doc_id", "y").agg(F.count(F.lit(1)).alias("w"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20))
    total = rows.count()
    if total > TRAIN_ROWS:
        rows = rows.filter(part < max(1, (TRAIN_ROWS << 20) // total))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id").select("y", "w", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y, w = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(float)
            x = features(batch.column(2))
            for c in (0, 1):
                own, weight = x[y == c], w[y == c]
                held[c] += np.concatenate(([weight.sum()], weight @ own, ((own.T * weight) @ own).ravel()))
        c, k = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(held[c, k])], ["c", "k", "v"])

    found = both.mapInArrow(sums, "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect()
    held = np.zeros((2, 1 + d + d * d))
    for r in found:
        held[r.c, r.k] = r.v
    return Discriminant(held[:, 0], held[:, 1 : 1 + d], held[:, 1 + d :].reshape(2, d, d))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted); learned from the rows that are not held out."""
    out = held_out(modulus, remainder)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(features(batch.column(1))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """The documents whose score is ``GOOD`` or more, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~held_out(modulus, remainder)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(features(texts)))

    return docs.filter(score(F.col("text")) >= GOOD)
