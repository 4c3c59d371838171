import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import quality


def make(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choices(["the", "ing", "er", "tion", "é", "an"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80))]
        good = rng.random() < 0.7
        if good:
            text = ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9))
        else:
            text = rng.choice([" ".join(w + "%%%" for w in words), " | ".join(words), "!! ".join(words).upper(), " ".join(words[:2] * len(words))])
        out.append((i, text, int(good)))
    return out


def frames(spark, rows, extra=()):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(*e, "x") for e in extra], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    rows = make(900)
    docs, labels = frames(spark, rows, [(5000, None), (5001, ""), (None, "no id"), (3, rows[3][1]), (5002, "long " * 50_000)])
    labels = labels.union(spark.createDataFrame([(77, None, 0), (9999, 1, 0)], labels.schema))
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == 905 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    truth = {i: y for i, _, y in rows}
    out = [r for r in found if r.held_out]
    assert {r.doc_id for r in out if r.doc_id < 900} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.predicted)


@pytest.mark.parametrize("only", [None, 1])
def test_without_one_class(spark, only):
    docs, labels = frames(spark, make(20))
    found = quality.quality_scores(docs, labels.filter(f"quality = {only}") if only is not None else labels.limit(0)).collect()
    assert len({r.score for r in found}) == 1 and (found[0].score > 0.5 if only else found[0].score == 0.5)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_scores_are_the_log_density_difference():
    rng = np.random.default_rng(0)
    x0, x1 = rng.standard_normal((200, 4)), 2 + 0.5 * rng.standard_normal((300, 4))
    m = quality.Discriminant(np.array([200, 300]), np.array([x0.sum(0), x1.sum(0)]), np.array([x0.T @ x0, x1.T @ x1]), 0.1)
    pooled = np.diag((200 * x0.var(0) + 300 * x1.var(0)) / 500)

    def density(x, own):
        c = 0.9 * np.cov(own.T, bias=True) + 0.1 * pooled
        d = x - own.mean(0)
        return -0.5 * d @ np.linalg.solve(c, d) - 0.5 * np.linalg.slogdet(c)[1]

    for x in rng.standard_normal((20, 4)):
        z = density(x, x1) - density(x, x0) + np.log(301 / 201)
        assert m.scores(x[None])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_statistics_per_text_do_not_depend_on_neighbours():
    texts = ["", "one", "Der Der Der!", "é | é\n5 5", " \n", "x" * 300]
    together = quality.features(pa.array(texts))
    alone = np.concatenate([quality.features(pa.array([t])) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all() and together.shape[1] == len(quality.FEATURES)


def plain_features(text):
    """The statistics by plain loops."""
    data = text.encode()
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", data)
    n, size = max(1, len(words)), max(1, len(data))
    logit = lambda p: math.log((p + 0.005) / (1 - p + 0.005))
    of = lambda chars: sum(b in chars for b in data) / size
    upper, lower, digit = set(range(65, 91)), set(range(97, 123)), set(range(48, 58))
    letter = upper | lower | set(range(128, 256))
    mean = sum(map(len, words)) / n
    sd = math.sqrt(max(0, sum(len(w) ** 2 for w in words) / n - mean**2))
    sets = [digit, set(range(128, 256)), set(b".,;:?"), set(b"!"), set(b"|"), set(b"#$%&*+/<=>@[]\\^_`{}~"), set(b"\"'()-"), set(b"\n")]
    counts = Counter(words)
    shares = [
        sum(a == b for a, b in zip(words, words[1:], strict=False)), max(counts.values(), default=0), sum(w[-1] not in letter | digit | set(b".,;:?") for w in words),
        sum(not letter & set(w) for w in words), sum(len(w) <= 3 for w in words),
    ]
    entropy = -sum(c / size * math.log2(c / size) for c in Counter(data).values())
    cased = sum(b in upper | lower for b in data)
    first = [math.log1p(len(data)), math.log1p(len(words)), math.log1p(mean), math.log1p(sd), logit(sum(b in upper for b in data) / max(1, cased))]
    return [*first, *[logit(of(x)) for x in sets], math.log1p(len(counts)) / math.log(n + 1), *[logit(x / n) for x in shares], entropy]


def test_features_match_plain_loops(monkeypatch):
    texts = ["", "one", "Der Der Der!", "é | é\n5 5", " \n", "x" * 300, *[t for _, t, _ in make(60, 4)], "a a " * 90 + "B-1 #x"]
    want = [plain_features(t) for t in texts]
    assert np.allclose(quality.features(pa.array(texts)), want)
    monkeypatch.setattr(quality, "CHUNK", 16)  # every text in parts
    assert np.allclose(np.concatenate([quality.features(pa.array([t])) for t in texts]), want)


def test_scores_match_brute_force(spark):
    rows = make(250, 9)
    docs, labels = frames(spark, rows)
    labels = labels.union(labels.filter("doc_id < 40"))  # repeated labels count again
    x = np.array([plain_features(t) for _, t, _ in rows])
    weight = np.array([(2 if i < 40 else 1) * (zlib.crc32(str(i).encode()) % 5 != 0) for i, _, _ in rows])
    y = np.array([c for *_, c in rows])
    fit = []
    pooled = 0
    for c in (0, 1):
        w = weight * (y == c)
        mean = w @ x / w.sum()
        cov = ((x - mean).T * w) @ (x - mean) / w.sum()
        pooled = pooled + w.sum() / weight.sum() * np.diag(np.diag(cov))
        fit.append((mean, cov))
    z = np.log((weight @ y + 1) / (weight @ (1 - y) + 1))
    for sign, (mean, cov) in zip((-1, 1), fit, strict=True):
        c = 0.9 * cov + 0.1 * np.maximum(pooled, 1e-6 * np.eye(len(pooled)))
        d = x - mean
        z = z + sign * (-0.5 * (d * np.linalg.solve(c, d.T).T).sum(axis=1) - 0.5 * np.linalg.slogdet(c)[1])
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert np.allclose([got[i] for i, _, _ in rows], 1 / (1 + np.exp(-np.clip(z, -500, 500))), atol=1e-6)


def test_bounded_sample_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 300)
    rows = make(1200, 5)
    docs, labels = frames(spark, rows, [(7000, "the thing is in. " * 1_300_000), (7001, "x" * 5_000_000)])
    found = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert np.mean([found[i].predicted == y for i, _, y in rows]) > 0.95 and len(found) == 1202
