import numpy as np
import pytest

from quarryline.llm import embeddings


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                link[i, j] = link[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in group:
                group.add(k)
                todo += np.flatnonzero(link[k]).tolist()
        seen |= group
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        least = min(ids, default=None)
        for k in group:
            out[k] = (rows[k][0], int(link[k].sum()), least, True if not usable(rows[k][1]) else None if None in (rows[k][0], least) else rows[k][0] == least)
    return out


def clustered(seed, dim=24, clusters=25, each=8, noise=0.03):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(clusters):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        out += [(c + noise * rng.standard_normal(dim) / np.sqrt(dim) * np.sqrt(dim) / 3).tolist() for _ in range(each)]
    return out


@pytest.mark.parametrize("block", [4096, 40])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    vectors = clustered(block)
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]], None, [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] + [0.0] * 23, [], [1.0, 0.0], [1.0, 0.01], [1e30] * 24]
    rows = [(i * 3 % 251, v) for i, v in enumerate(vectors)] + [(7, vectors[2]), (None, vectors[3]), (None, [0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, h int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = [tuple(r) for r in embeddings.near_duplicates(df).collect()]
    want = brute(rows)
    same = sum(a == b for a, b in zip(sorted(found, key=str), sorted(want, key=str), strict=True))
    assert same >= 0.99 * len(want)
    links, all_links = sum(r[1] for r in found), sum(r[1] for r in want)
    assert 0.97 * all_links <= links <= all_links


def test_recall_at_the_threshold():
    """Pairs just above the threshold, the worst case for the count."""
    rng = np.random.default_rng(3)
    dim, n = 64, 1500
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = 0.951
    y = c * x + np.sqrt(1 - c * c) * z
    width, count, reach = embeddings.calibrate(dim)
    basis = embeddings.directions(dim)
    apart = np.abs(x @ basis - y @ basis)
    passed = (((apart <= width).sum(1) >= count) & (apart[:, 0] <= reach)).mean()
    assert passed >= 0.98
    assert count >= 10


def test_nothing_to_link(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.keep_one(df).count() == 2
