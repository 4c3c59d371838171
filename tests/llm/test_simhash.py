import random

import numpy as np
import pytest
import xxhash

from quarryline.llm import graph, simhash
from quarryline.llm.xxh import xxh64


def brute_fp(text, k=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, radius):
    """Smallest fingerprint reachable, for each."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for b in fps[:i]:
                if bin(a ^ b).count("1") <= radius and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_hash_of_many_ranges():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 600)
    ends = starts + np.concatenate((np.arange(300), rng.integers(0, 1000, 300)))
    got = xxh64(data, starts, ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_fingerprints(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(2)
    texts = ["", " \n", "One", "one TWO", "a b c", "é É ß x\x0by z", "w " * 400]
    texts += [" ".join(rng.choices(["the", "Quick", "füchse", "x" * 600, "jumps\n"], k=rng.randrange(90))) for _ in range(60)]
    assert simhash.fingerprints([t.encode() for t in texts])[:, 0].tolist() == [brute_fp(t) for t in texts]


def flipped(rng, f, n):
    for b in rng.sample(range(64), n):
        f ^= 1 << b
    return f


def some_fps(seed, clusters, each, flips):
    rng = random.Random(seed)
    out = {0}
    for _ in range(clusters):
        f = rng.getrandbits(64)
        out |= {f} | {flipped(rng, f, rng.randrange(flips)) for _ in range(each)}
    return sorted(out)


@pytest.mark.parametrize(("radius", "hot", "group"), [(3, 4096, 1 << 18), (3, 60, 100), (6, 4096, 1 << 18), (8, 200, 1000), (0, 4096, 1 << 18)])
def test_search_finds_every_link(spark, radius, hot, group):
    fps = some_fps(radius, 30, 25, 8)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x, x, 0) for x in signed], "node long, fp long, other long")
    edges = simhash.search(df, radius, hot=hot, group=group).collect()
    index = {x: i for i, x in enumerate(signed)}
    root = graph.local_roots(np.array([index[e.u] for e in edges], int), np.array([index[e.v] for e in edges], int), len(fps))
    want = brute_classes(fps, radius)
    got = {f: fps[r] for f, r in zip(fps, root, strict=True)}
    assert len(set(got.values())) == len(set(want.values()))
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in fps[::7] for b in fps)


@pytest.mark.parametrize(("radius", "both"), [(0, 5), (8, 14)])
def test_search_compares_equal_fingerprints(spark, radius, both):
    rng = random.Random(radius)
    fp, bases = rng.getrandbits(64), [rng.getrandbits(64) for _ in range(6)]
    rows = [(flipped(rng, fp, rng.randrange(3) if i % 5 == 0 else 0), flipped(rng, rng.choice(bases), rng.randrange(5))) for i in range(700)]
    signed = np.array(rows, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, f, o) for i, (f, o) in enumerate(signed)], "node long, fp long, other long")
    edges = simhash.search(df, radius, both, hot=40, group=100).collect()
    got = graph.local_roots(np.array([e.u for e in edges], int), np.array([e.v for e in edges], int), len(rows))
    f, o = np.array(rows, np.uint64).T
    near = np.bitwise_count(f[:, None] ^ f)
    want = graph.local_roots(*np.nonzero((near <= radius) & (near + np.bitwise_count(o[:, None] ^ o) <= both)), len(rows))
    assert len(set(want.tolist())) > 5 and got.tolist() == want.tolist()


@pytest.mark.parametrize("n", [100, 10_000_000, 10_000_000_000])
def test_plan_keeps_the_pigeonhole(n):
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for radius in (0, 3, 6):
        chosen = simhash.plan(sample, n, radius)
        assert sum(t + 1 for _, t in chosen) == radius + 1
        bits = [b for g, _ in chosen for b in g]
        assert len(bits) == len(set(bits))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1400)) for _ in range(300)] + [(5000, k) for k in range(5001, 5300)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    nodes = sorted({x for e in edges for x in e})
    index = {x: i for i, x in enumerate(nodes)}
    root = graph.local_roots(np.array([index[a] for a, _ in edges]), np.array([index[b] for _, b in edges]), len(nodes))
    assert {x: found.get(x, x) for x in nodes} == {x: nodes[r] for x, r in zip(nodes, root, strict=True)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, base + " tail"), (4, None), (6, ""), (7, "other text altogether here"), (None, base), (5, base), (None, "alone with no id")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = [brute_fp(t) for _, t in rows]
    root = brute_classes(fps, 3)
    want = []
    for (d, _), f in zip(rows, fps, strict=True):
        ids = [e for (e, _), g in zip(rows, fps, strict=True) if root[g] == root[f] and e is not None]
        want.append((d, f"{f:016x}", min(ids, default=None)))
    assert found == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(40):
        base = fresh(rng.randrange(200, 500))
        for k in range(rng.randrange(1, 5)):
            words = list(base)
            if k:
                words[rng.randrange(len(words))] = "changed"  # five of hundreds of shingles
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words), "s", k))
    rows += [(1000, None, "s", 0), (1001, "", "s", 0), (None, "no id here", "s", 0), (2, rows[2][1], "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, fp int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {min(i for i, g in group.items() if g == k) for k in range(40)}
    assert want <= set(ids) and {1000, None} <= set(ids) and 1001 not in ids
    assert len(ids) == len(set(ids)) and len(set(ids) - want - {1000, None}) <= 3
    assert simhash.keep_one(docs.limit(0)).count() == 0


def jaccard(a, b):
    a, b = (set(zip(*[t.split()[i:] for i in range(5)])) for t in (a, b))
    return len(a & b) / len(a | b)


def test_keep_one_counts_a_repeated_line_once(spark):
    rng = random.Random(11)
    line = " the same line of nine words on every page"
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) + line * 20 for _ in range(12)]
    assert max(jaccard(texts[0], t) for t in texts[1:]) < 0.05
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 12


@pytest.mark.parametrize("block", [1 << 19, 700])
def test_keep_one_links_similar_texts_alone(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    rng = random.Random(12)
    rows, want = [], set()
    for g in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        own = []
        for k, edits in enumerate([0, 4, 11, 11, 11, 12]):
            words = list(base)
            for i in rng.sample(range(0, 400, 7), edits):
                words[i] = f"e{rng.randrange(10**6)}"
            own.append((10 * g + k, " ".join(words)))
        root = list(range(len(own)))
        for _ in own:
            root = [min(root[j] for j in range(len(own)) if jaccard(own[i][1], own[j][1]) >= 0.8) for i in range(len(own))]
        want |= {own[r][0] for r in root}
        rows += own
    assert len(want) > 30
    found = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), near=20, both=44)  # wide, so that every similar pair is a candidate
    kept = {r.doc_id for r in found.collect()}
    assert kept == want


def test_search_compares_many_equal_fingerprints(spark):
    rng = random.Random(21)
    fp, bases = rng.getrandbits(64), [rng.getrandbits(64) for _ in range(30)]
    rows = [(fp, flipped(rng, rng.choice(bases), rng.randrange(4))) for _ in range(5_000)]
    signed = np.array(rows, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, f, o) for i, (f, o) in enumerate(signed)], "node long, fp long, other long")
    edges = simhash.search(df, 3, 8, hot=500, group=1_000).collect()
    got = graph.local_roots(np.array([e.u for e in edges], int), np.array([e.v for e in edges], int), len(rows))
    other = np.array([o for _, o in rows], np.uint64)
    want = graph.local_roots(*np.nonzero(np.bitwise_count(other[:, None] ^ other) <= 8), len(rows))
    assert len(edges) < 40 * len(rows) and got.tolist() == want.tolist()


def test_hot_key_in_a_range_of_normal_size(spark):
    rng = random.Random(22)
    fps = sorted({rng.getrandbits(64) for _ in range(300)} | {flipped(rng, 5, rng.randrange(9)) for _ in range(600)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(signed)], "node long, fp long, other long")
    edges = simhash.search(df, 3, hot=20).collect()  # all ranges far below ``group``
    got = graph.local_roots(np.array([e.u for e in edges], int), np.array([e.v for e in edges], int), len(fps))
    f = np.array(fps, np.uint64)
    assert got.tolist() == graph.local_roots(*np.nonzero(np.bitwise_count(f[:, None] ^ f) <= 3), len(fps)).tolist()


def key_of_rows(homes, visitors):
    """One key's rows as arrays: key, node, fp, other, home, used; near fingerprints among them."""
    rng = random.Random(homes)
    bases = [rng.getrandbits(64) for _ in range(12)]
    n = homes + visitors
    fp = np.array([flipped(rng, rng.choice(bases), rng.randrange(7)) for _ in range(n)], np.uint64)
    other = np.array([flipped(rng, 9, rng.randrange(9)) for _ in range(n)], np.uint64)
    home = np.array(rng.sample([True] * homes + [False] * visitors, n))
    return np.full(n, 77, np.uint64), np.arange(n), fp, other, home, np.zeros(n, np.uint64)


def test_visitors_do_not_make_a_key_hot():
    rows = key_of_rows(60, 900)
    calm = simhash._outcome(*rows, 5, 9, 300)  # 960 rows, 57,600 pairs of 90,000
    assert calm.column("key").null_count == calm.num_rows
    _, _, fp, other, home, _ = rows
    far = np.bitwise_count(fp[:, None] ^ fp)
    a, b = np.nonzero((far <= 5) & (far + np.bitwise_count(other[:, None] ^ other) <= 9) & (home[:, None] | home))
    found = graph.local_roots(*(calm.column(c).to_numpy() for c in "uv"), len(fp))
    assert len(set(found.tolist())) < len(fp) and found.tolist() == graph.local_roots(a, b, len(fp)).tolist()
    hot = simhash._outcome(*key_of_rows(101, 900), 5, 9, 300)
    assert hot.column("key").null_count == 0 and hot.num_rows == 1001


@pytest.mark.parametrize(("wide", "tile", "held"), [(1, 1, 1 << 20), (1, 500, 40), (1, 1 << 15, 1 << 20), (1 << 40, 1, 40)])
def test_tiles_compare_every_pair(monkeypatch, wide, tile, held):
    for name, value in (("WIDE_KEY", wide), ("TILE", tile), ("HELD", held)):
        monkeypatch.setattr(simhash, name, value)
    parts = [key_of_rows(h, v) for h, v in ((50, 200), (1, 30), (0, 20), (120, 0), (1, 0))]
    key = np.concatenate([np.full(len(p[0]), k, np.uint64) for k, p in enumerate(parts)])
    _, _, fp, other, home, _ = (np.concatenate(c) for c in zip(*parts, strict=True))
    node = np.arange(len(key)) % 300  # some nodes come under several keys
    far = np.bitwise_count(fp[:, None] ^ fp)
    for both in (5, 9):
        a, b = np.nonzero((far <= 5) & (far + (both > 5) * np.bitwise_count(other[:, None] ^ other) <= both) & (home[:, None] | home) & (key[:, None] == key))
        found = graph.local_roots(*simhash.links_of_keys(key, node, fp, other, home, 5, both), 300)
        assert found.tolist() == graph.local_roots(node[a], node[b], 300).tolist()


def similar_pair(rng, low, high):
    """Two texts whose similarity lies in a range, and the similarity."""
    while True:
        n = rng.randrange(60, 400)
        words = [f"w{rng.randrange(5_000)}" for _ in range(n)]
        other = list(words)
        for i in rng.sample(range(n), max(1, int(n * rng.uniform(0.01, 0.07)))):
            other[i] = f"z{rng.randrange(10**6)}"
        a, b = " ".join(words), " ".join(other)
        if low <= jaccard(a, b) < high:
            return a, b


@pytest.mark.parametrize(("low", "high", "least"), [(0.80, 0.83, 0.9), (0.83, 0.87, 0.94), (0.87, 1.0, 0.99)])
def test_recall_of_the_candidates(low, high, least):
    rng = random.Random(31)
    pairs = [similar_pair(rng, low, high) for _ in range(1_500)]
    n = simhash.FINGERPRINTS
    a, b = (simhash.fingerprints([p[k].encode() for p in pairs], simhash.WIDE, count=n, distinct=True)[:, :n] for k in (0, 1))
    far = np.bitwise_count(a ^ b)
    both = far + np.roll(far, -1, axis=1)
    assert ((far <= simhash.NEAR) & (both <= simhash.BOTH)).any(axis=1).mean() >= least


def test_keep_one_recall_and_precision(spark):
    rng = random.Random(32)
    near = [similar_pair(rng, 0.80, 0.90) for _ in range(150)]
    apart = [similar_pair(rng, 0.65, 0.79) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(t for p in near + apart for t in p)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(i not in kept for i in range(1, 300, 2)) >= 0.93 * 150
    assert set(range(0, 300, 2)) <= kept and set(range(300, 600)) <= kept


def test_a_long_text(spark):
    rng = random.Random(33)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(1_500_000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x" * 3_000_000)], "doc_id long, text string")
    by = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert by[1].component_id == by[2].component_id == 1 and by[3].component_id == 3
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {1, 3}
