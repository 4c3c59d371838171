import hashlib
import random
import re
from collections import Counter

import pytest

from quarryline.llm import substring

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    texts = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        cut = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in cut)
        out.append((d, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(50)}é" for _ in range(n)]
    passages = [fresh(n) for n in (20, 34, 35, 36, 60, 200)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "short text"), (None, " ".join(passages[2])), (4, " ".join(passages[4] * 3)), (5, "a " * 300)]
    for k in range(40):
        words = []
        for _ in range(rng.randrange(4)):
            words += fresh(rng.randrange(60)) + rng.choice(passages)
        rows.append((6 + k, rng.choice([" ", "\n", "  \x0b"]).join(words)))
    return rows + rows[10:14]  # repeated rows


@pytest.mark.parametrize("window", [35, 20, 8])
def test_against_brute_force(spark, window):
    rows = corpus(window)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, k1 int")
    found = substring.removal_digests(docs, window).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, window)


def test_levels_double():
    assert substring.levels(35) == [9, 18, 35]


def test_nothing_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "all different words here"), (2, None)], "doc_id long, text string")
    assert [r.n_removed for r in substring.removal_digests(docs).collect()] == [0, 0]
    assert substring.removal_digests(docs.limit(0)).count() == 0


def test_remove_keeps_columns(spark):
    twice = " ".join(f"x{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a\n{twice} b", "p"), (2, f"{twice}", "q"), (3, "un  touched", "r"), (4, None, None)], "doc_id long, text string, spans string")
    kept = {r.doc_id: (r.text, r.spans) for r in substring.remove_repeats(docs).collect()}
    assert kept == {1: ("a b", "p"), 2: ("", "q"), 3: ("un  touched", "r"), 4: (None, None)}


def test_a_long_text(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    long = " ".join(f"w{rng.randrange(10**8)}" for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, f"{long} {passage}"), (2, f"start {passage} end"), (3, "x" * 4_000_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in substring.removal_digests(docs).collect()}
    assert [(found[i].n_words, found[i].n_removed) for i in (1, 2, 3)] == [(1_000_060, 60), (62, 60), (1, 0)]
