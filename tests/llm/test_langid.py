import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import langid

TABLE = {"en": ["the", "and", "house", "water", "thing"], "fr": ["le", "été", "maison", "eau", "chose"], "日": ["水", "家", "もの", "日本"]}


def make(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(TABLE))
        words = rng.choices(TABLE[lang], k=rng.randrange(3, 30))
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words).title(), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = make(400) + [(900, None, "en"), (901, "", "fr"), (902, "123 !!", "fr"), (903, "watery thingies", None), (None, "maison", "fr"), (5, "the and", "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    found = langid.language_predictions(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for i, _, lang in make(400):
        if i != 5:
            assert by[i].lang_pred == lang and 0 <= by[i].score <= 1
            assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred == "en"  # unseen words fall back to n-grams
    assert by[None].lang_pred == "fr" and by[None].held_out is False


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.language_predictions(docs).collect()} == {"und"}
    assert langid.language_predictions(docs.limit(0)).count() == 0


def brute(model, text):
    """Word by word, with plain dictionaries."""
    h = lambda s: int(langid._hasher()(np.frombuffer(s.encode("utf-32-le"), np.uint32), np.array([0]), np.array([len(s)]))[0])
    tables = {}
    for n, t in model.tables.items():
        tables[n] = {}
        for i, key in enumerate(t.hashes.tolist()):
            row = t.base.copy()
            for j in range(t.first[i], t.first[i + 1]):
                row[t.lang[j]] += t.gain[j]
            tables[n][key] = row
    total = np.zeros(len(model.languages))
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if h(w) in tables[0]:
            total += tables[0][h(w)]
            continue
        for n in langid.GRAMS:
            hits = [tables[n][h(w[i : i + n])] for i in range(len(w) - n + 1) if h(w[i : i + n]) in tables[n]]
            if hits:
                total += np.mean(hits, axis=0)
                break
    return total


@pytest.mark.parametrize("part", [7, 1 << 19])
def test_scores_match_brute_force(spark, monkeypatch, part):
    docs = spark.createDataFrame(make(120, 3), "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "TOP_WORDS", 4)
    monkeypatch.setattr(langid, "TOP_GRAMS", 6)
    model = langid.train(docs, langid.F.lit(True))
    monkeypatch.setattr(langid, "PART", part)
    texts = ["the houses of waters", "l'été dernier", "家もの xyz", "q", "The Thing, the water? " * 9, None, "water " * 40]
    found, n = model.totals(texts)
    assert np.allclose(found, [brute(model, t or "") for t in texts], atol=1e-3)
    assert n.tolist() == [len(re.findall(r"[^\W\d_]+", t or "")) for t in texts]


def counted(rows):
    """(n, lang, hash) to count, by plain loops."""
    h = lambda s: int(langid._hasher()(np.frombuffer(s.encode("utf-32-le"), np.uint32), np.array([0]), np.array([len(s)])).view(np.int64)[0])
    out = Counter()
    for _, text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            out[0, lang, h(w)] += 1
            for n in langid.GRAMS:
                for i in range(len(w) - n + 1):
                    out[n, lang, h(w[i : i + n])] += 1
    return out


def test_counts_and_vocabulary_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "PART", 100)
    rows = make(80, 5)
    counts = langid.training_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {(r.n, r.lang, r.h): r.c for r in counts.collect()} == counted(rows)
    tied = [(0, "en", h, c) for h, c in ((9, 5), (3, 2), (-4, 2), (7, 2), (8, 1))] + [(0, "fr", 1, 1), (2, "en", 5, 4), (2, "en", 6, 4), (2, "en", 7, 4)]
    all_rows = [(*k, c) for k, c in counted(rows).items()]
    for table, limits in ((tied, (3, 2)), (all_rows, (3, 7)), (all_rows, (100, 100)), (all_rows, (1, 0)), ([], (2, 2))):
        chosen, sums = langid.vocabulary(langid.stage(spark.createDataFrame(table, "n int, lang string, h long, c long")), *limits)
        groups = {}
        for r in table:
            groups.setdefault(r[:2], []).append(r)
        expected = [r for (n, _), g in groups.items() for r in sorted(g, key=lambda r: (-r[3], r[2]))[: limits[n > 0]]]
        assert sorted(map(tuple, chosen.collect())) == sorted(expected)
        assert {(r.n, r.lang): r.total for r in sums.collect()} == {k: sum(r[3] for r in g) for k, g in groups.items()}


def test_each_language_has_its_share(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 300)
    rows = [r for r in make(4000, 6) if r[2] != "日"] + [(5000 + i, t, lang) for i, t, lang in make(200, 7) if lang == "日"]
    some, languages = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.F.lit(True))
    sizes = Counter(r.lang for r in some.collect())
    assert languages == sorted(TABLE) and sizes["日"] == sum(r[2] == "日" for r in rows)
    assert all(60 <= sizes[x] <= 140 for x in ("en", "fr"))
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.F.lit(True))
    assert langid.quotas(4) == (20_000, 10_000) and 7 * langid.quotas(5_000)[1] * 5_000 <= langid.ENTRIES


def test_many_languages_and_a_long_text(spark):
    rows = [(i, f"w{chr(97 + i // 26)}{chr(97 + i % 26)} " * 5, f"l{i:03}") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.F.lit(True))
    assert model.predict([r[1] for r in rows])[0] == [r[2] for r in rows]
    long = "waa " * 4_000_000 + "\n" + "wab " * 3_000_000
    names, scores = model.predict([long, "wab wab", "x" * 2_000_000])
    assert names[:2] == ["l000", "l001"] and 0 <= min(scores) and max(scores) <= 1
