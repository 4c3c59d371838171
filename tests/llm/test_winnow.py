import hashlib
import random
import re

from quarryline.llm import winnow

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(low)


def brute(docs, items, window=10):
    out = []
    targets = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            targets.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n, table in targets.items():
            for k in range(len(w) - n + 1):
                if (own := table.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "the", "Of", "x1", "日本"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, text(rng.choice([0, 1, 3, 9, 10, 11, 25]) + 0)) for k in range(12)] + [(3, text(12)), (None, text(14)), (99, None), (7, "!!!")]
    docs = [(1, None), (2, ""), (3, "..."), (4, text(400))]
    for k in range(30):
        parts = [text(rng.randrange(8)), rng.choice(items)[1] or "", text(rng.randrange(8)), rng.choice(items)[1] or ""]
        docs.append((5 + k % 25, ", ".join(parts)))
    return docs, items


def check(spark, docs, items, **options):
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = winnow.contamination_digests(a, b, **options).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs, items)


def test_against_brute_force(spark):
    for seed in range(2):
        check(spark, *corpus(seed))
    docs, items = corpus(7)
    check(spark, docs, [x for x in items if len(words(x[1])) >= 10])


def test_slices_and_empty_sides(spark, monkeypatch):
    docs, items = corpus(3)
    made = []
    init = winnow.Index.__init__
    monkeypatch.setattr(winnow.Index, "__init__", lambda self, some, *options: made.append(sum(len((t or "").encode()) for _, t in some)) or init(self, some, *options))
    check(spark, docs, items, limit=60)
    assert len(made) > 5 and max(made) < sum(made)  # several slices, none with all
    check(spark, docs, [])
    check(spark, docs, [], limit=1)
    check(spark, [], items, limit=60)


def test_decontaminate_keeps_columns(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "x " + item + " y", "a", 5), (2, "clean words", "b", 6), (3, None, "c", None)], "doc_id long, text string, hit_items string, n_words int")
    benchmark = spark.createDataFrame([(1, item), (2, item + " twelve thirteen")], "item_id long, text string")
    for limit in (winnow.SLICE_BYTES, 30):
        kept = winnow.decontaminate(docs, benchmark, limit=limit)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(2, "clean words", "b", 6), (3, None, "c", None)]


def test_a_long_text(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "filler words here " * 1_100_000 + item), (2, "x" * 4_000_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in winnow.contamination_digests(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert (found[1].n_words, found[1].n_hit, found[1].n_items) == (3_300_011, 11, 1) and not found[2].contaminated
