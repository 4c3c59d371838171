"""Language identification: word-first backoff.

A word known from training counts by its log frequency in each language. An unseen
word falls back to its character n-grams, the longest first: if any n-gram of a
length is known, the mean of their log frequencies counts, else the next shorter
length is tried. Words are runs of letters of the lower-cased text; all texts are
scored whole, with their words hashed as arrays.

Training reads a bounded sample: ``TRAIN_DOCS`` documents shared out evenly among the
languages, chosen by a hash. Counting is distributed. Each language keeps its own
``TOP_WORDS`` commonest words and ``TOP_GRAMS`` n-grams of each length, ties by their
hash, so a rare language has as many as a common one. Beyond ``ENTRIES`` in all, 16 bytes
each, the quotas shrink evenly; that bounds what reaches the driver and what is broadcast.
More than ``LANGUAGES`` languages raise an error.

A text that is null or has no letter is ``und`` with score 0, as is every text
where nothing was learned: with an empty table, or no labels. Ties go to the smaller
language name. Repeated rows give equal rows, and further columns, whatever their names,
are passed over. Very long texts are scored in parts that end at white space, so only a
single word of many megabytes needs memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.bpe import LETTER, classes
from quarryline.llm.common import U64, WordHasher, mix, stage, word_bounds

TRAIN_DOCS, TOP_WORDS, TOP_GRAMS = 20_000, 20_000, 10_000
#: Entries of the model, (word or n-gram, language), that all languages share.
ENTRIES = 1_000_000
GRAMS = (5, 4, 3, 2, 1)
#: Languages beyond which training raises an error.
LANGUAGES = 10_000
UNKNOWN = "und"
#: Characters of text scored at a time, and texts.
PART, ROWS = 1 << 19, 500
SEED = 31
_BREAK = re.compile(r"\s")


class CharHasher(WordHasher):
    """As ``WordHasher``, over code points."""

    def __init__(self, seed: int):
        super().__init__(seed)
        self.values = mix(np.arange(0x110000, dtype=np.uint64) + U64(seed << 32 | 1))


@cache
def _hasher() -> CharHasher:
    return CharHasher(SEED)


def _pieces(text: str) -> Iterator[str]:
    """The text in parts of about ``PART`` characters that end at white space."""
    at = 0
    while len(text) - at > 2 * PART and (cut := _BREAK.search(text, at + PART)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the texts, code points, offsets) of pieces of the lower-cased texts."""
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text or ""):
            held.append(np.frombuffer(piece.lower().encode("utf-32-le"), np.uint32))
            rows.append(i)
            size += len(held[-1])
            if size >= PART:
                yield np.array(rows), np.concatenate(held), np.concatenate(([0], np.cumsum([len(c) for c in held])))
                held, rows, size = [], [], 0
    if held:
        yield np.array(rows), np.concatenate(held), np.concatenate(([0], np.cumsum([len(c) for c in held])))


def words(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_bounds(classes()[code] == LETTER, offsets)


def gram_ranges(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, start) of all n-grams inside words."""
    count = np.maximum(ends - starts - n + 1, 0)
    which = np.repeat(np.arange(len(starts)), count)
    before = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count
    return which, starts[which] + np.arange(len(which)) - before[which]


# ---------------------------------------------------------------- training


def training_counts(docs: DataFrame) -> DataFrame:
    """(n, lang, h, c): n is 0 for whole words, else the n-gram's length. Counts are pre-aggregated per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lang = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for rows, code, offsets in parts(batch.column(1).to_pylist()):
                starts, ends, first = words(code, offsets)
                of = lang[np.repeat(rows, np.diff(first))]
                for n in (0, *GRAMS):
                    if n:
                        which, a = gram_ranges(starts, ends, n)
                        h, k = _hasher()(code, a, a + n), of[which]
                    else:
                        h, k = _hasher()(code, starts, ends), of
                    for v in np.unique(k).tolist():
                        hashes, counts = np.unique(h[k == v], return_counts=True)
                        m = len(hashes)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, n, np.int32)), pa.array([str(names[v])] * m, pa.string()), pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))],
                            ["n", "lang", "h", "c"],
                        )

    made = docs.select("lang", "text").mapInArrow(run, "n int, lang string, h long, c long")
    return made.groupBy("n", "lang", "h").agg(F.sum("c").alias("c"))


def quotas(languages: int) -> tuple[int, int]:
    """Words, and n-grams of each length, that each language keeps."""
    share = ENTRIES // (max(1, languages) * (2 + len(GRAMS)))
    return min(TOP_WORDS, 2 * share), min(TOP_GRAMS, share)


def vocabulary(counts: DataFrame, n_words: int, n_grams: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``counts`` with the largest ``c`` per (n, lang), ties by ``h``; and their
    sums, (n, lang, total, edge, used).

    How many rows have each count is aggregated first: at most some thousand numbers a
    language, over which running sums give the count ``edge`` that no longer fits whole.
    Only the rows tied there are ranked.
    """
    limit = F.when(F.col("n") == 0, n_words).otherwise(n_grams)
    of = Window.partitionBy("n", "lang")
    bins = counts.groupBy("n", "lang", "c").agg(F.count(F.lit(1)).alias("k"))
    bins = bins.withColumn("upto", F.sum("k").over(of.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)))
    sums = bins.groupBy("n", "lang").agg(
        F.sum(F.col("c") * F.col("k")).alias("total"), F.max(F.when(F.col("upto") > limit, F.col("c"))).alias("edge"),
        F.coalesce(F.max(F.when(F.col("upto") <= limit, F.col("upto"))), F.lit(0)).alias("used"),
    )
    sums = stage(sums)  # a row per language and length
    rows = counts.join(F.broadcast(sums.select("n", "lang", "edge", "used")), ["n", "lang"])
    above = rows.filter(F.col("edge").isNull() | (F.col("c") > F.col("edge")))
    tied = rows.filter(F.col("c") == F.col("edge")).withColumn("r", F.row_number().over(of.orderBy("h"))).filter(F.col("r") <= limit - F.col("used"))
    columns = ["n", "lang", "h", "c"]
    return above.select(columns).union(tied.select(columns)), sums


class Table:
    """The words, or n-grams of one length: sorted hashes, each with a range of (language, gain).

    A language's log frequency is its ``base``, that of an unseen entry, plus the gain.
    """

    def __init__(self, h: np.ndarray, lang: np.ndarray, c: np.ndarray, totals: np.ndarray, smooth: float):
        order = np.lexsort((lang, h))
        self.hashes, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.lang = lang[order].astype(np.int32)
        self.gain = np.log((c[order] + smooth) / smooth).astype(np.float32)
        self.base = np.log(smooth / (totals + smooth * max(1, len(self.hashes))))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether they are known)."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def sums(self, at: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, languages: int) -> np.ndarray:
        """Per row the weighted gains of the entries at ``at``, for each language."""
        size = np.diff(self.first)[at]
        each = np.repeat(np.arange(len(at)), size)
        entry = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(each)) if len(at) else each
        out = np.bincount(row[each] * languages + self.lang[entry], weight[each] * self.gain[entry], rows * languages)
        return out.reshape(rows, languages)


class Model:
    """Languages in order, and a table per length (0: words)."""

    def __init__(self, languages: list[str], tables: dict[int, Table]):
        self.languages, self.tables = languages, tables

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the sum of its words' log frequencies for each language, and its number of words."""
        k = len(self.languages)
        total, n_words = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for rows, code, offsets in parts(texts):
            starts, ends, first = words(code, offsets)
            np.add.at(n_words, rows, np.diff(first))
            if not len(starts) or not k:
                continue
            lo = int(rows[0])
            height = int(rows[-1]) - lo + 1
            of = np.repeat(rows, np.diff(first)) - lo
            sums = total[lo : lo + height]
            table = self.tables[0]
            at, known = table.look_up(_hasher()(code, starts, ends))
            sums += table.sums(at[known], of[known], np.ones(int(known.sum())), height, k)
            sums += np.bincount(of[known], minlength=height)[:, None] * table.base
            rest = np.flatnonzero(~known)
            for n in GRAMS:
                if not len(rest):
                    break
                table = self.tables[n]
                which, a = gram_ranges(starts[rest], ends[rest], n)
                at, known = table.look_up(_hasher()(code, a, a + n))
                which, at = which[known], at[known]
                hits = np.bincount(which, minlength=len(rest))
                sums += table.sums(at, of[rest][which], 1 / hits[which], height, k)
                sums += np.bincount(of[rest[hits > 0]], minlength=height)[:, None] * table.base
                rest = rest[hits == 0]
        return total, n_words

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        for lo in range(0, len(texts), ROWS):
            total, n = self.totals(texts[lo : lo + ROWS])
            if not self.languages:
                names += [UNKNOWN] * len(n)
                scores += [0.0] * len(n)
                continue
            # Confidence grows with the root of the number of words: neighbours depend on each other.
            x = total / np.sqrt(np.maximum(n, 1))[:, None]
            x = np.exp(x - x.max(axis=1, keepdims=True))
            best = x.argmax(axis=1)
            p = x.max(axis=1) / x.sum(axis=1)
            names += [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)]
            scores += np.where(n > 0, p, 0.0).tolist()
        return names, scores


def training_sample(docs: DataFrame, labelled: Column) -> tuple[DataFrame, list[str]]:
    """(lang, text) of about ``TRAIN_DOCS`` rows in all where ``labelled`` holds, as many of each language as there are; and the languages."""
    rows = docs.filter(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    each = TRAIN_DOCS // max(1, len(sizes)) or 1
    if any(r["count"] > each for r in sizes):
        table = [(r.lang, min(1 << 20, max(1, (each << 20) // r["count"]))) for r in sizes]
        shares = F.broadcast(docs.sparkSession.createDataFrame(table, "lang string, share long"))
        rows = rows.join(shares, "lang").filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 20)) < F.col("share"))
    return rows.select("lang", "text"), sorted(r.lang for r in sizes)


def train(docs: DataFrame, labelled: Column, smooth: float = 0.5) -> Model:
    """The model from the rows of ``docs`` (doc_id, text, lang) where ``labelled`` holds and lang is not null."""
    rows, languages = training_sample(docs, labelled)
    counts = stage(training_counts(rows))
    chosen, sums = vocabulary(counts, *quotas(len(languages)))
    totals = {n: np.zeros(len(languages)) for n in (0, *GRAMS)}
    place = {x: i for i, x in enumerate(languages)}
    for r in sums.select("n", "lang", "total").collect():
        totals[r.n][place[r.lang]] = r.total
    kept = chosen.toArrow()
    n, h, c = (kept.column(name).to_numpy() for name in ("n", "h", "c"))
    names = kept.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([place[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(n) else np.zeros(0, np.int64)
    return Model(languages, {k: Table(h[n == k].view(U64), lang[n == k], c[n == k], totals[k], smooth) for k in totals})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def language_predictions(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learned from the rows that are not held out."""
    out = held_out(modulus, remainder)
    found = identify(docs, train(docs.select("doc_id", "text", "lang"), ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
