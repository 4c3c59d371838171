"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and all non-ASCII bytes, A-Z lowered.
Both sides keep the leftmost minimum hash of every ``window - gram + 1``
neighbouring grams, so any shared run of ``window`` words shares a kept gram. A
kept gram of a document that is also a kept gram of the benchmark is extended to
all windows around it, and these are compared with the benchmark's windows, first
by hash, then word by word. An item of fewer words than a window is one window
of its own length; winnowing promises nothing so short, so such lengths are
looked up at every position.

The benchmark is the broadcast side. Its size is measured first. Up to ``SLICE_BYTES``
one map over the documents finds all, and nothing is shuffled. A larger one goes in
slices, one at a time, so that neither the driver nor a worker ever holds more than one:
each is a pass over the documents that writes what it hits, and the sum of these joins
the documents in the end.

Null and empty texts have no words and no hits; a null item id counts as ''.
Repeated documents give repeated rows, repeated items count once. Without a
benchmark nothing is hit, without documents there are no rows. All further columns of the
documents are kept, whatever their names, but for those named as a result. A very long
text takes memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import U64, WordHasher, chunks, discard, mix, stage, window_argmin, word_bounds

WINDOW, GRAM = 10, 5
#: Benchmark text that one broadcast index may hold.
SLICE_BYTES = 16 << 20
SEED = 11

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


@cache
def _hasher() -> WordHasher:
    return WordHasher(SEED)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the words before each text."""
    low = _LOWER[data]
    starts, ends, first = word_bounds(_WORD[low], offsets)
    return _hasher()(low, starts, ends), first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, borders between texts not respected."""
    out = words[: max(0, len(words) - n + 1)]
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = mix(out * U64(0x9E3779B97F4A7C15) + words[j : j + len(out)])
    return out


def _inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """True where a run of ``n`` words lies in one text."""
    out = np.ones(max(0, total - n + 1), bool)
    for e in first[1:-1].tolist():
        out[max(0, e - n + 1) : e] = False
    return out


class Index:
    """The windows of a slice of the benchmark, by their length; and the kept grams."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        self.owner = np.array([number[i] for i, _ in items], np.int64)
        runs: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        kept = []
        for (_, text), own in zip(items, self.owner, strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            words, _ = words_of(data, np.array([0, len(data)]))
            n = min(len(words), window)
            if n:
                rows = np.lib.stride_tricks.sliding_window_view(words, n)
                runs.setdefault(n, []).append(rows)
                owners.setdefault(n, []).append(np.full(len(rows), own))
            if n == window:
                grams = gram_hashes(words, gram)
                kept.append(grams[np.unique(window_argmin(grams, window - gram + 1))])
        self.kept = np.unique(np.concatenate(kept)) if kept else np.zeros(0, U64)
        self.tables = {n: self._table(np.concatenate(runs[n]), np.concatenate(owners[n])) for n in runs}

    @staticmethod
    def _table(rows: np.ndarray, owners: np.ndarray) -> tuple:
        """Distinct windows by hash: hashes, their words, and the owners of each as ranges."""
        n = rows.shape[1]
        hashes = gram_hashes(rows.reshape(-1), n)[::n] if n > 1 else rows[:, 0]
        order = np.lexsort((owners, hashes))
        hashes, rows, owners = hashes[order], rows[order], owners[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        return hashes[first], rows[first], np.concatenate((first, [len(hashes)])), owners

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, window numbers) for each length of window."""
        for n in self.tables:
            if n < self.window:
                at = np.flatnonzero(_inside(first, n, len(words)))
                found = gram_hashes(words, n)[at]
            else:
                at = self._around(words, first)
                rows = np.lib.stride_tricks.sliding_window_view(words, n)[at] if len(at) else np.zeros((0, n), U64)
                found = gram_hashes(rows.reshape(-1), n)[::n]
            hashes, reps, _, _ = self.tables[n]
            k = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            same = hashes[k] == found
            at, k = at[same], k[same]
            if len(at):
                equal = (np.lib.stride_tricks.sliding_window_view(words, n)[at] == reps[k]).all(axis=1)
                at, k = at[equal], k[equal]
            yield n, at, k

    def _around(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the windows that contain a kept gram shared with the benchmark."""
        grams = gram_hashes(words, self.gram)
        if len(grams) == 0 or len(words) < self.window or len(self.kept) == 0:
            return np.zeros(0, np.int64)
        # Grams across a border would only add positions, so they need no care here.
        chosen = np.unique(window_argmin(grams, min(self.window - self.gram + 1, len(grams))))
        k = np.minimum(np.searchsorted(self.kept, grams[chosen]), len(self.kept) - 1)
        chosen = chosen[self.kept[k] == grams[chosen]]
        starts = np.unique((chosen[:, None] - np.arange(self.window - self.gram + 1)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts + self.window <= len(words))]
        text = np.searchsorted(first, starts, "right")
        return starts[starts + self.window <= first[np.minimum(text, len(first) - 1)]]


def _scan(index: Index, texts: pa.Array) -> tuple[list[int], list[bytes], list[list[str]]]:
    """Per text: number of words, hit runs as packed int32 pairs, ids of the items found."""
    sizes: list[int] = []
    spans: list[bytes] = []
    items: list[list[str]] = []
    for lo, hi, data, offsets in chunks(texts):
        words, first = words_of(data, offsets)
        change = np.zeros(len(words) + 1, np.int64)
        per_text: dict[int, set[int]] = {}
        for n, at, k in index.hits(words, first):
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            if len(at):
                text = np.searchsorted(first, at, "right") - 1
                _, _, ranges, owners = index.tables[n]
                for t, w in np.unique(np.stack((text, k), axis=1), axis=0).tolist():
                    per_text.setdefault(t, set()).update(owners[ranges[w] : ranges[w + 1]].tolist())
        hit = np.cumsum(change)[:-1] > 0 if len(words) else np.zeros(0, bool)
        sizes += np.diff(first).tolist()
        for t in range(hi - lo):
            if t in per_text:
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit[first[t] : first[t + 1]], [False]))))
                spans.append(edges.astype(np.int32).tobytes())
                items.append([index.ids[x] for x in sorted(per_text[t])])
            else:
                spans.append(b"")
                items.append([])
    return sizes, spans, items


def _merge(parts: list[bytes]) -> bytes:
    """The union of lists of runs."""
    parts = [x for x in parts if x]
    if len(parts) < 2:
        return parts[0] if parts else b""
    runs = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in parts])
    out: list[list[int]] = []
    for s, e in runs[np.argsort(runs[:, 0], kind="stable")].tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return np.array(out, np.int32).tobytes()


def slices(benchmark: DataFrame, limit: int = SLICE_BYTES) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many parts the benchmark has whose text keeps to about ``limit`` bytes, and their (id, text)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t"))
    rows = rows.filter("t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // limit) or 1
    parts = (rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n))
    return n, ([(r.i, r.t) for r in part.collect()] for part in parts)


STATE = {"n_words": T.LongType(), "hit_spans": T.BinaryType(), "hit_items": T.ArrayType(T.StringType())}


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(x, STATE[x]) for x in names]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = SLICE_BYTES, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs``, by default all but those of the same names, with n_words,
    hit_spans (packed int32 pairs of word positions) and hit_items."""
    kept = [c for c in docs.columns if c.lower() not in STATE] if columns is None else columns
    n, parts = slices(benchmark, limit)
    if n > 1:
        return _in_slices(docs, parts, kept, window, gram)
    shared = docs.sparkSession.sparkContext.broadcast(Index(next(parts), window, gram))
    rows = docs.select(F.col("text").alias("_scanned"), *[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, found = _scan(shared.value, batch.column(0))
            made = [*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(spans, pa.binary()), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(made, names=[*batch.schema.names[1:], *STATE])

    base = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[1:]]
    return rows.mapInArrow(run, T.StructType(base + _fields(*STATE)))


def _in_slices(docs: DataFrame, parts: Iterator[list[tuple[str, str]]], kept: list[str], window: int, gram: int) -> DataFrame:
    """As ``contamination``, one slice of the benchmark after the other."""
    by_text = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(SEED), "text").alias("k2")]  # what is hit depends on the text alone
    texts = docs.filter("text is not null").select(*by_text, "text")
    keys = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
    hits = []
    for items in parts:
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, window, gram))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, spans, found = _scan(shared.value, batch.column(2))
                made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.binary()), pa.array(found, pa.list_(pa.string()))], ["k1", "k2", "hit_spans", "hit_items"])
                yield made.filter(pa.array([bool(x) for x in spans], pa.bool_()))

        hits.append(stage(texts.mapInArrow(run, T.StructType(keys + _fields("hit_spans", "hit_items")))))
        shared.destroy()  # what it found is written
    found = reduce(DataFrame.union, hits).groupBy("k1", "k2")
    found = stage(found.agg(F.collect_set("hit_spans").alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items")))
    discard(*hits)
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = docs.select(*by_text, F.col("text").alias("_scanned"), row).join(found, ["k1", "k2"], "left").select("_scanned", "hit_spans", "hit_items", "row")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [n for *_, data, offsets in chunks(batch.column(0)) for n in np.diff(words_of(data, offsets)[1]).tolist()]
            spans = [_merge(x or []) for x in batch.column(1).to_pylist()]
            items = [x or [] for x in batch.column(2).to_pylist()]
            made = [batch.column(3), pa.array(sizes, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(made, names=["row", *STATE])

    made = rows.mapInArrow(finish, T.StructType([T.StructField("row", rows.schema["row"].dataType), *_fields(*STATE)]))
    return made.select(*[F.col(f"row.`{c}`") for c in kept], *STATE)


def contamination_digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document with the counts, the digest of the items and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            hit = [int(r[1::2].sum() - r[::2].sum()) for r in runs]
            items = batch.column(3).to_pylist()
            digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    found = contamination(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, columns=["doc_id"], **options)
    return found.mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any window of the benchmark, columns unchanged."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return contamination(rows, benchmark, columns=["row"], **options).filter(F.length("hit_spans") == 0).select("row.*")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select coalesce(item_id::varchar, '') as item, {_WORDS} as w from benchmark),
bw as (select distinct item, least(len(w), {WINDOW}) as n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') as win
  from b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) t(i) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as win from d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
hits as (select r, i, n, item from dw join bw using (n, win)),
words as (select r, count(distinct p) as n_hit from hits, unnest(range(i, i + n)) t(p) group by 1),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct r, item from hits) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)"""
