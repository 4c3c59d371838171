"""Substring dedup by level-wise doubling.

A window is ``window`` consecutive words of one document. Every word of a window
whose word sequence also starts anywhere else is removed. Windows are judged on
the input.

Levels halve down from the window's length (35: 9, 18, 35), and each level's hash
of a run of words is made from two hashes of half the length. At a level below the
last, a window stands for itself by the smallest hash among its runs of that
length; equal windows choose equal runs. A run that occurs once drops all windows
that chose it. Windows whose run repeats are extended to the next, twice as long
level, until the last, where each window left is compared as a whole, or until
none is left. No false positive survives, since the last level decides on 128
bits, and no repeat is lost, since equal windows take equal decisions.

The first level covers all documents with about 7 % of the positions. Counts are
pre-aggregated; the join back to the documents is a semi-join that splits under
skew. What survives is packed: one row holds the word hashes of all regions of a
few hundred documents. Later levels send each distinct hash of a row once, to a
bucket of the hash range, and get one bit back, so a passage that a third of all
documents share arrives once per packed row, not once per document. The hashes are mixed
again first, since smallest ones would crowd the lowest buckets. A table that a level
wrote goes once the next one is written.

Words are runs of bytes other than space and \\x09-\\x0D. Null and empty texts have
no words, and texts below ``window`` words no windows. Rows that repeat id and
text are further occurrences of each other. An empty table gives no rows. Further columns,
whatever their names, are kept by ``remove_repeats`` and passed over by
``removal_digests``. A very long text takes memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import U64, WordHasher, chunks, discard, doc_key, free_shuffles, mix, stage, window_argmin, word_bounds

WINDOW = 35
#: The first level's length lies below this.
SEED_BELOW = 16
#: Hashes that one bucket of a later level is meant to hold.
BUCKET = 1 << 20
SEED = 23

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_K = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


@cache
def _hasher() -> WordHasher:
    return WordHasher(SEED)


def levels(window: int = WINDOW) -> list[int]:
    out = [window]
    while out[-1] >= SEED_BELOW or len(out) == 1:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def run_hashes(words: np.ndarray, n: int, k: U64 = _K[0]) -> np.ndarray:
    """Hashes of all runs of ``n`` words, each made from those of its two halves."""
    if n == 1:
        return words
    half = -(-n // 2)
    part = run_hashes(words, half, k)
    m = max(0, len(words) - n + 1)
    with np.errstate(over="ignore"):
        return mix(part[:m] * k + part[n - half : n - half + m] + U64(n))


def _inside(first: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that lie within one text or region; ``first`` are the borders."""
    starts = np.arange(max(0, int(first[-1]) - window + 1))
    end = first[np.minimum(np.searchsorted(first, starts, "right"), len(first) - 1)]
    return starts[starts + window <= end]


def chosen_runs(words: np.ndarray, starts: np.ndarray, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of ``n`` words, and for each window the run that stands for it."""
    hashes = run_hashes(words, n)
    if len(starts) == 0:
        return hashes, starts
    return hashes, window_argmin(hashes, window - n + 1)[starts]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(_WORD[data], offsets)
    return _hasher()(data, starts, ends), first


# ---------------------------------------------------------------- first level


def _seeds(docs: DataFrame, window: int, n: int) -> DataFrame:
    """(h, k1, k2, pos): the runs that stand for some window of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            for lo, _, data, offsets in chunks(batch.column(2)):
                words, first = _words(data, offsets)
                hashes, at = chosen_runs(words, _inside(first, window), window, n)
                at = np.unique(at)
                text = np.searchsorted(first, at, "right") - 1
                arrays = [hashes[at].view(np.int64), k1[lo + text], k2[lo + text], (at - first[text]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["h", "k1", "k2", "pos"])

    return docs.select(*doc_key(), F.col("text")).filter("text is not null").mapInArrow(run, "h long, k1 long, k2 long, pos int")


def _regions(docs: DataFrame, alive: DataFrame, window: int, n: int) -> DataFrame:
    """Packed rows of the regions whose windows survive the first level."""
    rows = docs.select(*doc_key(), F.col("text")).filter("text is not null").join(alive, ["k1", "k2"]).select("k1", "k2", "text", "seeds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            seeds = batch.column(3)
            for lo, hi, data, offsets in chunks(batch.column(2)):
                words, first = _words(data, offsets)
                starts = _inside(first, window)
                if len(starts) == 0:
                    continue
                _, at = chosen_runs(words, starts, window, n)
                part = seeds.slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths()))
                live = np.zeros(len(words), bool)
                live[first[of] + np.asarray(part.flatten())] = True
                packed = _pack(words, first, starts[live[at]], window, k1[lo:hi], k2[lo:hi], np.zeros(hi - lo, np.int32))
                if packed is not None:
                    yield packed

    return rows.mapInArrow(run, REGIONS)


REGIONS = "block long, n long, k1 binary, k2 binary, start binary, size binary, words binary"


def _pack(words, first, starts, window, k1, k2, shift) -> pa.RecordBatch | None:
    """One row with the words below the windows at ``starts``; ``first`` are the borders of
    the texts or regions, whose keys and places are ``k1``, ``k2`` and ``shift``."""
    if len(starts) == 0:
        return None
    cut = np.flatnonzero(np.diff(starts) > 1)
    a = starts[np.concatenate(([0], cut + 1))]
    b = starts[np.concatenate((cut, [len(starts) - 1]))] + window
    # Windows of two neighbouring texts never touch: the last window of one ends before the next begins.
    own = np.searchsorted(first, a, "right") - 1
    size = (b - a).astype(np.int64)
    index = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
    place = (a - first[own] + shift[own]).astype(np.int32)
    values = [k1[own], k2[own], place, size.astype(np.int32), words[index]]
    block = uuid.uuid4().int & ((1 << 63) - 1)
    arrays = [pa.array([block], pa.int64()), pa.array([len(index)], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in values]]
    return pa.RecordBatch.from_arrays(arrays, ["block", "n", "k1", "k2", "start", "size", "words"])


def _unpack(batch: pa.RecordBatch, row: int):
    k1, k2, start, size, words = (np.frombuffer(batch.column(name)[row].as_py(), kind) for name, kind in (("k1", np.int64), ("k2", np.int64), ("start", np.int32), ("size", np.int32), ("words", U64)))
    return k1, k2, start, np.concatenate(([0], np.cumsum(size, dtype=np.int64))), words


# ---------------------------------------------------------------- later levels


def _candidates(words: np.ndarray, first: np.ndarray, window: int, n: int):
    """(starts of the windows, number of each one's hash, the distinct hashes as two
    columns in ascending order, whether each repeats among the places of these regions)."""
    starts = _inside(first, window)
    hashes, at = chosen_runs(words, starts, window, n)
    places, which = np.unique(at, return_inverse=True)
    h = mix(hashes[places] ^ _K[1])  # the smallest of several hashes is small: mixed again, they spread evenly
    g = run_hashes(words, n, _K[1])[places]
    order = np.lexsort((g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    kept = order[new]
    return starts, number[which], h[kept], g[kept], np.bincount(number, minlength=len(kept)) > 1


def _ranges(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the hash range begins among the ascending hashes."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], U64)
    return np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))


def _repeats(regions: DataFrame, window: int, n: int, buckets: int) -> DataFrame:
    """(block, bits): for each packed row one bit per distinct hash, in ascending order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                *_, first, words = _unpack(batch, row)
                _, _, h, g, twice = _candidates(words, first, window, n)
                edges = _ranges(h, buckets)
                full = np.flatnonzero(np.diff(edges))
                cuts = [(b, slice(edges[b], edges[b + 1])) for b in full.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in cuts], pa.int32()), pa.array([batch.column("block")[row].as_py()] * len(cuts), pa.int64()),
                        *[pa.array([x[s].tobytes() for _, s in cuts], pa.binary()) for x in (h, g, twice)],
                    ],
                    ["bucket", "block", "h", "g", "twice"],
                )

    def decide(table: pa.Table) -> pa.Table:
        parts = [[np.frombuffer(x, kind) for x in table.column(name).to_pylist()] for name, kind in (("h", U64), ("g", U64), ("twice", bool))]
        h, g, twice = (np.concatenate(p) for p in parts)
        order = np.lexsort((g, h))
        same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
        hit = twice.copy()
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        ends = np.cumsum([len(x) for x in parts[0]])
        bits = [x.tobytes() for x in np.split(hit, ends[:-1])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(np.frombuffer(b, bool)).tobytes() for b in bits], pa.binary()), "n": pa.array([len(b) for b in bits], pa.int32())})

    sent = regions.mapInArrow(emit, "bucket int, block long, h binary, g binary, twice binary")
    back = sent.groupBy("bucket").applyInArrow(decide, "block long, bucket int, bits binary, n int")
    return back.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))).alias("replies"))


def _alive(batch: pa.RecordBatch, row: int, window: int, n: int):
    """The row's arrays, and the starts of the windows whose hash repeats."""
    k1, k2, start, first, words = _unpack(batch, row)
    starts, number, *_ = _candidates(words, first, window, n)
    replies = batch.column("replies")[row].as_py()
    bits = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in replies])
    return k1, k2, start, first, words, starts[bits[number]]


def _narrow(regions: DataFrame, replies: DataFrame, window: int, n: int) -> DataFrame:
    """The regions that are left after a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                k1, k2, start, first, words, starts = _alive(batch, row, window, n)
                packed = _pack(words, first, starts, window, k1, k2, start)
                if packed is not None:
                    yield packed

    return regions.join(replies, "block").mapInArrow(run, REGIONS)


def _spans(regions: DataFrame, replies: DataFrame, window: int) -> DataFrame:
    """(k1, k2, spans): the removed runs of words as packed int32 pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                k1, k2, start, first, _, starts = _alive(batch, row, window, window)
                change = np.zeros(int(first[-1]) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + window, -1)
                hit = np.cumsum(change)[:-1] > 0
                found: dict[tuple[int, int], list[np.ndarray]] = {}
                for r in np.unique(np.searchsorted(first, starts, "right") - 1).tolist():
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit[first[r] : first[r + 1]], [False]))))
                    found.setdefault((int(k1[r]), int(k2[r])), []).append((edges + start[r]).astype(np.int32))
                keys = list(found)
                arrays = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([np.concatenate(v).tobytes() for v in found.values()], pa.binary())], ["k1", "k2", "spans"])

    made = regions.join(replies, "block").mapInArrow(run, "k1 long, k2 long, spans binary")
    # Rows of equal id and text have equal spans; a packed row holds whole documents, so the longest list is complete.
    return made.groupBy("k1", "k2").agg(F.max_by("spans", F.length("spans")).alias("spans"))


def removed_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, spans) for the documents with repeated windows; the keys are ``doc_key()``."""
    spark = docs.sparkSession
    steps = levels(window)
    seeds = stage(_seeds(docs, window, steps[0]))
    # Written first: joined as an aggregate it would share the join's partitioning, and a hot run's rows could not be split.
    repeated = stage(seeds.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"))
    alive = seeds.join(repeated, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_list("pos").alias("seeds"))
    regions = stage(_regions(docs, alive, window, steps[0]))
    discard(seeds, repeated)
    del seeds, repeated, alive
    for n in steps[1:]:
        free_shuffles(spark)
        total = regions.agg(F.sum("n")).first()[0]
        if not total:
            break
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
        replies = _repeats(regions, window, n, buckets)
        if n == window:
            spans = stage(_spans(regions, replies, window))
            discard(regions)
            return spans
        narrowed = stage(_narrow(regions, replies, window, n))
        discard(regions)
        regions = narrowed
    return spark.createDataFrame([], "k1 long, k2 long, spans binary")


def _kept(text: bytes, spans: bytes | None) -> tuple[int, int, bytes]:
    words = text.split()
    n = len(words)
    if not spans:
        return n, 0, b" ".join(words)
    runs = np.frombuffer(spans, np.int32).reshape(-1, 2)
    keep, at = [], 0
    for a, b in runs[np.argsort(runs[:, 0], kind="stable")].tolist():
        keep += words[at:a]
        at = max(at, b)
    keep += words[at:]
    return n, n - len(keep), b" ".join(keep)


def _joined(docs: DataFrame, window: int, columns) -> DataFrame:
    spans = removed_spans(docs, window)
    free_shuffles(docs.sparkSession)
    return docs.select(*doc_key(), *columns).join(spans, ["k1", "k2"], "left").drop("k1", "k2")


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_kept((t.as_py() or "").encode(), s.as_py()) for t, s in zip(batch.column(1), batch.column(2), strict=True)]
            digests = [hashlib.sha256(k).hexdigest() for _, _, k in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = _joined(docs, window, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")])
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words removed; texts without any stay as they are."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([t if not s else _kept(t.encode(), s)[2].decode() for t, s in zip(texts, spans, strict=True)])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _joined(docs, window, [row])
    return rows.select(*[cut("row.text", "spans").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns])


SQL = f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (select r, i, sha256(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) as h from d, unnest(range(1, len(w) - {WINDOW - 2})) t(i)),
rep as (select h from win group by 1 having count(*) > 1),
hit as (select distinct r, p from (select r, i from win join rep using (h)), unnest(range(i, i + {WINDOW})) t(p)),
word as (select r, p, w[p] as x from d, unnest(range(1, len(w) + 1)) t(p)),
kept as (select r, count(*) as n, string_agg(x, ' ' order by p) as s from word anti join hit using (r, p) group by 1)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256 from d left join kept using (r)"""
