"""SimHash near-dedup by a generalised pigeonhole search.

Fingerprints have 64 bits. For a radius r and m groups of bits with thresholds
t_i, any two fingerprints within r lie within t_i in some group, provided that the
t_i sum to r - m + 1 (-1 leaves a group out). Correlated bits, by a bounded
sample, go into one group, so the skew collects in few groups, and dynamic
programming gives these the smaller thresholds: it minimises the estimated
number of rows sent and pairs compared, over the groups and for several m, for
the number of distinct fingerprints at hand. More data moves the optimum to
fewer, wider groups, so the buckets stay small.

Each distinct fingerprint goes into the search once, whatever the number of its
documents. It is sent under its key in each group and, as a visitor, under the
keys within the threshold, packed by ranges of keys. A key's rows are compared as
arrays, and only a spanning star of the links found is returned, never all pairs.
Ranges of far more rows than meant are taken apart by single keys. Pairs are counted per
key, in whatever range, as rows at home times all rows, since visitors aren't compared with
each other: the rows of keys with more than ``HOT`` squared are handed on instead of
compared, and first meet one row of the key's commonest fingerprint. Those that link to
it are connected, so only pairs with one of the others are left. If these are many and no
fingerprint is hot itself, the key's rows are dealt again, ``DEALS`` times at most, by
further groups of the bits left, in which two fingerprints within the radius agree on
one group. What is left meets all the key's rows in blocks, so that every pair is
compared, whatever the rows have in common.

``near_duplicates`` links at ``RADIUS`` bits over three-word shingles.
``keep_one`` is for similar texts, a Jaccard similarity of ``SIMILAR`` or more over
their sets of five-word shingles: there each text has ``FINGERPRINTS`` independent
fingerprints, in which a repeated shingle counts once. Each is searched at ``NEAR``
bits, and a pair is a candidate if it and the next one together differ in no more
than ``BOTH`` of 128 bits; a test has the recall. That similarity differs in 19 on average.
Candidates only say which texts to compare: inside each component of them the sets
themselves are compared, and only pairs of that similarity link.

A null text counts as empty: fingerprint zero, linked like any other. Rows with
a null id take part, but name no component; a component of such rows alone has a
null id. Repeated rows give repeated rows in ``near_duplicates``, and one of them
stays in ``keep_one``, which keeps all columns; ``near_duplicates`` passes further columns
over, whatever their names. Empty tables give no rows. A very long text takes memory in
proportion to its length, its hashes are counted in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.joins import lookup_join
from quarryline.llm.common import U64, discard, doc_key, free_shuffles, mix, small_batches, stage
from quarryline.llm.graph import components, local_roots, spanning_stars
from quarryline.llm.xxh import xxh64

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: About how many fingerprints correlations and candidate counts are estimated from.
SAMPLE = 20_000
#: ``keep_one``: words of a shingle, fingerprints, bits of a search and of two fingerprints together.
WIDE, FINGERPRINTS, NEAR, BOTH = 5, 5, 8, 24
#: The similarity that links, as a fraction; shingles of a block of sets that one task compares.
SIMILAR, SET_BLOCK = (4, 5), 1 << 18
#: Cost of a row sent, in pairs compared: about a microsecond against a little over one nanosecond.
ROW_COST = 800.0
#: A key is hot if it compares more pairs, its rows at home times all its rows, than so many squared; its rows
#: are then taken apart by blocks of so many. Rows that one group of keys is meant to hold.
HOT, GROUP = 1 << 14, 1 << 18
#: Pairs from which a key is compared by itself, in tiles, and pairs of a tile.
WIDE_KEY, TILE = 1 << 12, 1 << 15
#: How often a hot key's rows are dealt again: each time copies them ``radius + 1`` times.
DEALS = 2
#: Links that a task holds before it reduces them to spanning stars.
HELD = 1 << 20
#: Bytes of text hashed at a time, and hashes counted at a time.
PART, BLOCK = 1 << 19, 1 << 16

# ---------------------------------------------------------------- fingerprints


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per run of hashes, starting at ``first``, the bits set in over half of it."""
    size = np.diff(np.concatenate((first, [len(hashes)])))
    run = np.repeat(np.arange(len(first)), size)
    counts = np.zeros((len(first), BITS), np.int64)
    for a in range(0, len(hashes), BLOCK):  # 64 bytes a hash, so a long text goes in parts
        bits = np.unpackbits(hashes[a : a + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = run[a : a + BLOCK]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _shingles(texts: list[bytes], shingle: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, hashes, first hash of each text) of the texts that have words, in parts."""
    part: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        joined = b" ".join(text.lower().split())
        if joined:
            part.append((i, joined))
            size += len(joined)
        if size >= PART or (part and i == len(texts) - 1):
            rows = np.array([k for k, _ in part])
            data = np.frombuffer(b"\n".join(x for _, x in part), np.uint8)
            spaces = np.flatnonzero((data == 32) | (data == 10))
            starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(data)]))
            borders = np.flatnonzero(data[spaces] == 10) + 1  # words before each further text
            first = np.concatenate(([0], borders))
            words = np.diff(np.concatenate((first, [len(starts)])))
            n = np.maximum(words - shingle + 1, 1)
            before = np.concatenate(([0], np.cumsum(n)[:-1]))
            at = np.repeat(first - before, n) + np.arange(int(n.sum()))
            last = at + np.repeat(np.minimum(words, shingle), n) - 1
            yield rows, xxh64(data, starts[at], ends[last], seed), before
            part, size = [], 0


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes ascending and once, and where each text starts."""
    run = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(hashes)]))))
    order = np.lexsort((hashes, run))
    hashes, run = hashes[order], run[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (run[1:] != run[:-1])))
    return hashes[new], np.searchsorted(run[new], np.arange(len(first)))


def shingle_sets(texts: list[bytes], shingle: int = WIDE, seed: int = SEED) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    out = [np.zeros(0, U64)] * len(texts)
    for rows, hashes, first in _shingles(texts, shingle, seed):
        for i, own in zip(rows.tolist(), np.split(*_distinct(hashes, first))[1:], strict=True):
            out[i] = own
    return out


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED, count: int = 1, distinct: bool = False) -> np.ndarray:
    """A row of ``count`` fingerprints for each text, zeros for texts without words; those
    after the first come from the same hashes, mixed again. ``distinct``: each shingle of a
    text counts once, and a digest of the set follows as a further column."""
    out = np.zeros((len(texts), count + distinct), U64)
    for rows, hashes, first in _shingles(texts, shingle, seed):
        if distinct:
            hashes, first = _distinct(hashes, first)
        for k in range(count):
            out[rows, k] = _majority(hashes, first)
            hashes = mix(hashes + U64(k + 1))
        if distinct:
            out[rows, count] = mix(np.add.reduceat(hashes, first))
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, count: int = 1, keep: tuple[str, ...] = ("doc_id",), distinct: bool = False) -> DataFrame:
    """(*keep, fp0, fp1, ...): the fingerprints of ``text`` as signed longs; with ``distinct`` the set's digest after them."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    names = [f"fp{k}" for k in range(count)] + ["digest"] * distinct
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{n} long" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                fps = fingerprints([(x.as_py() or "").encode() for x in part.column(len(keep))], shingle, count=count, distinct=distinct)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in fps.T]], [*keep, *names])

    return rows.mapInArrow(run, ", ".join(kinds))


# ---------------------------------------------------------------- plan


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of about equal size; each starts with the bit most correlated with the
    rest and is grown by the bits most correlated with those it has."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits**2).mean(axis=0))
    spread[spread == 0] = 1
    like = np.abs((bits / spread).T @ (bits / spread)) / max(1, len(bits))
    left, out = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(left, key=lambda b: (like[b][left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (like[b][group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def _costs(sample: np.ndarray, group: list[int], n: int, radius: int) -> list[float]:
    """Estimated cost of thresholds -1..radius in a group: rows sent and pairs compared."""
    mask = U64(sum(1 << b for b in group))
    part = sample & mask
    some = part[: min(500, len(part))]
    far = np.bitwise_count(some[:, None] ^ part[None, :]).ravel()
    pairs = max(1, len(some) * (len(part) - 1))
    out = [0.0]
    for t in range(radius + 1):
        ball = sum(comb(len(group), j) for j in range(t + 1))
        share = max((np.count_nonzero(far <= t) - len(some)) / pairs, ball / 2.0 ** len(group))
        out.append(ROW_COST * n * ball + n * n * share / 2)
    return out


def plan(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The groups and thresholds of the least estimated cost for ``n`` fingerprints."""
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, min(2 * radius + 2, 12)):
        groups = bit_groups(sample, m)
        # state: thresholds' sum + m, so that -1 counts 0; keep the cheapest way to each sum
        ways: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            costs = _costs(sample, group, n, radius)
            ways = _add(ways, costs, radius)
        cost, thresholds = ways[radius + 1]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0])
    return best[1]


def _add(ways: dict, costs: list[float], radius: int) -> dict:
    out: dict[int, tuple[float, list[int]]] = {}
    for used, (cost, chosen) in ways.items():
        for t, c in enumerate(costs):
            k = used + t
            if k <= radius + 1 and cost + c < out.get(k, (float("inf"),))[0]:
                out[k] = (cost + c, [*chosen, t - 1])
    return out


# ---------------------------------------------------------------- search


def _extract(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), U64)
    for k, b in enumerate(bits):
        out |= ((fp >> U64(b)) & U64(1)) << U64(k)
    return out


@cache
def _flips(n: int, t: int) -> tuple[int, ...]:
    """All non-empty sets of at most ``t`` of ``n`` bits, as masks."""
    return tuple(sum(1 << b for b in c) for j in range(1, t + 1) for c in combinations(range(n), j))


class Probes:
    """The keys under which a fingerprint is sent: per code its group of bits and the bits flipped."""

    def __init__(self, chosen: list[tuple[list[int], int]]):
        self.chosen = chosen
        self.codes = [(k, flip) for k, (bits, t) in enumerate(chosen) for flip in (0, *_flips(len(bits), t))]

    def keys(self, fp: np.ndarray, k: int, flips: np.ndarray) -> np.ndarray:
        return mix(mix(_extract(fp, self.chosen[k][0]) ^ flips) ^ U64(k + 1))

    def used(self, k: int) -> int:
        return sum(1 << b for b in self.chosen[k][0])


NODE = {"node": np.int64, "fp": U64, "other": U64}
PACKED = "g int, n long, node binary, fp binary, other binary, code binary"
ROWS = "key long, node long, fp long, other long, home boolean, used long"
OUTCOME = f"u long, v long, {ROWS}"


def _send(nodes: DataFrame, probes: Probes, groups: int) -> DataFrame:
    """Packed rows: nodes, their fingerprints and codes, by the range of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(g << 64) // groups for g in range(1, groups)], U64)
        for batch in batches:
            columns = [np.asarray(c).view(kind) for c, kind in zip(batch.columns, NODE.values(), strict=True)]
            for at in range(0, batch.num_rows, 1 << 13):
                parts = [c[at : at + (1 << 13)] for c in columns]
                m = len(parts[0])
                keys = np.concatenate([probes.keys(parts[1], k, U64(flip)) for k, flip in probes.codes])
                order = np.argsort(keys)
                cut = np.concatenate(([0], np.searchsorted(keys[order], edges), [len(keys)]))
                code, row = order // m, order % m
                full = np.flatnonzero(np.diff(cut))
                ranges = [slice(cut[g], cut[g + 1]) for g in full.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full.astype(np.int32)), pa.array([r.stop - r.start for r in ranges], pa.int64()),
                        *[pa.array([v[row[r]].tobytes() for r in ranges], pa.binary()) for v in parts],
                        pa.array([code[r].astype(np.int32).tobytes() for r in ranges], pa.binary()),
                    ],
                    ["g", "n", *NODE, "code"],
                )

    return nodes.select(*NODE).mapInArrow(run, PACKED)


def _unpack(table: pa.Table | pa.RecordBatch, probes: Probes) -> tuple[np.ndarray, ...]:
    """(key, node, fp, other, home, group of bits) of all packed rows."""
    kinds = NODE | {"code": np.int32}
    node, fp, other, code = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in kinds.items())
    group = np.array([k for k, _ in probes.codes])[code]
    flips = np.array([flip for _, flip in probes.codes], U64)[code]
    key = np.empty(len(fp), U64)
    for k in range(len(probes.chosen)):
        own = np.flatnonzero(group == k)
        key[own] = probes.keys(fp[own], k, flips[own])
    return key, node, fp, other, flips == 0, group


def _sizes(nodes: DataFrame, probes: Probes, groups: int) -> DataFrame:
    """(g, n): the rows that ``_send`` makes for each range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(g << 64) // groups for g in range(1, groups)], U64)
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(U64)
            n = np.zeros(groups, np.int64)
            for at in range(0, len(fp), 1 << 13):
                for k, flip in probes.codes:
                    n += np.bincount(np.searchsorted(edges, probes.keys(fp[at : at + (1 << 13)], k, U64(flip)), "right"), minlength=groups)
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full])], ["g", "n"])

    return nodes.select("fp").mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))


def _row_batch(key, node, fp, other, home, used) -> pa.RecordBatch:
    longs = [pa.array(x.view(np.int64)) for x in (key, node, fp, other)]
    return pa.RecordBatch.from_arrays([*longs, pa.array(home), pa.array(used.view(np.int64))], ["key", "node", "fp", "other", "home", "used"])


def _rows(packed: DataFrame, probes: Probes) -> DataFrame:
    """Packed rows taken apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *columns, group = _unpack(batch.slice(i, 1), probes)
                used = np.array([probes.used(k) for k in range(len(probes.chosen))], U64)[group]
                yield _row_batch(*columns, used)

    return packed.mapInArrow(run, ROWS)


def _deal_again(hot: DataFrame, radius: int) -> DataFrame:
    """Hot keys' rows once for each of ``radius + 1`` groups of the bits not used yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, node, fp, other, used = (np.asarray(batch.column(i)).view(U64) for i in (0, 1, 2, 3, 5))
            home = batch.column(4).to_numpy(zero_copy_only=False)
            for u in np.unique(used).tolist():
                rows = np.flatnonzero(used == U64(u))
                left = [b for b in range(BITS) if not u >> b & 1]
                for k in range(radius + 1):
                    bits = left[k :: radius + 1]
                    now = np.full(len(rows), u | sum(1 << b for b in bits), U64)
                    with np.errstate(over="ignore"):
                        fresh = mix(key[rows] + mix(_extract(fp[rows], bits) + U64(k + 1)))
                    yield _row_batch(fresh, node[rows], fp[rows], other[rows], home[rows], now)

    return hot.select("key", *NODE, "home", "used").mapInArrow(run, ROWS)


def _hot_keys(sent: DataFrame, hot: int) -> DataFrame:
    """(key, c, most, used, p) of the keys whose rows at home times all rows exceed ``hot`` squared: rows,
    rows of the commonest fingerprint, bits used, and a row at home of the commonest there."""
    home = F.min(F.when(F.col("home"), F.struct("node", "fp", "other"))).alias("p")
    by = sent.groupBy("key", "fp").agg(F.count(F.lit(1)).alias("c"), F.count_if("home").alias("h"), F.max("used").alias("used"), home)
    at = F.max(F.when(F.col("p").isNotNull(), F.struct("c", "p"))).getField("p").alias("p")
    of_key = by.groupBy("key").agg(F.sum("c").alias("c"), F.sum("h").alias("h"), F.max("c").alias("most"), F.max("used").alias("used"), at)
    return of_key.filter(F.col("c") * F.col("h") > hot * hot).drop("h")


def _against_pivot(sent: DataFrame, big: DataFrame, radius: int, both: int) -> DataFrame:
    """The rows of the keys of ``big``, with their key's row ``p`` and whether they link to it. Keys without a row at home have no links."""
    rows = lookup_join(sent, big.filter("p is not null").select("key", "p"), ["key"], "node", "inner")
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp")))
    more = F.bit_count(F.col("other").bitwiseXOR(F.col("p.other"))) if both > radius else F.lit(0)
    return rows.withColumn("ok", (differ <= radius) & (differ + more <= both))


def _blocks(rows: DataFrame, hot: int) -> DataFrame:
    """Blocks of the rows that don't link to their key's pivot, each with the others of these, once a
    pair, and with every block of the rest; a block compares its own rows wherever it meets another."""
    nf, nb = (F.ceil(n / hot).cast("int") for n in (F.col("n_open"), F.col("c") - F.col("n_open")))
    at = F.xxhash64("node", F.lit("f"))
    own = F.when(F.col("ok"), nf + F.pmod(at, F.greatest(nb, F.lit(1)))).otherwise(F.pmod(at, nf)).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.when(F.col("ok"), nf).otherwise(nf + nb) - 1))
    columns = ["key", *NODE, "home"]
    pairs = rows.select(*columns, own.alias("x"), met.alias("y"), (nf + nb).alias("n")).filter("x <> y or n = 1")
    return pairs.select(*columns, F.least("x", "y").alias("f"), F.greatest("x", "y").alias("b"))


def links_of_keys(key: np.ndarray, node: np.ndarray, fp: np.ndarray, other: np.ndarray, home: np.ndarray, radius: int, both: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links between rows of one key, of which one at least is at home."""
    order = np.lexsort((~home, key))  # a key's rows at home come first
    key, fp, other, home = key[order], fp[order], other[order], home[order]
    nodes, number = np.unique(node[order], return_inverse=True)
    root = np.arange(len(nodes))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held = 0

    def hold(i: np.ndarray, j: np.ndarray) -> None:
        """Links the rows i and j, whose ``fp`` are near, if ``other`` agrees; those known to be connected are left out."""
        nonlocal held
        if both > radius:
            keep = np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(other[i] ^ other[j]) <= both
            i, j = i[keep], j[keep]
        u, v = number[i], number[j]
        new = root[u] != root[v]
        a.append(u[new])
        b.append(v[new])
        held += len(a[-1])
        if held > HELD:
            settle()

    def settle() -> None:
        nonlocal held
        own = np.flatnonzero(root != np.arange(len(root)))
        root[:] = local_roots(np.concatenate([own, *a]), np.concatenate([root[own], *b]), len(root))
        a.clear()
        b.clear()
        held = 0

    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [len(key)])))
    homes = np.add.reduceat(home, first, dtype=np.int64) if len(key) else size
    wide = homes * size >= WIDE_KEY
    for at, n, h in zip(first[wide].tolist(), size[wide].tolist(), homes[wide].tolist(), strict=True):
        done, end = at, at + n
        while done < at + h:  # some rows at home against all from there on
            rows, width = min(at + h - done, max(1, TILE // (end - done))), end - done
            near = np.flatnonzero(np.bitwise_count(fp[done : done + rows, None] ^ fp[done:end]) <= radius)
            i, j = near // width, near % width
            hold(done + i[j > i], done + j[j > i])
            done += rows
    end = np.repeat(first + size, size)
    at = np.flatnonzero(home & ~np.repeat(wide, size))
    step = 1
    while len(at):
        at = at[at + step < end[at]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        hold(near, near + step)
        step += 1
    settle()
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def _outcome(key, node, fp, other, home, used, radius: int, both: int, hot: int) -> pa.Table:
    """The links of the keys that aren't hot, and the rows of the others."""
    _, place, size = np.unique(key, return_inverse=True, return_counts=True)
    later = (np.bincount(place[home], minlength=len(size)) * size > hot * hot)[place]
    now = ~later
    u, v = links_of_keys(key[now], node[now], fp[now], other[now], home[now], radius, both)
    rows = _row_batch(*[x[later] for x in (key, node, fp, other, home, used)])
    nulls = lambda kind, n: pa.nulls(n, kind)
    ends = [pa.concat_arrays([pa.array(x, pa.int64()), nulls(pa.int64(), rows.num_rows)]) for x in (u, v)]
    rest = [pa.concat_arrays([nulls(c.type, len(u)), c]) for c in rows.columns]
    return pa.table([*ends, *rest], ["u", "v", *rows.schema.names])


def _edge_table(links: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    return pa.table({"u": pa.array(links[0], pa.int64()), "v": pa.array(links[1], pa.int64())})


def search(nodes: DataFrame, radius: int = RADIUS, both: int | None = None, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """(u, v): edges that connect the nodes of (node, fp, other) as their links do.

    Nodes link if their ``fp`` differ in at most ``radius`` bits and, where ``both`` is
    given, ``fp`` and ``other`` together in at most ``both``.
    """
    spark, both = nodes.sparkSession, radius if both is None else both
    n = nodes.count()
    if n < 2:
        return nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    # A hash picks about SAMPLE of them where they are: an ordered limit would send as many from each task.
    part = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < min(1 << 30, (SAMPLE << 30) // n)
    sample = nodes.filter(part).select("fp").toArrow().column("fp").to_numpy().view(U64)
    probes = Probes(plan(sample[np.argsort(mix(sample))], n, radius))
    rows = n * len(probes.codes)
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // group))

    masks = np.array([probes.used(k) for k in range(len(probes.chosen))], U64)

    def of_packed(table: pa.Table) -> pa.Table:
        *columns, which = _unpack(table, probes)
        return _outcome(*columns, masks[which], radius, both, hot)

    def of_rows(table: pa.Table) -> pa.Table:
        key, node, fp, other = (table.column(name).to_numpy().view(U64) for name in ("key", *NODE))
        return _edge_table(links_of_keys(key, node.view(np.int64), fp, other, table.column("home").to_numpy(), radius, both))

    large = stage(_sizes(nodes, probes, groups).filter(F.col("n") > 4 * group).select("g"))
    packed = _send(nodes, probes, groups)
    apart = not large.isEmpty()
    outcome = stage((packed.join(large, "g", "left_anti") if apart else packed).groupBy("g").applyInArrow(of_packed, OUTCOME))
    found = outcome.filter("u is not null").select("u", "v")
    columns = ["key", *NODE, "home", "used"]
    sent = outcome.filter("u is null").select(columns)
    if apart:
        sent = stage(sent.union(_rows(packed.join(large, "g", "left_semi"), probes)))
    elif sent.isEmpty():
        return found
    held = [large, outcome, sent]
    for deals_left in range(DEALS, -1, -1):
        big = stage(_hot_keys(sent, hot))
        calm = sent.join(big.select("key"), "key", "left_anti")
        part = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g")
        found = found.union(calm.select(part, "key", *NODE, "home").groupBy("g").applyInArrow(of_rows, "u long, v long"))
        held.append(big)
        if big.isEmpty():
            break
        tried = stage(_against_pivot(sent, big, radius, both))
        found = found.union(tried.filter("ok and node <> p.node").select(F.col("node").alias("u"), F.col("p.node").alias("v")))
        left = tried.groupBy("key").agg(F.count_if(~F.col("ok")).alias("n_open")).filter("n_open > 0")
        again = f"bit_count(used) < {BITS - radius} and most <= {hot} and n_open > {(radius + 1) * hot}" if deals_left else "false"
        left = stage(big.join(left, "key").withColumn("deal", F.expr(again)))
        opened = lookup_join(tried.drop("p"), left.select("key", "c", "n_open", "deal"), ["key"], "node", "inner")
        found = found.union(_blocks(opened.filter("not deal"), hot).groupBy("key", "f", "b").applyInArrow(of_rows, "u long, v long"))
        held += [tried, left]
        if left.filter("deal").isEmpty():
            break
        sent = stage(_deal_again(opened.filter("deal"), radius))
        held.append(sent)
    edges = stage(found)
    discard(*held)
    free_shuffles(spark)
    return edges


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    rows = stage(with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle).toDF("doc_id", "fp"))
    firsts = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(search(firsts.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("other")), radius)).toDF("fp", "root")
    placed = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    free_shuffles(docs.sparkSession)
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similar texts


def _similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` with ``shared`` members have the similarity that links."""
    return shared * SIMILAR[1] >= (a + b - shared) * SIMILAR[0]


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(root, node, n, set) for (root, node, text): the shingles' number and their hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets([(x.as_py() or "").encode() for x in part.column(2)], shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["root", "node", "n", "set"],
                )

    return texts.select("root", "node", "text").mapInArrow(run, "root long, node long, n long, set binary")


def _against_root(pairs: DataFrame) -> DataFrame:
    """(root, node, ok) for (root, node, set, root_set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                ok.append(bool(_similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["root", "node", "ok"])

    return pairs.select("root", "node", "set", "root_set").mapInArrow(run, "root long, node long, ok boolean")


def _compare_blocks(table: pa.Table) -> pa.Table:
    """Star edges of the links between the rows of ``open`` and the others."""
    node, n = np.asarray(table.column("node")), np.asarray(table.column("n"))
    is_open = table.column("open").to_numpy()
    rest, some = np.flatnonzero(~is_open), np.flatnonzero(is_open)
    sets = table.column("set")
    hashes = np.concatenate([np.zeros(0, U64), *[np.frombuffer(sets[i].as_py(), U64) for i in rest.tolist()]])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], np.repeat(np.arange(len(rest)), n[rest])[order]
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in some.tolist():
        own = np.frombuffer(sets[i].as_py(), U64)
        lo, hi = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(own) else lo
        shared = np.bincount(owner[at], minlength=len(rest))
        near = rest[_similar(shared, n[i], n[rest])]
        u.append(np.full(len(near), node[i]))
        v.append(node[near])
    return _edge_table(spanning_stars(np.concatenate(u), np.concatenate(v)))


def verified(sets: DataFrame) -> DataFrame:
    """(u, v): edges that connect the nodes of (root, node, n, set) as their links do.

    The nodes of one root are candidates of each other. Each is compared with the root's
    own set first. Those similar to it are one component, so only pairs with one of the
    others are left: blocks of these meet blocks of all nodes of the root, a task each.
    """
    roots = sets.filter("node = root").select("root", F.col("set").alias("root_set"))
    tried = stage(_against_root(lookup_join(sets.filter("node <> root"), roots, ["root"], "node", "inner")))
    edges = tried.filter("ok").select(F.col("node").alias("u"), F.col("root").alias("v"))
    marked = sets.join(tried.filter("not ok").select("node", F.lit(True).alias("open")), "node", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    blocks = lambda c: F.ceil(c / SET_BLOCK).cast("int")
    sizes = marked.groupBy("root").agg(blocks(F.sum(F.col("n") + 1)).alias("nb"), blocks(F.sum(F.when(F.col("open"), F.col("n") + 1))).alias("nf"))
    placed = lookup_join(marked, sizes.filter("nf > 0"), ["root"], "node", "inner")
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = ["root", "node", "n", "set"]
    ones = placed.filter("open").select(*columns, "open", own("nf").alias("f"), every("nb").alias("b"))
    others = placed.select(*columns, F.lit(False).alias("open"), every("nf").alias("f"), own("nb").alias("b"))
    return edges.union(ones.union(others).groupBy("root", "f", "b").applyInArrow(_compare_blocks, "u long, v long"))


def _winners(docs: DataFrame, near: int, both: int, shingle: int, count: int) -> DataFrame:
    """(k1, k2) of the documents that stay, staged."""
    spark = docs.sparkSession
    names = [f"fp{k}" for k in range(count)]
    rows = stage(with_fingerprints(docs.select(*doc_key(), "doc_id", "text"), shingle, count, ("k1", "k2", "doc_id"), distinct=True))
    order = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("i"), "k1", "k2")
    firsts = rows.groupBy(*names, "digest").agg(F.min(order).alias("first")).withColumn("node", F.xxhash64(*names, "digest"))
    firsts = stage(firsts)  # texts with the same set are one node
    edges, links = None, []
    for k, name in enumerate(names):  # one search at a time, so that only its own shuffle is held
        found = stage(search(firsts.select("node", F.col(name).alias("fp"), F.col(names[(k + 1) % count]).alias("other")), near, both))
        edges = found if edges is None else edges.union(found)
        links.append(found)
        free_shuffles(spark)
    candidates = components(edges).toDF("node", "root")
    discard(rows, *links)
    candidates = candidates.union(candidates.select("root", "root").distinct())
    keys = firsts.join(candidates, "node").select("first.k1", "first.k2", "root", "node")
    texts = docs.select(*doc_key(), "text").join(keys, ["k1", "k2"]).groupBy("k1", "k2")
    sets = stage(_sets(texts.agg(*[F.first(c).alias(c) for c in ("root", "node", "text")]), shingle))
    free_shuffles(spark)
    pairs = stage(verified(sets))
    discard(sets)
    roots = components(pairs).toDF("node", "root")
    winners = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    winners = stage(winners.select("first.k1", "first.k2"))
    discard(firsts, pairs)
    free_shuffles(spark)
    return winners


def keep_one(docs: DataFrame, near: int = NEAR, both: int = BOTH, shingle: int = WIDE, count: int = FINGERPRINTS) -> DataFrame:
    """``docs`` with one document of each group of similar texts: the smallest id, nulls last."""
    with small_batches(docs.sparkSession):
        winners = _winners(docs, near, both, shingle, count)
    whole = docs.select(*doc_key(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(winners, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*")
