"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A piece's bytes form a doubly linked list. Each merge rank has a bucket of list
positions; a two-level bitmap marks the buckets that are not empty. The next
merge is the first set bit, found by isolating the lowest bit on either level,
and within it the leftmost position. A merge changes the pairs on either side, so
entries can be out of date; they are recognised by the pair's current rank and
skipped. Each merge costs O(log n) whatever the piece's length, so a piece of a
million bytes takes no quadratic time.

The pieces of a batch that a worker doesn't hold yet share one such list and queue, with
borders that no pair crosses, so that the bits are searched once per rank and not once
per merge. A piece in which a merge makes a pair of lower rank, which has to go before
other pairs of that piece, leaves the batch for a queue of its own, as long pieces do.

Null and empty texts have no tokens, an empty table gives no rows. Rows are independent of
each other: repeated rows give equal rows, no row is dropped, and further columns, whatever
their names, are passed over. Very long texts are split in parts, very long pieces take
memory in proportion to their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bits of a rank that the lower level of the bitmap holds.
LEAF_BITS = 8
LEAF = (1 << LEAF_BITS) - 1
#: Pieces whose ids a worker keeps, in two generations of half as many, and pairs whose ranks
#: it keeps; only speed depends on them. A piece takes about 200 bytes.
CACHED_PIECES, CACHED_PAIRS = 400_000, 400_000
#: Characters of text that are split at a time, and looked up at a time.
SPLIT_CHARS, LOOK_UP = 1 << 19, 1 << 20
#: Bytes of a piece that shares a queue at most, and of the pieces that share one.
SHORT_PIECE, JOINT = 1 << 10, 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank; lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pairs(dict):
    """The rank of two neighbours' joint bytes by ``left * width + right``, -1 if they don't merge."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes], width: int):
        super().__init__()
        self.ranks, self.tokens, self.width = ranks, tokens, width

    def __missing__(self, key: int) -> int:
        if len(self) >= CACHED_PAIRS:
            self.clear()
        a, b = divmod(key, self.width)
        found = self[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return found


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.width = max(self.tokens) + 1
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.pairs = Pairs(ranks, self.tokens, self.width)
        self.singles = np.array(self.bytes)
        self.doubles = np.full(1 << 16, -1)  # the rank of each two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.doubles[token[0] << 8 | token[1]] = rank

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece."""
        out = [b""] * len(pieces)
        held: list[int] = []
        size = 0
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.uint32(whole).tobytes()
            elif len(piece) > SHORT_PIECE:
                out[i] = np.array(self.encode(piece), np.uint32).tobytes()
            else:
                held.append(i)
                size += len(piece)
            if held and (size >= JOINT or i == len(pieces) - 1):
                for k, ids in zip(held, self.encode_joint([pieces[k] for k in held]), strict=True):
                    out[k] = ids
                held, size = [], 0
        return out

    def encode_joint(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece, all merged in one list."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        ends = np.cumsum([len(x) for x in pieces])
        starts = np.concatenate(([0], ends[:-1]))
        ranks = np.full(n, -1)
        ranks[:-1] = self.doubles[data[:-1].astype(np.int64) << 8 | data[1:]]
        ranks[ends - 1] = -1
        at = np.arange(n + 1)
        following, previous = at + 1, at - 1
        following[ends - 1], previous[starts] = n, n  # past the border
        ids, now, following, previous = self.singles[data].tolist(), ranks.tolist(), following.tolist(), previous.tolist()
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        found, first = np.unique(ranks[order], return_index=True)
        buckets = dict(zip(found.tolist(), [x.tolist() for x in np.split(order, first[1:])], strict=True)) if len(order) else {}
        leaves: dict[int, int] = {}
        top = 0
        for r in buckets:
            leaves[r >> LEAF_BITS] = leaves.get(r >> LEAF_BITS, 0) | 1 << (r & LEAF)
            top |= 1 << (r >> LEAF_BITS)
        gone = bytearray(n)
        apart: dict[int, bytes] = {}
        pairs, width = self.pairs, self.width
        while top:
            hi = (top & -top).bit_length() - 1
            leaf = leaves[hi]
            r = hi << LEAF_BITS | (leaf & -leaf).bit_length() - 1
            leaves[hi] = leaf = leaf & (leaf - 1)
            if not leaf:
                top &= top - 1
            bucket = buckets.pop(r)
            bucket.sort()  # later entries stand behind the first ones
            base = r * width
            for i in bucket:
                if now[i] != r:
                    continue  # stale
                ids[i] = r
                j = following[i]
                k = following[i] = following[j]
                now[j] = -1
                gone[j] = 1
                x = y = -1
                if k < n:
                    previous[k] = i
                    x = pairs[base + ids[k]]
                    if x > r:
                        if x in buckets:
                            buckets[x].append(i)
                        else:
                            buckets[x] = [i]
                            hi = x >> LEAF_BITS
                            leaves[hi] = leaves.get(hi, 0) | 1 << (x & LEAF)
                            top |= 1 << hi
                now[i] = x
                j = previous[i]
                if j < n:
                    y = now[j] = pairs[ids[j] * width + r]
                    if y > r:
                        if y in buckets:
                            buckets[y].append(j)
                        else:
                            buckets[y] = [j]
                            hi = y >> LEAF_BITS
                            leaves[hi] = leaves.get(hi, 0) | 1 << (y & LEAF)
                            top |= 1 << hi
                if -1 < x < r or -1 < y < r:
                    piece = int(np.searchsorted(ends, i, "right"))
                    apart[piece] = np.array(self.encode(pieces[piece]), np.uint32).tobytes()
                    a, b = int(starts[piece]), int(ends[piece])
                    now[a:b] = [-1] * (b - a)
        left = np.frombuffer(gone, np.uint8) == 0
        cut = (np.concatenate(([0], np.cumsum(left)))[ends] * 4).tolist()
        packed = np.array(ids, np.uint32)[left].tobytes()
        out = [packed[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]
        for piece, own in apart.items():
            out[piece] = own
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        single, pairs, width = self.bytes, self.pairs, self.width
        ids = [single[b] for b in piece]
        n = len(ids)
        now = [pairs[a * width + b] for a, b in zip(ids, ids[1:])]  # the rank of the pair that starts at a position  # noqa: B905
        now.append(-1)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        leaves: dict[int, int] = {}
        top = 0
        for i, r in enumerate(now):
            if r in buckets:
                buckets[r].append(i)  # ascending, so a heap already
            elif r >= 0:
                buckets[r] = [i]
                hi = r >> LEAF_BITS
                leaves[hi] = leaves.get(hi, 0) | 1 << (r & LEAF)
                top |= 1 << hi
        while top:
            hi = (top & -top).bit_length() - 1
            leaf = leaves[hi]
            r = hi << LEAF_BITS | (leaf & -leaf).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                leaf &= leaf - 1
                leaves[hi] = leaf
                if not leaf:
                    top &= top - 1
            if now[i] != r:
                continue  # stale: one of its two tokens has merged with another
            ids[i] = r
            j = following[i]
            k = following[i] = following[j]
            now[j] = -1
            if k < n:
                previous[k] = i
                x = now[i] = pairs[r * width + ids[k]]
                if x in buckets:
                    heappush(buckets[x], i)
                elif x >= 0:
                    buckets[x] = [i]
                    hi = x >> LEAF_BITS
                    leaves[hi] = leaves.get(hi, 0) | 1 << (x & LEAF)
                    top |= 1 << hi
            else:
                now[i] = -1
            i = previous[i]
            if i >= 0:
                x = now[i] = pairs[ids[i] * width + r]
                if x in buckets:
                    heappush(buckets[x], i)
                elif x >= 0:
                    buckets[x] = [i]
                    hi = x >> LEAF_BITS
                    leaves[hi] = leaves.get(hi, 0) | 1 << (x & LEAF)
                    top |= 1 << hi
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = following[i]
        return out


# ---------------------------------------------------------------- splitting

# The code points of white space, as ranges.
SPACES = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
OTHER, LETTER, NUMBER, SPACE = range(4)
# The contractions of the pattern, without their apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    for a, b in SPACES:
        out[a : b + 1] = SPACE
    return out


def split_points(text: str) -> list[int]:
    """Where the matches of the public pattern start, by the runs of character classes.

    A space joins the run after it; other white space before a run stands alone,
    and the rest of a white-space run is one piece. An apostrophe alone between
    pieces takes the letters of a contraction. Every character is in one piece.
    """
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(code)
    kind = classes()[code]
    first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    last = np.concatenate((first[1:], [n])) - 1
    of = kind[first]
    spaces = of == SPACE
    plain = ~spaces
    followed = spaces.copy()
    followed[-1] = False
    joins = followed & (code[last] == 32)  # its last character belongs to the next run
    joined = np.concatenate(([False], joins[:-1]))
    start = np.zeros(n, bool)
    start[first[spaces]] = True
    start[last[followed]] = True
    start[first[plain & ~joined]] = True
    quotes = np.flatnonzero((of == OTHER) & (first == last) & ~joined & (code[first] == 39))
    quotes = quotes[quotes + 1 < len(first)]
    for k in quotes[of[quotes + 1] == LETTER].tolist() if len(quotes) else ():
        a, b = int(first[k + 1]), int(last[k + 1]) + 1
        size = 1 if text[a] in SHORT else 2 if text[a : min(a + 2, b)] in LONG else 0
        if size:
            start[a] = False
            if a + size < b:
                start[a + size] = True
    return np.flatnonzero(start).tolist()


def split_public(text: str) -> list[str]:
    """The pieces of the public pattern. Long texts go in parts that end before a letter or
    number run which follows a space, where a piece begins whatever stands before."""
    if not text:
        return []
    out: list[str] = []
    while text:
        part = text
        if len(text) > 2 * SPLIT_CHARS and (cut := _CUT.search(text, SPLIT_CHARS)):
            part = text[: cut.start() + 1]
        at = split_points(part)
        out += [part[a:b] for a, b in zip(at, at[1:] + [len(part)], strict=True)]
        text = text[len(part) :]
    return out


#: A letter, then one space: the space starts a piece.
_CUT = re.compile(r"[a-z](?= [a-z])")


def splitter(pattern: str):
    """A function from text to pieces; any other pattern than the public one goes to the regex engine."""
    return split_public if pattern == public_tokenizers.PATTERN else regex.compile(pattern).findall


# ---------------------------------------------------------------- texts


class Codec(dict):
    """Pieces to their packed ids, kept once made; also decodes. A full generation of pieces
    becomes the older one, from which pieces that are used again come back."""

    def __init__(self, path: str, pattern: str):
        self.encoder = Encoder(load_ranks(path))
        self.split = splitter(pattern)
        self.decimals = [b"%d" % i for i in range(self.encoder.width)]
        self.older: dict[str, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The packed ids of pieces that the newer generation lacks."""
        found: dict[str, bytes] = {}
        fresh = []
        for piece in pieces:
            ids = self.older.get(piece)
            if ids is None:
                fresh.append(piece)
            else:
                found[piece] = ids
        found |= zip(fresh, self.encoder.encode_all([x.encode() for x in fresh]), strict=True)
        if len(self) + len(found) > CACHED_PIECES // 2:
            self.older = dict(self)
            self.clear()
        if len(found) <= CACHED_PIECES // 2:
            self |= {k: v for k, v in found.items() if len(k) <= 64}
        return found

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text; the pieces of some texts at a time are looked up together."""
        held: list[tuple[list[str], list[bytes | None]]] = []
        size = 0
        for text in texts:
            pieces = self.split(text)
            held.append((pieces, list(map(self.get, pieces))))
            size += len(text)
            if size >= LOOK_UP:
                yield from self._made(held)
                held, size = [], 0
        yield from self._made(held)

    def _made(self, held: list[tuple[list[str], list[bytes | None]]]) -> Iterator[np.ndarray]:
        holes = [[k for k, x in enumerate(found) if x is None] if None in found else [] for _, found in held]
        learnt = self.learn(dict.fromkeys(pieces[k] for (pieces, _), own in zip(held, holes, strict=True) for k in own))
        for (pieces, found), own in zip(held, holes, strict=True):
            for k in own:
                found[k] = learnt[pieces[k]]
            yield np.frombuffer(b"".join(found), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.encoder.tokens.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(path, pattern)


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.BinaryType()),
    ]
)
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids of each text, and the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = list(c.encode_all(x or "" for x in part.column(1).to_pylist()))
                decoded = [c.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, ids), pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)


def encode_digests(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as ``encode``, with digests made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            sizes, ids_sha, decoded_sha = [], [], []
            for found in c.encode_all(x.as_py() or "" for x in batch.column(1)):
                ids = found.tolist()
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(b",".join(map(c.decimals.__getitem__, ids))).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, DIGESTS)
