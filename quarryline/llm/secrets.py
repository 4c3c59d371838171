"""Secret scan: fixed patterns, and two character Markov models compared by likelihood.

Base kinds, leftmost and non-overlapping each: ``assign`` (a key word, a colon or
equals sign, and a value of 12 or more characters), ``access`` (key ids of 18 or
more characters) and ``hex`` (16 or more hexadecimal digits). They always stay.

Kind ``markov`` adds runs of ``MIN_RUN`` or more base64 characters, whether base spans
touch them or not; what lies inside base spans already is not reported again. Two
first-order models give each run's log-likelihood: one trained
on random strings drawn over the usual alphabets by a fixed seed, one on ordinary
identifiers: the words of a bounded sample of the documents, a part of
``TRAIN_CHARS`` characters of each, alone and joined in the usual styles. A run is a secret if its ratio, or that of a part of ``MIN_RUN`` or
more characters between separators (``/ + _ - =``), is at least ``THRESHOLD`` in all
and ``PER_CHAR`` for each character. The span is the whole run, or else those parts.

Offsets are code points, the end exclusive; spans are in the order of their start,
then of their kind as listed. Null and empty texts have none. Rows are independent
of each other; repeated rows give equal rows, an empty table gives none. Without any words
to train on, the random model is compared with a uniform one. Further columns, whatever
their names, are kept by ``redact`` and passed over by ``secret_digests``. A very long text
takes memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import chunks, word_bounds

KINDS = ("assign", "access", "hex", "markov")
# The base patterns and the least lengths that count.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: Characters of a run that the models judge, and the evidence that they ask for.
MIN_RUN, THRESHOLD, PER_CHAR = 20, 12.0, 0.5
#: Documents, and words of them, that the model of identifiers is trained on; random strings of the other.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WORDS, TRAIN_RANDOM = 400, 50_000, 40_000, 20_000

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_CODE = np.full(256, -1, np.int16)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_RUN = _CODE >= 0


class Markov:
    """First-order model over ``ALPHABET`` with a start state; each count begins at ``smooth``."""

    def __init__(self, samples: list[str], smooth: float = 0.2):
        n = len(ALPHABET)
        counts = np.full((n + 1, n), smooth)
        for text in samples:
            codes = _CODE[np.frombuffer(text.encode(), np.uint8)]
            codes = codes[codes >= 0]
            if len(codes):
                np.add.at(counts, (np.concatenate(([n], codes[:-1])), codes), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))

    def score(self, text: bytes) -> float:
        codes = _CODE[np.frombuffer(text, np.uint8)]
        return float(self.log[np.concatenate(([len(ALPHABET)], codes[:-1])), codes].sum())


def random_strings(n: int = TRAIN_RANDOM, seed: int = 7) -> list[str]:
    """Strings as keys have them: base64 and its URL form, letters and digits, upper case, hexadecimal."""
    rng = random.Random(seed)
    upper, lower, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    kinds = [upper + lower + digits + "+/", upper + lower + digits + "_-", upper + lower + digits, upper + digits, lower + digits, "0123456789abcdef", "0123456789ABCDEF"]
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(16, 44))) for _ in range(n)]


def identifiers(words: list[str], n: int = TRAIN_WORDS, seed: int = 8) -> list[str]:
    """Ordinary names: words alone and joined in snake, kebab, camel and upper case, paths, and with short numbers."""
    if not words:
        return []
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        some = [rng.choice(words) for _ in range(rng.randrange(1, 5))]
        style = rng.randrange(7)
        if style == 0:
            out.append("".join(some))
        elif style == 1:
            out.append("_".join(some))
        elif style == 2:
            out.append("-".join(some))
        elif style == 3:
            out.append("".join(w.capitalize() for w in some))
        elif style == 4:
            out.append("_".join(some).upper())
        elif style == 5:
            out.append("/".join(some))
        else:
            out.append("_".join(some) + rng.choice(["", "_", "-"]) + str(rng.randrange(10 ** rng.randrange(1, 5))))
    return out


class Models:
    def __init__(self, words: list[str]):
        self.secret = Markov(random_strings())
        self.plain = Markov(identifiers(words))

    def ratio(self, run: bytes) -> float:
        return self.secret.score(run) - self.plain.score(run)

    def is_secret(self, run: bytes) -> bool:
        return self.ratio(run) >= max(THRESHOLD, PER_CHAR * len(run))

    def secrets_in(self, run: bytes) -> list[tuple[int, int]]:
        """The whole run if it is a secret, else the secrets among the parts between its separators."""
        if self.is_secret(run):
            return [(0, len(run))]
        parts = [m.span() for m in _PART.finditer(run) if m.end() - m.start() >= MIN_RUN]
        return [(a, b) for a, b in parts if self.is_secret(run[a:b])]


_PART = re.compile(rb"[A-Za-z0-9]+")
_WORD = re.compile(r"[A-Za-z]{2,}")


def train(docs: DataFrame) -> Models:
    """The models; the words are those of at most ``TRAIN_DOCS`` documents, chosen by a hash,
    and of a part of at most ``TRAIN_CHARS`` characters of each, placed by it."""
    h = F.xxhash64("text")
    start = F.pmod(h, F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS + 1)).cast("int")
    some = docs.filter(F.length("text") > 0).select(F.substring(F.col("text"), start + 1, F.lit(TRAIN_CHARS)).alias("text"), h.alias("h"))
    least = [r.h for r in some.select("h").distinct().orderBy("h").limit(TRAIN_DOCS).collect()]
    # Hashes alone are ordered; only the texts chosen reach the driver.
    chosen = some.filter(F.col("h") <= max(least, default=-(1 << 63))).dropDuplicates(["h"]).orderBy("h")
    words = [w for r in chosen.collect() for w in _WORD.findall(r.text)]
    random.Random(9).shuffle(words)
    return Models(words[:TRAIN_WORDS])


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def spans_of(text: bytes, models: Models | None, marked: bool = True, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, ascending. ``marked``: a colon or equals sign is there;
    ``runs``: the text's runs of ``MIN_HEX`` or more of the alphabet, looked for if not given."""
    out = []
    if marked:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if runs is None:
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = word_bounds(_RUN[data], np.array([0, len(data)]))
        runs = [(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a >= MIN_HEX]
    if runs:  # every key id and hexadecimal string lies in one
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        for a, b in runs:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= MIN_HEX]
    if models is not None:
        starts, ends = _joined([(a, b) for a, _, b in out])
        for a, b in runs:
            if b - a >= MIN_RUN:
                found = [(a + x, a + y) for x, y in models.secrets_in(text[a:b])]
                out += [(x, 3, y) for x, y in found if not ((k := bisect_right(starts, x)) and ends[k - 1] >= y)]
    return sorted(out)


def scan(texts: pa.Array, models: Models) -> Iterator[list[tuple[int, int, int]]]:
    """Per text the spans in code points."""
    for lo, hi, data, offsets in chunks(texts):
        starts, ends, first = word_bounds(_RUN[data], offsets)
        long = np.flatnonzero(ends - starts >= MIN_HEX)
        text_of = np.searchsorted(offsets, starts[long], "right") - 1
        marks = np.zeros(hi - lo, bool)
        marks[np.searchsorted(offsets, np.flatnonzero((data == 58) | (data == 61)), "right") - 1] = True
        runs: dict[int, list[tuple[int, int]]] = {}
        for k, t in zip(long.tolist(), text_of.tolist(), strict=True):
            runs.setdefault(t, []).append((int(starts[k] - offsets[t]), int(ends[k] - offsets[t])))
        for t in range(hi - lo):
            if not (marks[t] or t in runs):
                yield []
                continue
            own = data[offsets[t] : offsets[t + 1]]
            found = spans_of(own.tobytes(), models, bool(marks[t]), runs.get(t, []))
            if found:
                points = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
                found = sorted((int(points[a]), kind, int(points[b])) for a, kind, b in found)
            yield found


def _list(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_digests(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(scan(batch.column(1), shared.value))
            counts = [pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in range(3)]
            digests = [hashlib.sha256(_list([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([_list(x) for x in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, models: Models | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span, overlapping ones joined, replaced by ``mark``."""
    shared = docs.sparkSession.sparkContext.broadcast(models or train(docs))

    @F.pandas_udf("string")
    def cut(texts):
        import pandas as pd

        out = []
        for text, spans in zip(texts, scan(pa.array(texts, pa.string()), shared.value), strict=True):
            at, parts = 0, []
            for a, _, b in spans:
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append(text if not spans else "".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", cut(F.col("text")))
