"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as blank, as a Java character class.
NON_BLANK = r"[^\s\x1c-\x1f\x85\xa0  -     　]"
# The marker in file names, and the tail of optimisation level and hash.
NAME_MARKER = "_functions"
NAME_TAIL = r"-[^-]*(-[^-]*)?\z"


def body_lines(text: Column) -> Column:
    """Non-blank lines between the first ``{`` and the last ``}``; 0 without both."""
    body = F.regexp_extract(text, r"(?s)\{(.*)\}", 1)
    return F.size(F.filter(F.split(body, "\n", -1), lambda line: line.rlike(NON_BLANK)))


def source_binary_name(file_name: Column) -> Column:
    """The file name without any marker and without its last two ``-`` parts."""
    return F.regexp_replace(F.replace(file_name, F.lit(NAME_MARKER), F.lit("")), NAME_TAIL, "")


def proxy_token_len(text: Column) -> Column:
    """Words and single punctuation marks, the stand-in for a tokenizer; -1 without text."""
    n = F.size(F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), F.lit(0)))
    return F.when(text.isNull() | (text == ""), F.lit(-1)).otherwise(n).cast("long")


_HANDLES: dict[str, Callable] = {}


class PerWorker:
    """A callable that ``factory`` makes once in each Python worker, for tokenizers that are
    costly to load or can't be pickled; it may stand for any callable that the UDFs here take."""

    def __init__(self, factory: Callable[[], Callable]):
        self.key, self.factory = uuid.uuid4().hex, factory

    def __call__(self, *args):
        if self.key not in _HANDLES:
            _HANDLES[self.key] = self.factory()
        return _HANDLES[self.key](*args)


def tokenizer_len(count: Callable[[str], int]):
    """An Arrow UDF that applies ``count`` to each text; -1 for null or empty text."""

    @F.pandas_udf(T.LongType())
    def token_len(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: count(x) if x else -1).astype("int64")

    return token_len


def tokenizer_ids(encode: Callable[[str], list[int]]):
    """An Arrow UDF with the token ids of each text; an empty list for null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: encode(x) if x else [])

    return ids


def hash_int(*parts: Column) -> Column:
    """A reproducible integer in [0, 2^32) from the parts joined by ``:``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def fit_length(ids: Column, length: int, pad_id: int = 0) -> Column:
    """The first ``length`` ids, padded on the left to exactly that length."""
    kept = F.slice(ids, 1, length)
    return F.concat(F.array_repeat(F.lit(pad_id).cast("int"), F.lit(length) - F.size(kept)), kept)


def fit_mask(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0), F.lit(length) - n), F.array_repeat(F.lit(1), n))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, eps: float = 1e-8) -> Column:
    """v / max(|v|, eps): an all-zero vector stays zero."""
    norm = F.greatest(l2_norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / norm)


def pair_distance(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Euclidean distance, each difference shifted by ``eps``."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double") + F.lit(eps))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))
