"""Reproducible anchor/positive/negative sampling without rejection.

Groups are contiguous in the new index, so a group is the range [group_start,
group_start + size). The r-th index outside it, and the r-th member other than
the anchor, follow by arithmetic: no list of positives is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import expressions as X


def first_anchors(index: DataFrame, k: int = 4, split: str = "train") -> DataFrame:
    return index.filter((F.col("split") == split) & (F.col("size") > 1)).select(F.col("new_idx").alias("anchor")).orderBy("anchor").limit(k)


def negative_candidates(index: DataFrame) -> DataFrame:
    """Per anchor how many rows of its split are neither itself nor a positive."""
    n = index.groupBy("split").agg(F.count(F.lit(1)).alias("pool_n"))
    rows = index.filter("size > 1").join(F.broadcast(n), "split")
    return rows.select("split", F.col("new_idx").alias("anchor"), (F.col("pool_n") - F.col("size")).alias("candidates"))


def triplet_sample(index: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(split, anchor, positive, negative); an anchor whose group is its whole pool goes."""
    n = index.groupBy("split").agg(F.count(F.lit(1)).alias("pool_n"))  # one row per split
    rows = index.filter("size > 1").join(F.broadcast(n), "split").filter("pool_n > size")
    draw = lambda tag: X.hash_int(F.lit(tag), F.lit(seed), F.lit(epoch), F.col("new_idx"))
    r = F.col("group_start") + draw("p") % (F.col("size") - 1)
    s = draw("n") % (F.col("pool_n") - F.col("size"))
    return rows.select(
        "split", F.col("new_idx").alias("anchor"),
        F.when(r >= F.col("new_idx"), r + 1).otherwise(r).alias("positive"),
        F.when(s >= F.col("group_start"), s + F.col("size")).otherwise(s).alias("negative"),
    )


def triplet_texts(sample: DataFrame, pool: DataFrame) -> DataFrame:
    """The three texts per anchor, by equi-joins on (split, new_idx)."""
    out = sample
    for role in ("anchor", "positive", "negative"):
        texts = pool.select("split", F.col("new_idx").alias(role), F.col("text").alias(f"{role}_text"))
        out = out.join(texts, ["split", role])
    return out.select("split", F.col("anchor").alias("anchor_idx"), *[F.col(f"{r}_text").alias(r) for r in ("anchor", "positive", "negative")])


def point_lookup(df: DataFrame, idx: int, key: str = "original_idx", column: str = "text") -> DataFrame:
    return df.filter(F.col(key) == idx).select(key, column)
