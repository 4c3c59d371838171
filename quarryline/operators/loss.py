"""Pooling, normalisation and the triplet margin loss on given vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import expressions as X


def last_token_pool(df: DataFrame) -> DataFrame:
    """One vector per row of (batch, id, hidden, mask).

    If every row of a batch ends in a real token, the last position counts for all;
    else the position of the mask's sum. An all-zero mask takes the last position.
    """
    ends = df.groupBy("batch").agg(F.bool_and(F.element_at("mask", -1) == 1).alias("full"))
    n = F.aggregate("mask", F.lit(0), lambda acc, x: acc + x)
    at = F.when(F.col("full") | (n == 0), F.lit(-1)).otherwise(n).cast("int")
    return df.join(ends, "batch").select("batch", "id", F.element_at("hidden", at).alias("embedding"))


def l2_normalize(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, X.l2_normalize(F.col(column)))


def triplet_losses(df: DataFrame, margin: float = 1.0) -> DataFrame:
    gap = X.pair_distance(F.col("anchor"), F.col("positive")) - X.pair_distance(F.col("anchor"), F.col("negative"))
    return df.withColumn("loss", F.greatest(gap + F.lit(float(margin)), F.lit(0.0)))


def triplet_loss(df: DataFrame, margin: float = 1.0, digits: int = 9) -> DataFrame:
    """The mean over all rows; null for none."""
    return triplet_losses(df, margin).agg(F.round(F.avg("loss"), digits).alias("loss"))
