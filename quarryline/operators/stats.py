"""Exact length statistics and the points of the cumulative distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points that one array spreads out: a length held by very many rows goes in several.
STRETCH = 1 << 16
PERCENTILES = {"median": 0.5, "p95": 0.95, "p99": 0.99, "p99_5": 0.995}


def token_stats(df: DataFrame, column: str = "token_len", digits: int = 6) -> DataFrame:
    """One row; the percentiles are exact, with linear interpolation. All null for no rows.

    Lengths repeat a lot, so they are counted first and the percentiles weigh the
    counts: what reaches the last task is one row per distinct length.
    """
    by = df.groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("c")).filter("x is not null")
    quantiles = F.percentile("x", F.array(*[F.lit(p) for p in PERCENTILES.values()]), F.col("c"))
    one = by.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.round(F.sum(F.col("x") * F.col("c")) / F.sum("c"), digits).alias("mean"), quantiles.alias("q"),
    )
    return one.select(
        "n", "min", "max", "mean", *[F.round(F.get("q", F.lit(i)), digits).alias(k) for i, k in enumerate(PERCENTILES)]
    )


def token_cdf(df: DataFrame, column: str = "token_len", digits: int = 9) -> DataFrame:
    """(x_i, i / (n - 1)) for the sorted values; null for a single row.

    Only the distinct values pass through the unpartitioned window; the ties are
    spread out again by an explode, which needs no shuffle.
    """
    by = df.groupBy(F.col(column).alias(column)).agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    n = F.sum("c").over(Window.partitionBy())
    placed = by.select(column, "c", F.coalesce(before, F.lit(0)).alias("start"), n.alias("n"))
    end = F.col("start") + F.col("c")
    parts = placed.select(column, "n", end.alias("end"), F.explode(F.sequence(F.col("start"), end - 1, F.lit(STRETCH).cast("long"))).alias("a"))
    at = parts.select(column, "n", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + STRETCH, F.col("end")) - 1)).alias("i"))
    return at.select(column, F.round(F.col("i") / F.nullif(F.col("n") - 1, F.lit(0)), digits).alias("y"))


def cdf_display_limit(df: DataFrame, column: str = "token_len") -> DataFrame:
    """Marks the points that a plot cut at the 99.5th percentile shows; none is dropped."""
    cut = token_stats(df, column, 12).select(F.col("p99_5").alias("cut"))
    return token_cdf(df, column).crossJoin(F.broadcast(cut)).withColumn("shown", F.col(column).between(0, F.col("cut")))
