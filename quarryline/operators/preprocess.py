"""Row filters, metadata extraction and token lengths.

Each function maps a DataFrame to a DataFrame without a shuffle, apart from the
one-row summary, which is a single partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import expressions as X


def is_long_enough(text: Column, min_body_lines: int = 3) -> Column:
    """True for more than ``min_body_lines`` non-blank body lines; false for null."""
    return F.coalesce(X.body_lines(text) > min_body_lines, F.lit(False))


def short_function_filter(df: DataFrame, min_body_lines: int = 3) -> DataFrame:
    return df.filter(is_long_enough(F.col("text"), min_body_lines))


def filter_summary(df: DataFrame, min_body_lines: int = 3) -> DataFrame:
    """Rows in all, kept and removed, in one pass."""
    keep = is_long_enough(F.col("text"), min_body_lines)
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("removed")
    )


def metadata_extract(df: DataFrame) -> DataFrame:
    """Lifts both fields out of ``metadata`` and drops it.

    A null struct gives empty strings; a null field of a present struct stays null.
    """
    missing = F.col("metadata").isNull()
    return df.withColumns(
        {n: F.when(missing, F.lit("")).otherwise(F.col(f"metadata.{n}")) for n in ("file_name", "function_name")}
    ).drop("metadata")


def with_token_len(df: DataFrame, counter=None) -> DataFrame:
    """Adds ``token_len``; ``counter`` is an Arrow UDF of the text, else the proxy counts."""
    length = X.proxy_token_len(F.col("text")) if counter is None else counter(F.col("text"))
    return df.withColumn("token_len", length)


def valid_token_filter(df: DataFrame) -> DataFrame:
    return df.filter(F.col("token_len") != -1)


def text_preview(df: DataFrame, length: int = 50) -> DataFrame:
    return df.withColumn("preview", F.substring("text", 1, length)).drop("text")


def preprocess(raw: DataFrame, counter=None, min_body_lines: int = 3) -> DataFrame:
    """Filter, lengths and metadata in the order in which the cheap filter runs first."""
    kept = short_function_filter(raw, min_body_lines)
    return valid_token_filter(with_token_len(metadata_extract(kept), counter))
