"""Equivalent functions: keys, groups, positives and components.

Positives link all rows that share a key, so a component is a group and no
iterative graph algorithm is needed. A null in either key keeps a row alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.functions.joins import lookup_join

KEY = ["source_binary_name", "function_name"]


def normalize_file_name(df: DataFrame) -> DataFrame:
    return df.withColumn("source_binary_name", X.source_binary_name(F.col("file_name")))


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("original_idx", *KEY).filter(F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull())


def function_groups(df: DataFrame) -> DataFrame:
    return _keyed(df).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def multi_member_groups(df: DataFrame) -> DataFrame:
    return function_groups(df).filter("n > 1")


def positive_pairs(df: DataFrame) -> DataFrame:
    """Every unordered pair inside a group. The output is quadratic by definition;
    sampling goes through group ranks instead and never builds it."""
    a = _keyed(df).withColumnRenamed("original_idx", "idx1")
    b = _keyed(df).withColumnRenamed("original_idx", "idx2")
    return a.join(b, KEY).filter("idx1 < idx2").select("idx1", "idx2")


def positive_map(df: DataFrame) -> DataFrame:
    """Per anchor the other members, ascending: (original_idx, positives)."""
    members = F.collect_list("original_idx").over(Window.partitionBy(*KEY))
    lists = _keyed(df).withColumn("m", members).filter(F.size("m") > 1)
    return lists.select("original_idx", F.array_remove(F.array_sort("m"), F.col("original_idx")).alias("positives"))


def components(df: DataFrame) -> DataFrame:
    """(original_idx, group_id): the smallest index of the group, rows without a key alone.

    The minimum is a partial aggregate joined back under a salt; a window would hold
    a whole group in one task, and rows without metadata make one very large group.
    """
    firsts = _keyed(df).groupBy(*KEY).agg(F.min("original_idx").alias("first"))
    rows = lookup_join(df.select("original_idx", *KEY), firsts, KEY, "original_idx")
    return rows.select("original_idx", F.coalesce("first", "original_idx").alias("group_id"))
