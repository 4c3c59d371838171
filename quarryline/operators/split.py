"""Leakage-free split of whole groups, dense numbering per split, translated maps.

Global ranks come from two levels: counts per hash bucket give offsets over 4,096
rows, and ranks inside a bucket are a partitioned window. No task sees all groups.
The offsets of hash buckets, 4,096 a split, are broadcast: the hash's prefix bounds them.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators import grouping
from quarryline.sources.staging import materialize


#: Original indices that one window over a group's rows may hold.
STRETCH = 1 << 16


def check_ratio(ratio: float) -> float:
    if not 0.1 <= ratio <= 0.99:
        raise ValueError("the ratio must lie between 0.1 and 0.99")
    return float(ratio)


def _offsets(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Sum of ``weight`` before each bucket; the window runs over buckets alone."""
    sums = df.groupBy(*keys, "bucket").agg(F.sum(weight).alias("s"))
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "bucket", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("before"))


def group_ranks(members: DataFrame, seed: int = 42) -> DataFrame:
    """(group_id, size, h, bucket, rank0): groups in the order of a seeded hash."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id").cast("string")))
    groups = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    groups = groups.withColumns({"h": h, "one": F.lit(1)}).withColumn("bucket", F.substring("h", 1, 3))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "group_id")) - 1
    placed = groups.withColumn("inside", inside).join(F.broadcast(_offsets(groups, [], "one")), "bucket")
    return placed.select("group_id", "size", "h", "bucket", (F.col("before") + F.col("inside")).alias("rank0"))


def exact_ranks(spark: SparkSession, members: DataFrame, seed: int = 42) -> DataFrame:
    """(group_id, rank0) by a seeded permutation of the ascending groups.

    The permutation is made on the driver, so it needs one integer per group there;
    use ``group_ranks`` where that is too many.
    """
    ids = [r[0] for r in members.select("group_id").distinct().orderBy("group_id").toLocalIterator()]
    random.Random(seed).shuffle(ids)
    return spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "group_id long, rank0 long")


def group_split(members: DataFrame, ratio: float = 0.9, seed: int = 42, ranks: DataFrame | None = None) -> DataFrame:
    """(group_id, rank0, size, bucket, h, split): the first floor(n * ratio) groups train."""
    ranked = group_ranks(members, seed)
    if ranks is not None:
        ranked = ranked.drop("rank0").join(ranks, "group_id")
    n = ranked.agg(F.count(F.lit(1)).alias("n_groups"))
    cut = F.floor(F.col("n_groups").cast("double") * F.lit(check_ratio(ratio)).cast("double"))
    both = ranked.crossJoin(F.broadcast(n))
    return both.withColumn("split", F.when(F.col("rank0") < cut, "train").otherwise("validation")).drop("n_groups")


def reindex(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(split, new_idx, original_idx, group_id, group_start, size); dense from 0 per split.

    Rows of a group are neighbours, in the order of group rank, then original index.
    The rank inside a group has two levels too: original indices are dense, so a
    stretch of ``STRETCH`` of them bounds what one window holds of a large group.
    """
    w = Window.partitionBy("split", "bucket").orderBy("rank0").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("run", F.coalesce(F.sum("size").over(w), F.lit(0)))
    starts = placed.join(F.broadcast(_offsets(groups, ["split"], "size")), ["split", "bucket"])
    starts = starts.select("group_id", "split", "size", (F.col("before") + F.col("run")).alias("group_start"))
    parts = members.withColumns({"bucket": F.floor(F.col("original_idx") / STRETCH), "one": F.lit(1)})
    before = _offsets(parts, ["group_id"], "one").join(starts, "group_id")
    inside = F.row_number().over(Window.partitionBy("group_id", "bucket").orderBy("original_idx")) - 1
    rows = parts.withColumn("inside", inside).join(before, ["group_id", "bucket"])
    new_idx = F.col("group_start") + F.col("before") + F.col("inside")
    return rows.select("split", new_idx.alias("new_idx"), "original_idx", "group_id", "group_start", "size")


def translate_map(index: DataFrame) -> DataFrame:
    """(split, anchor, positives) in new numbers; anchors left without positives go.

    A group is a range of new numbers within one split, so its members follow without a
    join. The lists are quadratic in a group's size by definition; (group_start, size)
    in the index says the same in two numbers.
    """
    members = F.sequence(F.col("group_start"), F.col("group_start") + F.col("size") - 1)
    rows = index.filter("size > 1").select("split", F.col("new_idx").alias("anchor"), members.alias("members"))
    return rows.select("split", "anchor", F.array_remove("members", F.col("anchor")).alias("positives"))


def split_summary(index: DataFrame) -> DataFrame:
    """Rows, groups and anchors per split."""
    return index.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("groups"), F.count_if(F.col("size") > 1).alias("anchors")
    )


def split_disjoint(index: DataFrame) -> DataFrame:
    """The number of groups in more than one split, which has to be 0."""
    by = index.groupBy("group_id").agg(F.countDistinct("split").alias("k"))
    return by.agg(F.count_if(F.col("k") > 1).alias("overlap"))


def pools(functions: DataFrame, index: DataFrame) -> DataFrame:
    """The functions with their split and new index, ready for the partitioned sink."""
    return functions.join(index.select("split", "new_idx", "original_idx"), "original_idx")


def split_dataset(functions: DataFrame, ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """The index of a whole pool: see ``reindex``. Members and groups, a few numbers a row,
    are written once, since the ranks and offsets read them several times."""
    members = materialize(grouping.components(grouping.normalize_file_name(functions)))
    return reindex(members, materialize(group_split(members, ratio, seed)))
