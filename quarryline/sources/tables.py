"""Columnar scans, the declared JSONL scan and the partitioned sinks.

All paths go through Spark's readers and writers, so any Hadoop file system works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A raw record: the function's text and where it came from. Either may be null.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType(
                [T.StructField("file_name", T.StringType()), T.StructField("function_name", T.StringType())]
            ),
        ),
    ]
)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``base``."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """JSON lines under a declared schema; a malformed line fails the read.

    ``extra`` adds further top-level columns, which pass through every later step.
    """
    schema = T.StructType(RAW_SCHEMA.fields + (extra.fields if extra is not None else []))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_row_index(df: DataFrame, name: str = "original_idx") -> DataFrame:
    """Adds a dense row number in the order of the input's partitions, without a shuffle.

    Rows are counted per partition; the offsets, one row per partition, are broadcast
    and added to each row's place in its own. Rows have no position in Spark, so write
    the result before using it twice: the number is only as stable as the scan's splits.
    """
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + inside).alias(name))


def write_processed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The processed functions as parquet."""
    df.write.mode(mode).parquet(path)


def write_pools(pool: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One dataset for all splits; readers of one split prune the others."""
    pool.write.mode(mode).partitionBy("split").parquet(path)


def read_pool(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split)
