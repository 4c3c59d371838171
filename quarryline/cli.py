"""Commands: ``preprocess``, ``split`` and ``triplets``, for spark-submit or ``python -m``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import preprocess, split, stats, triplets
from quarryline.sources import staging, tables


def run_preprocess(spark: SparkSession, source: str, target: str, counter=None, mode: str = "errorifexists") -> dict[str, DataFrame]:
    """JSONL to processed parquet; returns the filter summary, statistics and CDF points."""
    raw = tables.read_jsonl(spark, source)
    kept = staging.materialize(preprocess.preprocess(raw, counter))  # the tokenizer runs once, and the numbers stand on what is written
    tables.write_processed(tables.with_row_index(kept), target, mode)
    staging.discard(kept)
    done = spark.read.parquet(target)
    return {"summary": preprocess.filter_summary(raw), "stats": stats.token_stats(done), "cdf": stats.token_cdf(done)}


def run_split(spark: SparkSession, source: str, target: str, ratio: float = 0.9, seed: int = 42, mode: str = "errorifexists", lists: bool = True) -> DataFrame:
    """Processed functions to pools, index and positive maps, partitioned by split; returns the summary.

    The maps are quadratic in a group's size; without ``lists`` the index, which has each
    group's start and size, stands for them.
    """
    functions = spark.read.parquet(source)
    index = staging.materialize(split.split_dataset(functions, split.check_ratio(ratio), seed))
    tables.write_pools(split.pools(functions, index), f"{target}/pool", mode)
    if lists:
        tables.write_pools(split.translate_map(index), f"{target}/positive_map", mode)
    tables.write_pools(index, f"{target}/index", mode)
    return split.split_summary(index)


def run_triplets(spark: SparkSession, source: str, target: str, seed: int = 42, epoch: int = 0, mode: str = "errorifexists") -> None:
    """The pools' texts as one epoch of triplets, partitioned by split."""
    index = spark.read.parquet(f"{source}/index")
    made = triplets.triplet_texts(triplets.triplet_sample(index, seed, epoch), spark.read.parquet(f"{source}/pool"))
    tables.write_pools(made.withColumn("epoch", F.lit(epoch)), target, mode)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarryline")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("preprocess", "split", "triplets"):
        command = commands.add_parser(name)
        command.add_argument("source")
        command.add_argument("target")
        command.add_argument("--overwrite", action="store_true")
        if name != "preprocess":
            command.add_argument("--seed", type=int, default=42)
        if name == "split":
            command.add_argument("--ratio", type=float, default=0.9)
            command.add_argument("--no-lists", action="store_true", help="write no positive maps; the index has each group's start and size")
        if name == "triplets":
            command.add_argument("--epoch", type=int, default=0)
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"quarryline-{given.command}").getOrCreate()
    mode = "overwrite" if given.overwrite else "errorifexists"
    if given.command == "preprocess":
        for name, df in run_preprocess(spark, given.source, given.target, mode=mode).items():
            if name != "cdf":
                df.show()
    elif given.command == "split":
        run_split(spark, given.source, given.target, given.ratio, given.seed, mode, not given.no_lists).show()
    else:
        run_triplets(spark, given.source, given.target, given.seed, given.epoch, mode)


if __name__ == "__main__":
    main()
