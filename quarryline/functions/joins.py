"""Joins that keep a hot key out of one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, how: str = "left", salts: int = 8) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key.

    A table aggregated by the join's own keys would share their partitioning, and
    then a hot key's rows can't be split. Here each key is copied once per salt and
    the rows take a salt by the hash of ``spread``, so a hot key meets in ``salts``
    tasks, and both sides are plain exchanges that AQE can split further.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
