"""Instruction prefix and fixed-length token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import expressions as X

# The instruction and the sequence length of the reference configuration.
INSTRUCTION = "Represent this LLVM IR for searching for similar functions:"
MAX_LENGTH = 2048
ROLES = ("anchor", "positive", "negative")


def instruction_prefix(df: DataFrame, column: str = "text", instruction: str = INSTRUCTION) -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(instruction), F.col(column)))


def truncate_pad(df: DataFrame, ids: str = "ids", length: int = MAX_LENGTH, pad_id: int = 0, prefix: str = "") -> DataFrame:
    """Replaces ``ids`` by arrays of exactly ``length``: input_ids and attention_mask."""
    return df.withColumns(
        {f"{prefix}input_ids": X.fit_length(F.col(ids), length, pad_id), f"{prefix}attention_mask": X.fit_mask(F.col(ids), length)}
    ).drop(ids)


def collate(triplets: DataFrame, encode, instruction: str = INSTRUCTION, length: int = MAX_LENGTH, pad_id: int = 0) -> DataFrame:
    """Six arrays per triplet; ``encode`` is an Arrow UDF from text to token ids."""
    out = triplets
    for role in ROLES:
        out = instruction_prefix(out, role, instruction).withColumn(f"{role}_ids", encode(F.col(role)))
        out = truncate_pad(out, f"{role}_ids", length, pad_id, f"{role}_").drop(role)
    return out


def wrong_lengths(df: DataFrame, length: int = MAX_LENGTH, column: str = "input_ids") -> DataFrame:
    """How many arrays do not have the fixed length, which has to be 0."""
    return df.agg(F.count_if(F.size(column) != length).alias("wrong"))
