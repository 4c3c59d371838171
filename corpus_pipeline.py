"""The corpus pipeline: five operators in a row over the documents table.

Each stage takes the session, what its predecessor kept and the folder of the
tables, and returns a DataFrame; all but the last return the columns of documents.
``run`` writes what each stage returns as parquet in the shared folder and reads
it again, so a lost executor costs one stage's tasks and no stage holds another's
shuffles. Null texts and ids, repeated rows, empty tables and further columns are
treated as each operator's docstring says; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bpe, lines, quality, simhash, winnow
from quarryline.llm.common import discard, free_shuffles, read_table, stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; the documents stay."""
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any window of a benchmark item go."""
    return winnow.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document left."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        made = function(spark, out, sf_dir)
        if name != STAGES[-1][0]:
            made = stage(made)
            discard(out)  # nothing reads a stage once its successor is written
            free_shuffles(spark)
        out = made
    return out
