"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import bpe, embeddings, langid, lines, quality, secrets, simhash, substring, urlfilter, winnow
from quarryline.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(read_table(spark, sf_dir, "documents"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"))


@query
def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(read_table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_substring"] = substring.SQL


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op3_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read_table(spark, sf_dir, "pages"))


ORACLE_SQL["op3_url_trie"] = urlfilter.SQL


@query
def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op4_embeddings"] = embeddings.SQL


@query
def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read_table(spark, sf_dir, "documents"))


ORACLE_SQL["op5_line_frequency"] = lines.SQL


@query
def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination_digests(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op6_winnow"] = winnow.SQL


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_predictions(read_table(spark, sf_dir, "documents"))
