"""A view in the shape of the function records, derived from ``documents``.

The same expressions run in Spark and in DuckDB, so both sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.tables import read_table

_OPT = "case doc_id % 5 when 0 then 'O0' when 1 then 'O1' when 2 then 'O2' when 3 then 'O3' else 'Os' end"
_COLUMNS = {
    "original_idx": "doc_id",
    "text": "concat('define void @f', cast(doc_id as string), '() {', chr(10), text, chr(10), '}')",
    "file_name": f"case when doc_id % 97 = 0 then null else concat('lib-', source, '.so-', {_OPT}, '-', md5(cast(doc_id as string)), '_functions') end",
    "function_name": "case when doc_id % 89 = 0 then null else concat(lang, '_', cast(doc_id % 3 as string)) end",
}
FUNCTIONS_SQL = "select " + ", ".join(f"{v} as {k}" for k, v in _COLUMNS.items()) + " from documents"


def functions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr(*[f"{v} as {k}" for k, v in _COLUMNS.items()])


def raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as raw records: every 13th without metadata, others with null fields."""
    f = functions_view(spark, sf_dir)
    both = F.struct("file_name", "function_name")
    return f.select("original_idx", "text", F.when(F.col("original_idx") % 13 != 0, both).alias("metadata"))
