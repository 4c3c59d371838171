"""Incremental preprocessing: the row-wise steps over newly arrived JSONL files.

Only steps without state run on the stream; groups and splits need the whole pool.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarryline.operators import preprocess
from quarryline.sources.tables import RAW_SCHEMA


def preprocess_stream(spark: SparkSession, source: str, target: str, checkpoint: str, counter=None) -> StreamingQuery:
    """Processes what has arrived under ``source`` and appends it to ``target``."""
    raw = spark.readStream.schema(RAW_SCHEMA).option("mode", "FAILFAST").json(source)
    done = preprocess.preprocess(raw, counter)
    return done.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
