"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder below spark.checkpoint.dir. Only a local session, as in tests, may do without
    the setting: there a folder of our own takes its place."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as parquet in the shared folder and reads it back.

    For tables that several later steps use, or whose shuffles are to go: they are computed
    once, their lineage is cut, and a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables made by ``materialize``. Nothing that is still to run may read them;
    what was derived from them has to be written first."""
    for table in tables:
        path = getattr(table, "__dict__", {}).get("_staged_at")
        if path is not None:
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, on whatever file system Spark finds it."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
