"""Folders that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def top(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset and everything runs in one process, as in
    tests, a temporary one; on a cluster without it, an error."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='checkpoint-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI there."""
    at = top(spark)
    return f"{at if ':' in at else 'file://' + at}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing holds any longer. The first round tells the JVM which of its objects
    Python has let go, the second lets it collect what they held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def written_to(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame, written to a new shared folder and read again, so that its lineage ends there; and the folder."""
    spark, at, schema = frame.sparkSession, folder(frame.sparkSession, name), frame.schema
    frame.write.parquet(at)
    return spark.read.schema(schema).parquet(at), at


def written(frame: DataFrame, name: str) -> DataFrame:
    return written_to(frame, name)[0]


def deleted(spark: SparkSession, at: str) -> None:
    """Deletes a folder that written_to() made and nothing reads any longer."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(at if "://" in at else at.replace("file:", "file://"))
    if files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_dir(path)
