"""The folder that driver and executors share, and files in it through Hadoop's file system classes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only on one machine, where it may be unset, is one made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, a lost executor costs its own tasks."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    at, system = _file(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    at, system = _file(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under another name and rename it; False if the name is taken by then. Readers see all of it or nothing."""
    at, system = _file(spark, path)
    temporary, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(temporary)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.exists(at) and system.rename(temporary, at):
        return True
    system.delete(temporary, False)
    return False


def delete(spark: SparkSession, path: str) -> None:
    at, system = _file(spark, path)
    system.delete(at, True)
