"""What several operators share: the scratch folder, materialising, batch bounds and the held-out fold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that go to Python hold at most so many rows and bytes, so that a task's memory does not depend on the longest texts.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only on one machine, where it may be unset, is one made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Shuffle files go at the end of the job that made them.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    It cuts the lineage: a lost executor costs its own running tasks and nothing before them. The shuffle files of the job
    go when it ends (from Spark 4.1 on), not when the driver happens to collect its garbage.
    """
    path, conf = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(_FREED, None)
    conf.set(_FREED, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.unset(_FREED) if before is None else conf.set(_FREED, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in stashed:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: At most so many keys of a join are hot: those with more than one in so many of its rows.
HOT_KEYS = 1024


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows (a stored table of `total` rows) joined to keys (unique in `on`, n: their rows) on these columns; n is dropped.

    Keys with more than one in HOT_KEYS of all rows, so HOT_KEYS of them at most, are broadcast, and their rows stay in place;
    all others meet in a shuffle join.
    """
    hot = keys.where(F.col("n") > total / HOT_KEYS).drop("n")
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.where(F.col("n") <= total / HOT_KEYS).drop("n"), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def join_apart(made: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """made (rows as Python left them) joined to keys on these columns by a shuffle, never by a broadcast.

    What Python does with the joined rows is then in a stage of its own. Two Python operators in one stage would take two
    workers a core, all of which an executor keeps.
    """
    return made.join(keys.hint("merge"), on)


def fresh(name: str, columns: list[str]) -> str:
    """name, or name with underscores before it until no column is called so (as Spark compares names)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bound_batches(spark: SparkSession) -> None:
    """The same bounds for every operator, so that frames built earlier run with the bounds they were built for."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(key: Column) -> Column:
    """True for the fifth of the keys no model learns from; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_KEPT: dict[str, list] = {}


def claim(owner: str, *kept: dict) -> None:
    """Dictionaries a worker keeps from task to task for one operator; those of all other operators are emptied."""
    for name, others in list(_KEPT.items()):
        if name != owner:
            for d in others:
                d.clear()
            del _KEPT[name]
    _KEPT[owner] = list(kept)
