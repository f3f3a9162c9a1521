"""Lecture-shaped views of the given tables: timed words, slide intervals, frame signals and image hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript words: job_id, segment_id, word_pos, word and integer milliseconds."""
    split = F.split(F.trim(F.col("text"), F.lit(" \n")), r"\s+")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("segment_id"), F.posexplode(split).alias("word_pos", "word"))
    start = 400 * (F.row_number().over(Window.partitionBy("job_id").orderBy("segment_id", "word_pos")).cast("long") - 1)
    rows = rows.withColumn("start_ms", start)
    return rows.withColumn("end_ms", F.col("start_ms") + 300).withColumn("mid_ms", F.col("start_ms") + 150)


def occurrences(timed: DataFrame) -> DataFrame:
    """Ten-second slide appearances over the words' time line, with slides that come back; every 7th left out."""
    frames = timed.groupBy("job_id").agg(F.expr("(3 * (max(start_ms) + 400) + 999) DIV 1000").alias("n_frames"))
    blocks = frames.select("job_id", "n_frames", F.explode(F.expr("sequence(0, (n_frames - 1) DIV 30)")).alias("appearance_index"))
    first = F.col("appearance_index") * 30
    rows = blocks.select("job_id", "appearance_index", (F.col("appearance_index") % 5 + 1).alias("slide_id"), first.alias("start_frame"), F.least(first + 29, F.col("n_frames") - 1).alias("end_frame"))
    return rows.where(F.col("appearance_index") % 7 != 6)


def _edge() -> Column:
    return F.when(F.col("event_type") == "click", 0.0).when(F.col("event_type") == "view", 0.25).when(F.col("event_type") == "signup", 0.5).when(F.col("event_type") == "purchase", 0.75).otherwise(1.0)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four surrogate features a frame, from events: job_id, frame_index, pixel, edge, hist, struct_."""
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), index.alias("frame_index"), (F.col("value") / F.lit(500.0)).alias("pixel"), _edge().alias("edge"),
        (F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)).alias("hist"), (F.hour("ts") / F.lit(24.0)).alias("struct_"),
    )


def long_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features of all events as one lecture, numbered in two levels."""
    frames = table(spark, sf_dir, "events").select(
        F.lit(0).cast("long").alias("job_id"), "ts", "event_id", (F.col("value") / F.lit(500.0)).alias("pixel"), _edge().alias("edge"),
        (F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)).alias("hist"), (F.hour("ts") / F.lit(24.0)).alias("struct_"),
    )
    return series.positions(frames, ["ts", "event_id"], "frame_index").drop("ts", "event_id")


def planted_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes with a changed copy of each vector: three values turned round, brightened, dimmed, or all turned round."""
    rows = hashes(spark, sf_dir).select("id", "v")
    kind = F.col("id") % 4
    changed = F.transform("v", lambda x, i: F.when(kind == 0, F.when((i + F.col("id")) % 21 == 0, -x).otherwise(x)).when(kind == 1, x * 1.01).when(kind == 2, x * 0.5).otherwise(-x))
    return _hashed(rows.unionByName(rows.withColumn("v", changed).withColumn("id", F.col("id") + 1_000_000)))


def _hashed(rows: DataFrame) -> DataFrame:
    bits = F.aggregate(F.transform("v", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.expr("0L"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))
    return rows.withColumn("phash", bits)


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit sign hashes of the vectors: id, phash, v."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return _hashed(rows)
