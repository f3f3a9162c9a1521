"""Speech to slides: words fall into the appearance that is on screen at their middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import strip

FPS = 3


def occurrence_times(occ: DataFrame, fps: float = FPS) -> DataFrame:
    """Half-open seconds of each appearance; its last frame is inside. A rate that isn't positive raises."""
    if not fps > 0:
        raise ValueError(f"{fps} frames a second")
    start, end = F.col("start_frame") / F.lit(float(fps)), (F.col("end_frame") + 1) / F.lit(float(fps))
    return occ.select("job_id", "slide_id", "appearance_index", F.round(start, 3).alias("start_time"), F.round(end, 3).alias("end_time"))


def timeline_violations(occ: DataFrame) -> DataFrame:
    """Appearances that begin before the one before them ends."""
    last = F.lag("end_frame").over(Window.partitionBy("job_id").orderBy("start_frame", "end_frame", "slide_id"))
    return occ.withColumn("before", last).where(F.col("start_frame") < F.col("before") + 1).select("job_id", "appearance_index", "before")


def link_words(words: DataFrame, occ: DataFrame, bin_frames: int = 300) -> DataFrame:
    """Point-in-interval join. Time bins join the equi-key, so a long lecture is spread over many tasks."""
    unit = 1000 * bin_frames
    bins = occ.withColumn("bin", F.explode(F.expr(f"sequence((1000L * start_frame) DIV {unit}, (1000L * (end_frame + 1) - 1) DIV {unit})")))
    timed = words.withColumn("bin", F.expr(f"({FPS}L * mid_ms) DIV {unit}"))
    inside = (FPS * F.col("mid_ms") >= 1000 * F.col("start_frame")) & (FPS * F.col("mid_ms") < 1000 * (F.col("end_frame") + 1))
    return timed.join(bins, ["job_id", "bin"]).where(inside).drop("bin")


def link_words_asof(words: DataFrame, occ: DataFrame) -> DataFrame:
    """The same rows by the last appearance to begin; appearances do not overlap."""
    shape = "struct(slide_id, appearance_index, start_frame, end_frame)"
    left = words.select("job_id", (FPS * F.col("mid_ms")).alias("t"), F.lit(1).alias("kind"), F.struct("segment_id", "word_pos", "word", "start_ms", "end_ms", "mid_ms").alias("w"), F.lit(None).cast("struct<slide_id:bigint,appearance_index:bigint,start_frame:bigint,end_frame:bigint>").alias("o"))
    right = occ.select("job_id", (1000 * F.col("start_frame")).cast("long").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast(left.schema["w"].dataType).alias("w"), F.expr(shape).cast(left.schema["o"].dataType).alias("o"))
    last = F.last("o", ignorenulls=True).over(Window.partitionBy("job_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = left.unionByName(right).withColumn("on", last).where((F.col("kind") == 1) & F.col("on").isNotNull())
    return found.where(F.col("t") < 1000 * (F.col("on.end_frame") + 1)).select("job_id", "w.*", "on.*")


def _in_order(key: list[str], text: str):
    """Texts joined by spaces in the order of key."""
    rows = F.array_sort(F.collect_list(F.struct(*key, F.col(text).alias("__t"))))
    return F.array_join(F.transform(rows, lambda x: x["__t"]), " ")


def linked_segments(linked: DataFrame) -> DataFrame:
    """One row per transcript segment and appearance: bounds and words in order of their start."""
    return linked.groupBy("job_id", "slide_id", "appearance_index", "segment_id").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "word_pos")).alias("end_ms"), _in_order(["start_ms", "word_pos"], "word").alias("text")
    )


def occurrence_speech(occ: DataFrame, segments: DataFrame) -> DataFrame:
    """Every appearance with what is said during it; silent ones stay, with an empty text."""
    said = segments.groupBy("job_id", "slide_id", "appearance_index").agg(_in_order(["segment_id"], "text").alias("said"))
    return occ.join(said, ["job_id", "slide_id", "appearance_index"], "left").select("job_id", "slide_id", "appearance_index", "start_frame", F.coalesce("said", F.lit("")).alias("speech_text"))


def slide_speech(speech: DataFrame) -> DataFrame:
    """Every slide with the texts of its appearances in order, empty ones skipped."""
    said = F.array_sort(F.collect_list(F.when(F.col("speech_text") != "", F.struct("start_frame", "appearance_index", "speech_text"))))
    return speech.groupBy("job_id", "slide_id").agg(F.array_join(F.transform(said, lambda x: x["speech_text"]), " ").alias("speech_text"), F.count(F.lit(1)).alias("n_occurrences"))


def word_faults(words: DataFrame) -> DataFrame:
    """Words that can't be linked, and why: a missing part, or an end before the start."""
    missing = F.col("word").isNull() | F.col("start_ms").isNull() | F.col("end_ms").isNull()
    fault = F.when(missing, "missing").when(F.col("end_ms") < F.col("start_ms"), "order")
    return words.withColumn("fault", fault).where("fault is not null").select("job_id", "segment_id", "word_pos", "fault")


def occurrence_faults(occ: DataFrame) -> DataFrame:
    """Appearances that can't be timed, and why."""
    fault = F.when(F.col("slide_id").isNull(), "slide").when(F.col("start_frame") < 0, "start").when(F.col("end_frame") < F.col("start_frame"), "order")
    return occ.withColumn("fault", fault).where("fault is not null").select("job_id", "appearance_index", "fault")


def stored_segments(segments: DataFrame) -> DataFrame:
    """Segments with a text that isn't blank."""
    return segments.where(strip(F.coalesce("text", F.lit(""))) != "")


def linked_slides(slides: DataFrame, speech: DataFrame) -> DataFrame:
    """Every slide, also one without appearances, with its text, its appearances in order and their number."""
    of = F.array_sort(F.collect_list(F.struct("start_frame", "appearance_index")))
    shown = speech.groupBy("job_id", "slide_id").agg(F.array_join(F.transform(of, lambda x: x["appearance_index"].cast("string")), ",").alias("shown"))
    joined = slides.join(shown, ["job_id", "slide_id"], "left").join(slide_speech(speech), ["job_id", "slide_id"], "left")
    return joined.select("job_id", "slide_id", F.coalesce("speech_text", F.lit("")).alias("speech_text"), F.coalesce("shown", F.lit("")).alias("shown"), F.coalesce("n_occurrences", F.lit(0)).alias("n_occurrences"))


def numbered_result(slides: DataFrame) -> DataFrame:
    """Slides that have a path, with the numbers they had before the others were left out."""
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("slide_id"))
    return slides.withColumn("slide_number", number).where("path is not null").select("job_id", "slide_number", "path")
