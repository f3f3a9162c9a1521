"""Tables by job: replace, upsert, partial update, and the stored tables of processed lectures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import strip
from ..sources import shared
from . import search
from .tables import Store, key_id

#: Key columns of a library's tables; the index's four are among them.
TABLES = {"jobs": "job_id", "slides": "job_id", "slide_occurrences": "job_id", "speech_segments": "job_id"} | search.INDEX
#: Tables whose rows go with their job.
CHILDREN = ("slides", "slide_occurrences", "speech_segments")


def replace_job(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new, and those rows of old whose job is not in new."""
    return old.join(new.select("job_id").distinct(), "job_id", "left_anti").unionByName(new, allowMissingColumns=True)


def _one_each(rows: DataFrame) -> DataFrame:
    """One row a job: of several the last in the order of their other columns, nulls first."""
    order = Window.partitionBy("job_id").orderBy(*[F.col(c).desc_nulls_last() for c in rows.columns if c != "job_id"] or [F.lit(0)])
    place = next(n for n in ("place", "place_", "place__") if n not in rows.columns)
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)


def update_columns(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Known columns take the new values, null too; unknown columns and jobs are ignored. A job met twice counts once (_one_each)."""
    known = [c for c in metrics.columns if c in jobs.columns and c != "job_id"]
    if not known:
        return jobs
    new = _one_each(metrics.select("job_id", *known)).select("job_id", F.struct(*known).alias("new")).alias("n")
    joined = jobs.alias("j").join(new, F.col("j.job_id") == F.col("n.job_id"), "left")
    return joined.select(*[F.when(F.col("n.new").isNotNull(), F.col("n.new")[c]).otherwise(F.col(f"j.`{c}`")).alias(c) if c in known else F.col(f"j.`{c}`") for c in jobs.columns])


def upsert_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new in place of those of the same job; their columns that new doesn't have are null. A job met twice counts once."""
    new = _one_each(new)
    return jobs.join(new.select("job_id"), "job_id", "left_anti").unionByName(new, allowMissingColumns=True)


def survivors(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of jobs that aren't deleted."""
    return rows.join(deleted.select("job_id").distinct(), "job_id", "left_anti")


def add_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with these columns (name: type); those that they lack are null."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def derived_metrics(metrics: DataFrame) -> DataFrame:
    """processing_ratio: total seconds by the lecture's, to four places; null where that isn't known or isn't positive."""
    return metrics.withColumn("processing_ratio", F.when(F.col("duration") > 0, F.round(F.col("total") / F.col("duration"), 4)))


#: The columns of a job's record.
RECORD = (
    "video_size_bytes", "video_duration_sec", "processing_fps", "whisper_model", "device", "download_time_sec", "frame_extraction_time_sec", "slide_detection_time_sec", "pdf_generation_time_sec", "audio_extraction_time_sec", "transcription_time_sec",
    "slide_speech_linking_time_sec", "database_storage_time_sec", "total_processing_time_sec", "frames_extracted", "unique_slides", "slide_appearances", "transcript_segments", "transcript_words", "pdf_size_bytes", "processing_ratio", "peak_memory_mb",
)
_TEXTS, _COUNTS = ("whisper_model", "device"), ("video_size_bytes", "frames_extracted", "unique_slides", "slide_appearances", "transcript_segments", "transcript_words", "pdf_size_bytes")


def job_record(measured: DataFrame) -> DataFrame:
    """job_id and the columns of RECORD; what wasn't measured is null, and columns of other names are left out.

    Unless they are given, the total is the sum of the stages' seconds without the download, null ones as none, and the ratio
    is the total by the lecture's seconds, to four places, where these are known and positive.
    """
    stages = [c for c in RECORD if c.endswith("_time_sec") and not c.startswith(("download", "total")) and c in measured.columns]
    rows = measured
    if "total_processing_time_sec" not in rows.columns:
        rows = rows.withColumn("total_processing_time_sec", sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in stages), F.lit(0.0)))
    if "processing_ratio" not in rows.columns and "video_duration_sec" in rows.columns:
        rows = rows.withColumn("processing_ratio", F.when(F.col("video_duration_sec") > 0, F.round(F.col("total_processing_time_sec") / F.col("video_duration_sec"), 4)))
    kind = lambda c: "string" if c in _TEXTS else "bigint" if c in _COUNTS else "double"
    return rows.select("job_id", *[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind(c)).alias(c) for c in RECORD])


def library(spark: SparkSession, root: str | None = None, buckets: int = 16) -> Store:
    """The stored tables of processed lectures at root, or in a new place of the shared folder."""
    return Store(spark, root or shared.fresh(spark, "library"), TABLES, buckets)


def save_jobs(store: Store, jobs: DataFrame) -> None:
    """Put jobs in, in place of those of the same id: all their old columns, slides, occurrences and segments go.

    Index rows aren't children of a job; they stay until its slides are saved again, and a search joins them to segments.
    """
    seen = store.snapshot()
    rows = shared.stash(_one_each(jobs), "jobs")
    if seen.has("jobs"):
        rows = seen.read("jobs", buckets=[]).unionByName(rows, allowMissingColumns=True)
    gone = rows.select("job_id")
    store.replace(gone, {"jobs": rows} | {t: seen.read(t, buckets=[]) for t in CHILDREN if seen.has(t)}, seen=seen)


def save_linked_slides(store: Store, gone: DataFrame, slides: DataFrame, occurrences: DataFrame, segments: DataFrame) -> None:
    """Linked slides in place of all that was stored for the jobs in `gone` and for their own, with the index, in one commit.

    slides: job_id, slide_id, representative_path, speech_text; occurrences: job_id, slide_id, appearance_index, start_frame,
    end_frame, start_time, end_time, speech_text; segments: job_id, slide_id, appearance_index, segment_id, start_time,
    end_time, text. Texts are stripped, and blank segments aren't stored. Ids are made of the rows' keys, so a job saved
    again has the ids it had; rows with one key (a segment cut twice at one time) share an id.
    """
    slide, shown = key_id(F.lit("slide"), "job_id", "slide_id"), key_id(F.lit("shown"), "job_id", "slide_id", "appearance_index")
    said = key_id(F.lit("said"), "job_id", "slide_id", "appearance_index", "segment_id", "start_time")
    text = lambda c: F.coalesce(c, F.lit(""))
    slides = slides.select(slide.alias("id"), "job_id", "slide_id", "representative_path", text("speech_text").alias("speech_text"))
    occurrences = occurrences.select(shown.alias("id"), "job_id", slide.alias("slide_db_id"), "appearance_index", "start_frame", "end_frame", "start_time", "end_time", text("speech_text").alias("speech_text"))
    segments = segments.withColumn("text", strip(text("text"))).where("text <> ''")
    segments = segments.select(said.alias("id"), "job_id", shown.alias("occurrence_id"), "slide_id", "segment_id", "start_time", "end_time", "text")
    slides, occurrences, segments = (shared.stash(x, "linked") for x in (slides, occurrences, segments))
    jobs = gone.select(F.col(gone.columns[0]).alias("job_id"))
    jobs = shared.stash(jobs.unionByName(slides.select("job_id")).unionByName(occurrences.select("job_id")).unionByName(segments.select("job_id")).distinct(), "replaced")
    seen = store.snapshot()
    new, also = search.index_changes(store, seen, jobs, segments.select("job_id", F.col("id").alias("doc"), "text"))
    store.replace(jobs, new | {"slides": slides, "slide_occurrences": occurrences, "speech_segments": segments}, also, seen)


def search_lecture(store: Store, query: str, job_id, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The earliest `most` segments of a job that have any word of the query (id, text, start_time, end_time, slide_number,
    image_path, rank), and the number of all (total)."""
    hits = search.search_index(store, query, job_id).withColumnRenamed("doc", "id")
    seen = store.snapshot()
    segments = seen.read("speech_segments", job_id).join(hits, "id")
    paths = seen.read("slides", job_id).select("slide_id", F.col("representative_path").alias("image_path"))
    found = segments.join(paths, "slide_id", "left").select("id", "text", "start_time", "end_time", F.col("slide_id").alias("slide_number"), "image_path", "rank")
    return found.orderBy("start_time", "id").limit(most), segments.agg(F.count(F.lit(1)).alias("total"))
