"""Transcripts and linked lectures as JSON: what has a wrong type becomes a fault row and never ends the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_text


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """name, doc (variant), fault: each file under path is a document, or each line of its files. A path that isn't there raises.

    fault tells what isn't JSON (`syntax`) or isn't an object (`shape`); doc is null then. Files of no bytes give no rows, as Spark
    passes over them.
    """
    text = spark.read.text(path, wholetext=not lines).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("name"), "value")
    parsed = text.withColumn("doc", F.try_parse_json("value"))
    fault = F.when(F.col("doc").isNull(), "syntax").when(~_is_object(F.col("doc")), "shape")
    return parsed.select("name", F.when(fault.isNull(), F.col("doc")).alias("doc"), fault.alias("fault"))


def strict(documents: DataFrame) -> DataFrame:
    """The same rows; a document with a fault ends the job."""
    wrong = F.raise_error(F.concat(F.lit("not a JSON object: "), "name")).cast("string")
    return documents.withColumn("fault", F.when(F.col("fault").isNotNull(), wrong))


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def segments(documents: DataFrame) -> DataFrame:
    """job_id, seg_pos, segment_id, segment (variant), fault: of documents (job_id, doc); lists that aren't ones have no segments."""
    each = documents.select("job_id", F.posexplode(_items(F.col("doc"), "$.segments")).alias("seg_pos", "segment"))
    fault = F.when(~_is_object(F.col("segment")), "segment").when(_items(F.col("segment"), "$.words").isNull() & F.try_variant_get("segment", "$.words", "variant").isNotNull(), "words")
    return each.select("job_id", "seg_pos", F.try_variant_get("segment", "$.id", "bigint").alias("segment_id"), "segment", fault.alias("fault"))


def words(documents: DataFrame) -> DataFrame:
    """job_id, seg_pos, segment_id, word_pos, word, start, end, fault: every item of the segments' word lists.

    fault: `object` (isn't one), `missing` (a word without start, end or word), `number` (a time that isn't one), `order` (an
    end before the start); null for words that can be linked. Numbers written as strings count, and so do words written as numbers.
    """
    listed = segments(documents).where("fault IS NULL").select("job_id", "seg_pos", "segment_id", F.posexplode(_items(F.col("segment"), "$.words")).alias("word_pos", "w"))
    has = lambda key: F.try_variant_get("w", f"$.{key}", "variant").isNotNull()
    start, end = (F.try_variant_get("w", f"$.{key}", "double") for key in ("start", "end"))
    fault = F.when(~_is_object(F.col("w")), "object").when(~(has("start") & has("end") & has("word")), "missing").when(start.isNull() | end.isNull(), "number").when(end < start, "order")
    return listed.select("job_id", "seg_pos", "segment_id", "word_pos", clean_text(F.try_variant_get("w", "$.word", "string")).alias("word"), start.alias("start"), end.alias("end"), fault.alias("fault"))


def linked_documents(slides: DataFrame, occurrences: DataFrame, linked: DataFrame, fps: float = 3.0) -> DataFrame:
    """job_id, doc (JSON text): each lecture with its slides, their occurrences, segments and words, in order, times to three places.

    slides: job_id, slide_id, representative_path, speech_text; occurrences: job_id, slide_id, appearance_index, start_frame,
    end_frame, start_time, end_time, speech_text; linked: job_id, slide_id, appearance_index, seg_pos, segment_id, word_pos, word,
    start, end. A lecture's rows meet in one row, since its document is one; slides without occurrences have an empty list.
    """
    nested = lambda order, *cols: F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("key"), F.struct(*cols).alias("item")))), lambda x: x["item"])
    time = lambda c: F.round(c, 3).alias(c)
    word = F.struct("start", "word_pos")
    said = linked.groupBy("job_id", "slide_id", "appearance_index", "seg_pos", "segment_id").agg(
        F.round(F.min("start"), 3).alias("start"), F.round(F.max_by("end", word), 3).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "word_pos", "word"))), lambda x: x["word"]), " ").alias("text"),
        nested(["start", "word_pos"], "word", time("start"), time("end")).alias("words"),
    )
    said = said.groupBy("job_id", "slide_id", "appearance_index").agg(nested(["seg_pos"], "segment_id", "start", "end", "text", "words").alias("speech_segments"))
    none = lambda c, like: F.coalesce(c, F.from_json(F.lit("[]"), like))
    shown = occurrences.join(said, ["job_id", "slide_id", "appearance_index"], "left").withColumn("speech_segments", none("speech_segments", said.schema["speech_segments"].dataType))
    shown = shown.groupBy("job_id", "slide_id").agg(nested(["start_time", "end_time"], "appearance_index", "start_frame", "end_frame", time("start_time"), time("end_time"), "speech_text", "speech_segments").alias("occurrences"))
    every = slides.join(shown, ["job_id", "slide_id"], "left").withColumn("occurrences", none("occurrences", shown.schema["occurrences"].dataType))
    whole = every.groupBy("job_id").agg(F.sum(F.size("occurrences")).alias("appearance_count"), nested(["slide_id"], "slide_id", "representative_path", "speech_text", "occurrences").alias("slides"))
    return whole.select("job_id", F.to_json(F.struct("job_id", F.lit(fps).alias("fps"), F.size("slides").alias("slide_count"), "appearance_count", "slides"), {"ignoreNullFields": "false"}).alias("doc"))


def write_documents(documents: DataFrame, path: str) -> None:
    """A JSON document a line, UTF-8 as it is."""
    documents.select("doc").write.text(path)
