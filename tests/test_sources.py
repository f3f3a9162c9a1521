"""JSON with wrong types, documents there and back, listings of a folder made here."""

import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.sources import listings, transcripts


def test_documents(spark, tmp_path):
    for name, text in {"a": '{"x": 1}', "b": "[1]", "c": "{", "d": " ", "g": "", "e": "null", "f": '"s"'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = transcripts.read_documents(spark, str(tmp_path))
    assert {r["name"]: r["fault"] for r in got.select("name", "fault").collect()} == {"a": None, "b": "shape", "c": "syntax", "d": "syntax", "e": "shape", "f": "shape"}
    with pytest.raises(PySparkException):
        transcripts.strict(got).select("fault").collect()
    with pytest.raises(PySparkException):
        transcripts.read_documents(spark, f"{tmp_path}/none")


def test_words_of_wrong_types(spark, tmp_path):
    good = {"word": " a\tb ", "start": 1, "end": "2.5"}
    docs = [
        {"segments": [{"id": 7, "words": [good, "oops", 5, None, {"start": 1, "end": 2}, {"word": "x", "start": "y", "end": 2}, {"word": 12, "start": 3, "end": 2}, {"word": 12, "start": 3, "end": 3}]}]},
        {"segments": [{"id": 1, "words": 5}, {"id": "x", "words": [good]}, 9, {"id": 3}]},
        {"segments": "none"}, {},
    ]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    read = transcripts.read_documents(spark, str(tmp_path)).withColumnRenamed("name", "job_id")
    got = sorted((w["job_id"], w["seg_pos"], w["word_pos"], w["fault"], w["word"] if w["fault"] is None else "", w["start"] if w["fault"] is None else 0) for w in transcripts.words(read).collect())
    assert [x[:4] for x in got] == [("0", 0, i, f) for i, f in enumerate([None, "object", "object", "object", "missing", "number", "order", None])] + [("1", 1, 0, None)]
    assert [x[4:] for x in got if x[3] is None] == [("a b", 1.0), ("12", 3.0), ("a b", 1.0)]
    assert sorted((s["job_id"], s["seg_pos"], s["fault"]) for s in transcripts.segments(read).where("fault IS NOT NULL").collect()) == [("1", 0, "words"), ("1", 2, "segment")]


def test_linked_document(spark, tmp_path):
    slides = spark.createDataFrame([("j", 2, None, ""), ("j", 1, "é.jpg", "a b c")], "job_id string, slide_id long, representative_path string, speech_text string")
    shown = spark.createDataFrame([("j", 1, 1, 30, 59, 10.0, 20.0, "c"), ("j", 1, 0, 0, 29, 0.0, 10.0, "a b"), ("j", 1, 2, 60, 60, 20.0, 61 / 3, "")], "job_id string, slide_id long, appearance_index long, start_frame long, end_frame long, start_time double, end_time double, speech_text string")
    linked = spark.createDataFrame([("j", 1, 0, 0, 5, 1, "b", 1.0, 2.00049), ("j", 1, 0, 0, 5, 0, "a", 0.5, 3.0), ("j", 1, 1, 1, None, 0, "c", 11.0, 12.0)], "job_id string, slide_id long, appearance_index long, seg_pos int, segment_id long, word_pos int, word string, start double, end double")
    docs = transcripts.linked_documents(slides, shown, linked)
    transcripts.write_documents(docs, f"{tmp_path}/out")
    text = "".join(p.read_text() for p in Path(f"{tmp_path}/out").glob("part-*"))
    got = json.loads(text)
    assert "é.jpg" in text and (got["slide_count"], got["appearance_count"], got["fps"]) == (2, 3, 3.0)
    assert [s["slide_id"] for s in got["slides"]] == [1, 2] and got["slides"][1]["occurrences"] == [] and got["slides"][1]["representative_path"] is None
    first = got["slides"][0]["occurrences"]
    assert [o["appearance_index"] for o in first] == [0, 1, 2] and first[2]["end_time"] == 20.333 and first[2]["speech_segments"] == []
    assert first[0]["speech_segments"] == [{"segment_id": 5, "start": 0.5, "end": 2.0, "text": "a b", "words": [{"word": "a", "start": 0.5, "end": 3.0}, {"word": "b", "start": 1.0, "end": 2.0}]}]
    again = transcripts.read_documents(spark, f"{tmp_path}/out", lines=True)
    assert again.select(F.variant_get("doc", "$.slides[0].occurrences[1].speech_segments[0].text", "string")).first()[0] == "c"


def test_listings(spark, tmp_path):
    for name in ("a/frames/frame_000002.jpg", "a/frames/frame_000010.jpg", "a/frames/frame_000001.png", "b/frames/z.png", "b/frames/Y.png", "b/frames/x.JPG", "a/in/lecture.webm", "a/in/k.mkv", "a/in/k.MP4", "c/in/n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    base = f"file:{tmp_path}"
    got = sorted((f["folder"].replace(base, ""), f["frame_index"], f["name"]) for f in listings.frames(spark, str(tmp_path)).collect())
    assert got == [("/a/frames", 0, "frame_000002.jpg"), ("/a/frames", 1, "frame_000010.jpg"), ("/b/frames", 0, "Y.png"), ("/b/frames", 1, "z.png")]
    assert [(v["folder"].replace(base, ""), v["first"]) for v in listings.videos(spark, str(tmp_path)).collect()] == [("/a/in", "k.mkv")]
    assert {(f["n"], f["length"]) for f in listings.first_files(listings.files(spark, str(tmp_path), "jpg")).collect()} == {(2, 10)}
    with pytest.raises(FileNotFoundError):
        listings.frames(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        listings.frames(spark, f"{tmp_path}/c")
