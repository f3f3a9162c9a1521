"""Stored lectures: saved twice, saved with less, put in anew, and a crash between two tables."""

import pytest

from lectern.operators import store, tables

SLIDES = "job_id string, slide_id long, representative_path string, speech_text string"
SHOWN = "job_id string, slide_id long, appearance_index long, start_frame long, end_frame long, start_time double, end_time double, speech_text string"
SAID = "job_id string, slide_id long, appearance_index long, segment_id long, start_time double, end_time double, text string"


def lectures(spark, names, n=2, word="sort"):
    slides = [(j, i, f"slide_{i:03d}.jpg" if i else None, None if i else "x") for j in names for i in range(n)]
    shown = [(j, i, a, 30 * a, 30 * a + 29, 10.0 * a, 10.0 * a + 10, word) for j in names for i in range(n) for a in (i, i + n)]
    said = [(j, i, a, k, 10.0 * a + k, 10.0 * a + k + 0.5, t) for j in names for i in range(n) for a in (i, i + n) for k, t in enumerate([f" {word} ", "\t\n", None, f"{word} the"])]
    return spark.createDataFrame(slides, SLIDES), spark.createDataFrame(shown, SHOWN), spark.createDataFrame(said, SAID)


def contents(saved):
    return {t: sorted(map(str, saved.read(t).collect())) for t in store.TABLES}


@pytest.fixture
def saved(spark, tmp_path):
    out = store.library(spark, f"{tmp_path}/s", buckets=2)
    store.save_jobs(out, spark.createDataFrame([(j, f"{j}.mp4", 3.0) for j in "abc"], "job_id string, video_filename string, fps double"))
    store.save_linked_slides(out, spark.createDataFrame([], "job_id string"), *lectures(spark, "abc"))
    return out


def test_saved_twice_and_with_less(spark, saved):
    before = contents(saved)
    assert len(before["speech_segments"]) == 3 * 4 * 2 and len(before["slides"]) == 6
    store.save_linked_slides(saved, spark.createDataFrame([("b",)], "j string"), *lectures(spark, "b"))
    assert contents(saved) == before
    store.save_linked_slides(saved, spark.createDataFrame([("b",)], "j string"), *lectures(spark, "b", n=1, word="merge"))
    after = contents(saved)
    assert len(after["slides"]) == 5 and [x for x in after["slides"] if "'b'" not in x] == [x for x in before["slides"] if "'b'" not in x]
    assert {r["term"]: r["df"] for r in saved.read("term_stats").collect()} == {"sort": 16, "the": 10, "merge": 4}
    page, total = store.search_lecture(saved, "merge", "b", most=3)
    assert [(r["start_time"], r["text"], r["slide_number"]) for r in page.collect()] == [(0.0, "merge", 0), (3.0, "merge the", 0), (10.0, "merge", 0)] and total.first()[0] == 4
    links = saved.read("speech_segments").join(saved.read("slide_occurrences").selectExpr("id AS occurrence_id", "slide_db_id"), "occurrence_id").join(saved.read("slides").selectExpr("id AS slide_db_id"), "slide_db_id")
    assert links.count() == 2 * 8 + 4


def test_put_in_anew(spark, saved):
    store.save_jobs(saved, spark.createDataFrame([("a", "x.mp4"), ("a", "z.mp4"), ("d", None)], "job_id string, video_filename string"))
    assert sorted(map(tuple, saved.read("jobs").collect()), key=str) == [("a", "z.mp4", None), ("b", "b.mp4", 3.0), ("c", "c.mp4", 3.0), ("d", None, None)]
    assert {t: {r["job_id"] for r in saved.read(t).collect()} for t in (*store.CHILDREN, "postings")} == {t: {"b", "c"} for t in store.CHILDREN} | {"postings": {"a", "b", "c"}}
    page, total = store.search_lecture(saved, "sort", "a")
    assert page.count() == 0 and total.first()[0] == 0


def test_crash_between_tables(spark, saved, monkeypatch):
    before, write, calls = contents(saved), tables.Store._write, []

    def failing(self, table, rows, path):
        calls.append(table)
        if table == "speech_segments":
            raise RuntimeError("lost")
        return write(self, table, rows, path)

    with monkeypatch.context() as m:
        m.setattr(tables.Store, "_write", failing)
        with pytest.raises(RuntimeError):
            store.save_linked_slides(saved, spark.createDataFrame([("a",)], "j string"), *lectures(spark, "ad", word="quick"))
    assert {"slides", "slide_occurrences"} <= set(calls) and contents(saved) == before
    assert saved.vacuum(keep=2) >= len(calls) - 1 and contents(saved) == before


def test_one_row_a_job(spark):
    jobs = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "job_id string, x double, y double")
    twice = spark.createDataFrame([("a", 5.0), ("a", None), ("a", 7.0)], "job_id string, x double")
    assert {tuple(r) for r in store.update_columns(jobs, twice).collect()} == {("a", 7.0, 2.0), ("b", 3.0, 4.0)}
    assert {tuple(r) for r in store.upsert_jobs(jobs, twice).collect()} == {("a", 7.0, None), ("b", 3.0, 4.0)}
    odd = spark.createDataFrame([("a", 1, 2)], "job_id string, __new int, __x int")
    assert [tuple(r) for r in store.update_columns(odd, spark.createDataFrame([("a", 9)], "job_id string, __x int")).collect()] == [("a", 1, 9)]
