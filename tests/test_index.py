"""The stored index and tables: commits that show at once, replaced jobs, and SQLite as the judge of search."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions import tokens
from lectern.operators import search, tables


def docs_of(spark, rows):
    return spark.createDataFrame([(j, f"{j}-{i}", t) for j, i, t in rows], "job_id string, doc string, text string")


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["the", "sort", "Merge", "café", "cafés", "naïve", "don't", "c++", "x1", "ΆΣ", "Йод", "İx", "ſo", "ệ", "ss", "ß", "中文", "a_b"]
    return [(r.choice("abc"), i, " ".join(r.choices(words, k=r.randrange(0, 12)))) for i in range(n)]


def by_sqlite(rows, query, job):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(text, job unindexed, doc unindexed)")
    db.executemany("insert into t values (?, ?, ?)", [(t, j, f"{j}-{i}") for j, i, t in rows])
    words = " OR ".join(f'"{w}"' for w in query.split() if w.isalnum())
    return dict(db.execute("select doc, bm25(t) from t where t match ? and job = ?", (words, job)).fetchall()) if words else {}


@pytest.fixture(scope="module")
def built(spark):
    rows = corpus(3)
    return rows, search.build(spark, docs_of(spark, rows), buckets=4)


@pytest.mark.parametrize("query", ["sort", "the the café cafe", "CAFES naive", "don't c++", "ΆΣ йод İX ſo", "ß ss x1", "中文 merge the"])
def test_search_as_sqlite(built, query):
    rows, store = built
    for job in "ab":
        got = {r["doc"]: r["rank"] for r in search.search_index(store, query, job).collect()}
        want = by_sqlite(rows, query, job)
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-12 for d in want)


def test_terms_as_sqlite(spark):
    """Letters of the Latin, Greek and Cyrillic blocks, composed and not, each inside a word."""
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x370, 0x528), *range(0x1E00, 0x2000)) if chr(c).isalpha() and c != 0x37F]
    texts = [f"q{c}z" for c in letters] + ["cafe\u0301s", "Vie\u0323\u0302t \u0301a", "a\u0345b", "e\u0301", "x\u00b2", "\u0301"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x)")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts)))
    want = {}
    for term, doc in db.execute("select term, doc from v order by doc, offset"):
        want.setdefault(doc, []).append(term)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", tokens.terms(F.col("t")).alias("x")).collect()}
    assert {texts[i]: got[i] for i in got if got[i] != want.get(i, [])} == {}


def contents(store):
    return {t: sorted(map(tuple, store.read(t).collect())) for t in search.INDEX}


def test_replaced_three_times_equals_rebuilt(spark, tmp_path):
    rows = corpus(1)
    store = search.build(spark, docs_of(spark, rows), f"{tmp_path}/s", buckets=4)
    for step, (gone, new) in enumerate([("a", corpus(7, 9)), ("b", []), ("c", [("c", 900, "sort sort"), ("d", 901, ""), ("d", 902, None)])]):
        jobs = spark.createDataFrame([(gone,)], "job string")
        search.replace_documents(store, jobs, docs_of(spark, new))
        out = {gone, *(j for j, _, _ in new)}
        rows = [r for r in rows if r[0] not in out] + new
        assert contents(store) == contents(search.build(spark, docs_of(spark, rows), f"{tmp_path}/{step}", buckets=4))
    before = contents(store)
    search.replace_documents(store, jobs, docs_of(spark, new))
    assert contents(store) == before
    assert store.vacuum(keep=1) > 0 and contents(store) == before


def test_search_reads_its_own_buckets(spark, tmp_path):
    store = search.build(spark, docs_of(spark, corpus(2)), f"{tmp_path}/s", buckets=8)
    plan = search.search_index(store, "sort café", "a")
    files = plan.inputFiles()
    assert not any("text" in n.lower() and "scan" in n.lower() for n in plan._jdf.queryExecution().executedPlan().toString().splitlines())
    assert len({f.rsplit("/", 2)[-2] for f in files if "/postings/" in f}) == 1 and len({f.rsplit("/", 2)[-2] for f in files if "/term_stats/" in f}) <= 2


def test_crash_between_tables(spark, tmp_path, monkeypatch):
    store = search.build(spark, docs_of(spark, corpus(2)), f"{tmp_path}/s", buckets=4)
    before, write, calls = contents(store), tables.Store._write, []

    def failing(self, table, rows, path):
        calls.append(table)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return write(self, table, rows, path)

    jobs = spark.createDataFrame([("a",)], "job string")
    with monkeypatch.context() as m:
        m.setattr(tables.Store, "_write", failing)
        with pytest.raises(RuntimeError):
            search.replace_documents(store, jobs, docs_of(spark, corpus(9)))
    assert len(calls) == 3
    assert contents(tables.Store(spark, f"{tmp_path}/s", search.INDEX, 4)) == before
    search.replace_documents(store, jobs, docs_of(spark, corpus(9)))
    assert contents(store) != before
    store.vacuum(keep=1)


def test_two_commits_at_once(spark, tmp_path):
    store = search.build(spark, docs_of(spark, corpus(2)), f"{tmp_path}/s", buckets=2)
    seen, jobs = store.snapshot(), spark.createDataFrame([("a",)], "job string")
    new, also = search.index_changes(store, seen, jobs, docs_of(spark, []))
    search.replace_documents(store, jobs, docs_of(spark, [("a", 1, "x")]))
    with pytest.raises(tables.Conflict):
        store.replace(jobs, new, also, seen)


def test_ids_follow_the_key(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("a1", None)], "j string, i int").select(tables.key_id("j", "i")).collect()
    assert len({r[0] for r in rows}) == 4 and all(0 <= r[0] < 1 << 60 for r in rows)
