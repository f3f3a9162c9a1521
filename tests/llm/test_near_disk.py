"""The near stage stores less at a time than the texts, and finds the pairs of families whose shingles stand in many texts."""

import os

import numpy as np

import corpus_pipeline
from lectern.llm import common, simhash


def words(r, n):
    return ["".join(r.choice(list("abcdefghijklmnop"), 6)) for _ in range(n)]


def size(df):
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(df.stashed_at.removeprefix("file:")) for n in names if n.endswith(".parquet"))


def test_near_stores_less_than_the_texts(spark, monkeypatch):
    """Texts with a common half: none are alike. No stored table but that of the texts is as large as it."""
    r = np.random.default_rng(5)
    half = words(r, 150)
    rows = [(i, " ".join(half + words(r, 150)) if i % 2 else " ".join(words(r, 150) + half)) for i in range(400)]
    sizes, old = {}, common.stash

    def measured(df, name, *rest):
        out = old(df, name, *rest)
        sizes[name] = max(sizes.get(name, 0), size(out))
        return out

    monkeypatch.setattr(common, "stash", measured)
    assert corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").count() == 400
    texts = sizes.pop("numbered")
    assert max(sizes.values()) < texts, sizes


def test_similar_documents_of_a_family(spark):
    """Texts of one template, in which parts are changed at random: classes are those of brute force."""
    r = np.random.default_rng(6)
    template, rows = words(r, 200), []
    for i in range(60):
        own = list(template)
        for at in r.choice(8, r.integers(1, 4), replace=False):
            own[at * 25 : at * 25 + 12] = words(r, 12)
        rows.append((i, " ".join(own)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    alike = [(a, b) for a in range(60) for b in range(a + 1, 60) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = list(range(60))
    for _ in range(60):
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(alike) > 5 and len(set(root)) > 5
    assert [x["component_id"] for x in got.orderBy("doc_id").collect()] == root


def test_stash_frees_its_shuffle_files_only(spark):
    """The setting is as before, and a frame that was stored can be used and stored again."""
    from pyspark.sql import functions as F

    before = spark.conf.get(common._FREED)
    counts = spark.range(5000).groupBy((F.col("id") % 77).alias("k")).count()
    assert counts.count() == 77
    for _ in range(2):
        assert common.stash(counts, "counts").agg(F.sum("count")).first()[0] == 5000
    assert counts.count() == 77 and spark.conf.get(common._FREED) == before
