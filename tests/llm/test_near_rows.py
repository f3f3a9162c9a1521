"""The near stage answers by row: an id may stand on several rows, and equal rows leave one."""

import numpy as np

import corpus_pipeline


def words(seed, n=200):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list("abcdefgh"), r.integers(2, 9))) for _ in range(n)]


def test_rows_of_one_id(spark):
    a, b, c = (" ".join(words(k)) for k in (1, 2, 3))
    rows = [(3, a), (5, a + " two more"), (5, b), (7, c), (7, c), (7, c), (None, b + " end"), (None, "lone words here"), (9, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, kept_id string, copies int")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, a), (5, b), (7, c), (None, "lone words here"), (9, None)], key=str)
    assert corpus_pipeline.near(spark, docs, "").columns == docs.columns
