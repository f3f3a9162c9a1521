"""Chunked windows, sums, quantiles, gaps and rounds against plain Python, with chunks made small."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import scoring, series, slides


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(series, "CHUNK", 16)
    monkeypatch.setattr(series, "SMALL", 20)
    monkeypatch.setattr(series, "BUCKETS", 4)


def test_windows_over_chunks(spark, small):
    r = np.random.default_rng(1)
    x = {j: r.random(n) for j, n in ((1, 1), (2, 16), (3, 100), (4, 17))}
    frames = spark.createDataFrame([(j, i, float(v), 0.0, 0.0, 0.0) for j, vs in x.items() for i, v in enumerate(vs)], "job_id long, frame_index long, pixel double, edge double, hist double, struct_ double")
    got = {(s["job_id"], s["frame_index"]): s for s in scoring.transition_scores(frames).collect()}
    lag = lambda v, i, k: 0.3 * abs(v[i] - v[i - k]) if i >= k else 0.0
    assert len(got) == sum(map(len, x.values()))
    assert all(abs(s["long"] - lag(x[j], i, 10)) + abs(s["medium"] - lag(x[j], i, 5)) + abs(s["short"] - lag(x[j], i, 2)) < 1e-12 for (j, i), s in got.items())
    limits = spark.createDataFrame([(j, 0.5, 0.2) for j in x], "job_id long, strong double, recovery double")
    scores = frames.select("job_id", "frame_index", F.col("pixel").alias("combined"))
    found = {(p["job_id"], p["frame_index"]) for p in scoring.peaks(scores, limits).collect()}
    top = lambda v, i, n: v[i] >= v[max(0, i - n) : i + n + 1].max()
    assert found == {(j, i) for j, v in x.items() for i in range(10, len(v)) if (v[i] >= 0.5 and top(v, i, 3)) or (0.2 <= v[i] < 0.5 and top(v, i, 2))}
    marks = spark.createDataFrame([(3, i) for i in (5, 15, 16, 17, 90)], "job_id long, frame_index long")
    groups = sorted((g["start_frame"], g["end_frame"], g["appearance_index"], g["frame_count"]) for g in scoring.appearances(frames, marks).where("job_id = 3").collect())
    assert groups == [(0, 4, 0, 5), (5, 14, 1, 10), (15, 15, 2, 1), (16, 16, 3, 1), (17, 89, 4, 73), (90, 99, 5, 10)]


def test_positions(spark):
    r = random.Random(2)
    rows = [(r.choice("abc"), r.randrange(50), i) for i in range(300)]
    got = series.positions(spark.createDataFrame(rows, "job_id string, t int, i int").repartition(5), ["t", "i"]).collect()
    for j in "abc":
        own = sorted(x for x in rows if x[0] == j)
        assert [(x["t"], x["i"]) for x in sorted(got, key=lambda x: x["position"]) if x["job_id"] == j] == [x[1:] for x in own]
        assert sorted(x["position"] for x in got if x["job_id"] == j) == list(range(len(own)))


def test_quantiles(spark, small):
    r = np.random.default_rng(3)
    jobs = {1: r.standard_normal(700), 2: r.random(20), 3: np.repeat([1.0, 2.0, 5.0], [300, 1, 40]), 4: np.full(90, 7.5), 5: 10.0 ** r.uniform(-300, 300, 200), 6: np.array([3.0]), 7: np.array([-1.7e308, 1.7e308] * 30), 8: r.integers(0, 30, 25).astype(float)}
    rows = spark.createDataFrame([(j, float(x)) for j, xs in jobs.items() for x in xs] + [(1, None), (1, float("nan")), (1, float("inf")), (9, None)], "job_id long, x double")
    at = [0.5, 0.96, 0.92, 0.0, 1.0]
    got = {q["job_id"]: q["p"] for q in series.quantiles(rows, at).collect()}
    assert set(got) == set(jobs)
    for j, xs in jobs.items():
        low, high = np.quantile(xs, at, method="lower"), np.quantile(xs, at, method="higher")
        share = np.array(at) * (len(xs) - 1) % 1
        assert np.allclose(got[j], low * (1 - share) + high * share, rtol=1e-9, atol=0), j


@pytest.mark.parametrize("gap", [1, 3, 7])
def test_spaced(spark, small, gap):
    r = random.Random(gap)
    jobs = {1: [10, 11, 12, 13, 14, 20], 2: range(1000), 3: sorted(r.sample(range(3000), 900)), 4: [5], 5: [0, 15, 16, 17, 31, 32, 700, 702, 703, 2000], 6: sorted(r.sample(range(500), 400))}
    found = spark.createDataFrame([(j, i) for j, xs in jobs.items() for i in xs], "job_id long, frame_index long").repartition(4)
    got = {}
    for x in scoring.candidates(found, gap).collect():
        got.setdefault(x["job_id"], []).append(x["frame_index"])
    for j, xs in jobs.items():
        kept = []
        for x in xs:
            if not kept or x - kept[-1] >= gap:
                kept.append(x)
        assert sorted(got[j]) == kept, j


def test_spaced_long_series(spark):
    peaks = [i for i in range(150_000) if i % 3 or i % 7 == 0]
    found = spark.range(0, 150_000).where("id % 3 <> 0 OR id % 7 = 0").selectExpr("1L AS job_id", "id AS frame_index")
    kept, last = 0, -9
    for x in peaks:
        if x - last >= 3:
            kept, last = kept + x, x
    assert scoring.candidates(found).agg(F.sum("frame_index")).first()[0] == kept


@pytest.mark.parametrize("n,m", [(40, 60), (120, 900), (60, 0)])
def test_greedy_rounds(spark, small, n, m):
    r = random.Random(n)
    pairs = {(j, *sorted(r.sample(range(n), 2))) for j in (1, 2) for _ in range(m)} | {(3, i, i + 1) for i in range(11)}
    items = [(j, i) for j in (1, 2) for i in range(n)] + [(3, i) for i in range(12)]
    want = {}
    for j in (1, 2, 3):
        reps = []
        for i in sorted(i for k, i in items if k == j):
            match = [p for p in reps if (j, p, i) in pairs]
            if not match:
                reps.append(i)
            want[j, i] = reps.index(match[0] if match else i) + 1
    got = slides.greedy_slides(spark.createDataFrame(items, "job_id long, i long"), spark.createDataFrame(sorted(pairs), "job_id long, a long, b long"))
    assert {(g["job_id"], g["i"]): g["slide_id"] for g in got.collect()} == want and got.count() == len(items)


def test_cascade(spark):
    """Structural similarity by its definition, and each stage judged on its own."""
    r = np.random.default_rng(4)
    base = r.uniform(-1, 1, 64)
    grids = [base, base + r.normal(0, 0.02, 64), base + r.normal(0, 0.35, 64), -base, base * 0.999, np.where(np.arange(64) % 9 == 0, base + 0.2, base)]

    def ssim(x, y):
        out = []
        for i in range(2):
            for j in range(2):
                a, b = x.reshape(8, 8)[i : i + 7, j : j + 7].ravel(), y.reshape(8, 8)[i : i + 7, j : j + 7].ravel()
                c = np.cov(a, b)
                out.append((2 * a.mean() * b.mean() + 0.0004) * (2 * c[0, 1] + 0.0036) / ((a.mean() ** 2 + b.mean() ** 2 + 0.0004) * (c[0, 0] + c[1, 1] + 0.0036)))
        return float(np.mean(out))

    def edge(x, y):
        maps = [np.array([abs(g[i + 1] - g[i - 1]) + abs(g[i + 8] - g[i - 8]) >= 0.25 for i in (8 * a + b for a in range(1, 7) for b in range(1, 7))]) for g in (x, y)]
        return 1 - float((maps[0] != maps[1]).mean())

    frame = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(grids)], "id long, v array<double>")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)], "a long, b long")
    got = {(d["a"], d["b"]): (d["ssim"], d["edge"]) for d in slides.duplicate_slides(pairs, frame, similar=-2, edges=0).collect()}
    assert all(np.allclose(got[a, b], (ssim(grids[a], grids[b]), edge(grids[a], grids[b]))) for a in range(6) for b in range(a + 1, 6))
    kept = {(d["a"], d["b"]) for d in slides.duplicate_slides(pairs, frame).collect()}
    assert kept == {p for p, (s, e) in got.items() if s >= 0.92 and e >= 0.9} and 0 < len(kept) < len({p for p, (s, _) in got.items() if s >= 0.92}) or len(kept) > 0
