"""Hard negatives against all pairs, with buckets and chunks made small and a third of the rows alike."""

import numpy as np
import pandas as pd
import pytest

from lectern.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row int, bucket string, spread string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 1, "b", "s") for i, v, y in rows], SCHEMA).repartition(3)


def brute(rows, positives, negatives_, low, high, scale, every):
    kept = [(i, [int(np.floor(x * scale)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for i, q, y in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, z) for j, v, z in kept if j != i)
        for p, j, _ in [x for x in scored if x[2] == y][:positives]:
            band = [x for x in scored if x[2] != y and low * -p <= 100 * -x[0] <= high * -p][:negatives_]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(band, 1)]
    return sorted(out)


def made(seed, n, d, hot=0, spread=1.0):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, d)) * r.uniform(1 - spread / 2, 1 + spread / 2, (n, 1)) / np.sqrt(d)
    v[:, 0] += np.where(np.arange(n) % 3 == 0, 2.0, 0.0)
    if hot:
        v[-hot:] = v[1]
    return [(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, r.integers(0, 4, n), strict=True))]


@pytest.mark.parametrize("components", [6 * 37, 6 * 5000])
@pytest.mark.parametrize("hot", [0, 200])
def test_brute_force(spark, monkeypatch, components, hot):
    for name, value in {"COMPONENTS": components, "CHUNK": 10, "HEAD": 8}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = made(1, 600, 6, hot)
    rows += [(600, None, 1), (650, [1.0] * 6, None), (700, [1, None, 0, 0, 0, 0], 1), (750, [float("nan")] * 6, 1), (800, [float("inf")] * 6, 2), (850, [], 1), (None, [1.0] * 6, 1), (900, [0.0] * 6, 3)]
    got = negatives.mine(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 3, 50, 95, 256, 50)


def test_few_rows_and_ids_on_several_rows(spark):
    rows = [(0, [1, 0], 1), (1, [1, 0], 1), (1, [0.9, 0], 1), (2, [0.8, 0], 2), (2, [0.7, 0], 2), (3, [-1, 0], 1), (4, [0, 1], 3)]
    got = sorted(map(tuple, negatives.mine(frame(spark, rows), scale=10).collect()))
    # the last positive scores below zero, and no band is met there; of the two rows called 1 each has its own
    assert got == [(0, 1, 1, 2, 90, 80), (0, 1, 1, 2, 100, 80), (0, 1, 2, 2, 90, 70), (0, 1, 2, 2, 100, 70)]
    assert negatives.mine(frame(spark, [])).count() == 0 and negatives.mine(frame(spark, [(3, [1, 2], 1)])).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(frame(spark, [(0, [1, 2], 1), (3, [1, 2, 3], 1)]))


def test_wide_scores_are_exact(spark):
    rows = [(0, [3e7 + 1, 1], 1), (1, [3e7, 7], 1), (2, [2.5e7 + 1, 3], 2), (3, [2.5e7 + 1, 4], 2)]
    assert sorted(map(tuple, negatives.mine(frame(spark, rows), scale=8).collect())) == brute(rows, 5, 3, 50, 95, 8, 50)


@pytest.mark.parametrize("seed", range(6))
def test_no_candidate_is_lost(seed):
    """Whatever can reach a score is among the candidates, and the ranges do rule rows out."""
    r = np.random.default_rng(seed)
    v = r.standard_normal((3000, 5))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)  # a bucket holds vectors of one length or so
    bucket = negatives.Bucket(np.arange(3000), np.zeros(3000, np.int64), v)
    pruned = 0
    for q in v[:200]:
        scores = bucket.scores(q[None], slice(None))[0]
        for reach in np.quantile(scores, [0.9, 0.99, 1.0]).tolist() + [scores.max() + 1]:
            some = bucket.candidates(q, reach)
            if some is not None:
                pruned += 1
                assert set(np.flatnonzero(scores >= reach).tolist()) <= set(some.tolist())
    assert pruned > 400
    assert np.array_equal(negatives.Bucket.of(bucket.packed()).sorted, bucket.sorted)


@pytest.mark.parametrize("head", [8, 100_000])
def test_search_of_a_bucket(monkeypatch, head):
    """In this process, so that the bound holds: pruned and whole verification give the rows of all products."""
    monkeypatch.setattr(negatives, "HEAD", head)
    r = np.random.default_rng(9)
    v = r.standard_normal((2000, 5))
    v[500:900] = v[3] + r.standard_normal((400, 5)) * 0.05
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    labels, ids = r.integers(0, 3, 2000), np.arange(2000)
    bucket, at = negatives.Bucket(ids, labels, v), np.arange(0, 2000, 40)
    chunk = {"anchor": at, "id": ids[at], "label": labels[at], "v": list(v[at])}
    got = negatives.positives_in(bucket, pd.DataFrame(chunk | {"least": [[-(1 << 62)]] * len(at), "most": [[]] * len(at)}), 5)
    scores = v[at] @ v.T
    order = [sorted(range(2000), key=lambda j, s=s: (-s[j], j)) for s in scores]
    best = {a: [j for j in o if labels[j] == labels[a] and j != a][:5] for a, o in zip(at.tolist(), order, strict=True)}
    assert {a: g["vec_id"].tolist() for a, g in got.groupby("anchor")} == best
    high = [[int(scores[i][j]) for j in best[a]] for i, a in enumerate(at.tolist())]
    bands = {"least": [[-(-s // 2) for s in x] for x in high], "most": [[95 * s // 100 for s in x] for x in high]}
    got = negatives.negatives_in(bucket, pd.DataFrame(chunk | bands), 3)
    want = {}
    for i, a in enumerate(at.tolist()):
        for k in range(5):
            some = [j for j in order[i] if labels[j] != labels[a] and bands["least"][i][k] <= scores[i][j] <= bands["most"][i][k]][:3]
            if some:
                want[a, k] = some
    assert {k: g["vec_id"].tolist() for k, g in got.groupby(["anchor", "place"])} == want and len(want) > 100
