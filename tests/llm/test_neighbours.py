"""Neighbours against brute force: exact where there is one list, by recall where there are many."""

import numpy as np
import pandas as pd
import pytest

from lectern.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, row int, list int, spread string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "s") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, every):
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for i, q in kept:
        if i % every == 0:
            out[i] = sorted((-float(neighbours.exact_scores(q, v)), j) for j, v in kept if j != i)[:k]
    return out


def found(got):
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    return out


def test_defined_rows_and_ties(spark):
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((60, 5)))]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # a vector that ties with forty others
    rows += [(200, None), (220, [0] * 5), (240, [1, None, 0, 0, 0]), (260, [1, float("nan"), 0, 0, 0]), (280, [float("inf"), 0, 0, 0, 0]), (None, [1, 2, 3, 4, 5])]
    assert found(neighbours.nearest(frame(spark, rows), k=7, every=20)) == brute(rows, 7, 20)
    assert found(neighbours.nearest(frame(spark, rows), k=500, every=20)) == brute(rows, 500, 20)


def test_repeated_ids(spark):
    rows = [(0, [1, 0]), (1, [1, 0]), (1, [1, 0]), (1, [0, 1]), (2, [2, 0])]
    assert [x[1] for x in found(neighbours.nearest(frame(spark, rows), k=4, every=20))[0]] == [2, 1, 1, 1]


def test_empty_and_uneven(spark):
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(20, None), (3, [1, 2])])).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest(frame(spark, [(20, [1, 2]), (3, [1, 2, 3])]))


@pytest.mark.parametrize("hot", [0, 1500])
def test_recall(spark, monkeypatch, hot):
    """Many lists; a third of all rows are one vector's copies, in pieces that no task holds together; lengths differ."""
    for name, value in {"LIST": 64, "PIECE": 100, "CHUNK": 50, "HELD": 500, "MEASURED": 64}.items():
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(2)
    v = r.standard_normal((3000, 16)) * r.uniform(0.5, 2, (3000, 1))
    v[3000 - hot :] = v[0]
    rows = list(enumerate(v.tolist()))
    got, want = found(neighbours.nearest(frame(spark, rows), k=10, every=20)), brute(rows, 10, 20)
    assert set(got) == set(want) and all(len(got[i]) == 10 and got[i] == sorted(got[i]) for i in got)
    hits = sum(len({s for s, _ in got[i]} & {s for s, _ in want[i]}) if hot else len(set(got[i]) & set(want[i])) for i in want)
    most = sum(len({s for s, _ in want[i]}) if hot else 10 for i in want)
    assert hits >= 0.9 * most
    assert all(-s == neighbours.exact_scores(v[i], v[j]) for i in got for s, j in got[i])


def test_graph_finds_the_nearest():
    r = np.random.default_rng(4)
    centroids, queries = r.standard_normal((700, 8)), r.standard_normal((200, 8))
    graph = neighbours.Graph(centroids)
    exact = ((queries[:, None] - centroids) ** 2).sum(2)
    ids, distance = graph.search(queries, 32)
    assert (ids[:, 0] == exact.argmin(1)).mean() >= 0.98 and np.allclose(distance, np.take_along_axis(exact, ids, 1))
    row, col = graph.within(queries, 1.5)
    near = np.sqrt(exact) <= 1.5 * np.sqrt(exact.min(1, keepdims=True))
    assert near[row, col].mean() > 0.98 and len(row) >= 0.97 * near.sum()
    assert len(set(zip(row.tolist(), col.tolist(), strict=True))) == len(row)


def test_merging_keeps_the_best(monkeypatch):
    """In this process, so that the bound holds."""
    monkeypatch.setattr(neighbours, "HELD", 60)
    r = np.random.default_rng(8)
    parts = [pd.DataFrame({"ask": r.integers(0, 9, 40), "query_id": 0, "row": r.integers(0, 200, 40), "vec_id": 0, "score": 0.0}) for _ in range(30)]
    for p in parts:
        p["vec_id"], p["score"] = p["row"] // 2, np.cos(p["row"] + p["ask"])  # a row met again has the score it had
    got = pd.concat(neighbours._merging(iter(parts), 4))
    best = lambda f: {a: g.drop_duplicates("row").sort_values(["score", "vec_id", "row"], ascending=[False, True, True])["row"].head(4).tolist() for a, g in f.groupby("ask")}
    assert best(got) == best(pd.concat(parts)) and len(got) < 600


def test_parts_are_balanced():
    rows = np.random.default_rng(5).standard_normal((1000, 4))
    assert len(neighbours.balanced_means(rows, 13)) == 13
    assert len(neighbours.balanced_means(np.ones((50, 3)), 8)) == 8
