"""Approximate nearest neighbours by largest inner product over balanced posting lists.

Vectors get one more component that makes them all equally long, so that the largest inner product is the smallest
distance. A bounded sample is split in two by balanced means again and again until its parts stand for lists of LIST
vectors; the means of the parts are the centroids, LISTS at most. An in-memory graph over the centroids (each one's
nearest ones, and a few far ones) is searched by a beam, for all rows of a batch at once.

A vector joins the list of its nearest centroid and, lying at a boundary, those of others that are at most `widen` times
as far, COPIES lists at most. Lists are cut into pieces of PIECE rows, so a list that holds many copies of a vector is no task's burden.

A query reads all lists whose centroids are at most `ratio` times as far as its nearest one. The ratio is measured: for a
sample of queries all true neighbours are found by brute force over all rows, and the smallest ratio that finds `recall`
of them (with a margin) is taken. Scores are those of the original vectors in double precision, added up from the first
component to the last; equal vectors get equal scores.

Bounds, all parameters or constants: the sample (SAMPLE components), the centroids, the measured queries (MEASURED). All
rows are indexed, and all are searched by brute force for the measured queries.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows of a null
id; an id on several rows is several candidates, and none of them serves that id's queries; vectors of several lengths
raise a ValueError; equal scores are ranked by the smaller id; an empty table gives no rows. Only the two named columns
are read, whatever others are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors of a list (before copies), lists at most, lists of one vector at most, vectors of a piece, queries of a chunk.
LIST, LISTS, COPIES, PIECE, CHUNK = 512, 1 << 12, 4, 4096, 1024
#: Components of the sample that the centroids are fitted on, and queries whose true neighbours are found to choose the ratio.
SAMPLE, MEASURED = 1 << 22, 128
#: Neighbours of a centroid in the graph: nearest, and others. Entries of a beam that are expanded together.
NEAR, FAR, AHEAD = 24, 8, 4


def balanced_means(rows: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """Means of `parts` parts of equal size: a part is split at the weighted median along the line between its two means."""
    done, todo = [], [(rows, parts)]
    draw = np.random.default_rng(seed)
    while todo:
        part, n = todo.pop()
        if n == 1 or len(part) < 2:
            done.append(part.mean(0))
            continue
        left = n // 2
        cut = max(1, min(len(part) - 1, len(part) * left // n))
        line = draw.standard_normal(part.shape[1])
        for _ in range(6):
            order = np.argsort(part @ line, kind="stable")
            apart = part[order[cut:]].mean(0) - part[order[:cut]].mean(0)
            if not apart.any():
                break
            line = apart
        order = np.argsort(part @ line, kind="stable")
        todo += [(part[order[:cut]], left), (part[order[cut:]], n - left)]
    return np.array(done)


class Graph:
    """Centroids, each with edges to its nearest ones and to some others; edges hold both ways as far as there is room."""

    def __init__(self, centroids: np.ndarray, near: int = NEAR, far: int = FAR):
        n = len(centroids)
        self.centroids, self.norms = centroids, (centroids**2).sum(1)
        draw = np.random.default_rng(n)
        edges = np.empty((n, min(n - 1, near) + (far if n > near + 1 else 0)), np.int64)
        for a in range(0, n, 1024):
            b = min(n, a + 1024)
            distance = self.norms - 2 * centroids[a:b] @ centroids.T
            distance[np.arange(b - a), np.arange(a, b)] = np.inf
            k = min(n - 1, near)
            edges[a:b, :k] = np.argpartition(distance, max(0, k - 1), axis=1)[:, :k]
        if n > near + 1:  # far edges: along a few random orders of all centroids, so that the whole graph hangs together
            for j in range(far):
                ring = draw.permutation(n)
                edges[ring, near + j] = np.roll(ring, 1 if j % 2 else -1)
        self.edges, self.entry = edges, np.unique(draw.integers(0, n, 16))

    def _distance(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.full(ids.shape, np.inf)
        row, col = np.nonzero(ids >= 0)
        at = ids[row, col]
        out[row, col] = np.maximum(0.0, self.norms[at] - 2 * np.einsum("ij,ij->i", queries[row], self.centroids[at]) + own[row])
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query `beam` centroids (fewer: -1 at the end) and their squared distances, nearest first."""
        m, beam = len(queries), min(beam, len(self.centroids))
        own = (queries**2).sum(1)
        ids = np.full((m, beam), -1, np.int64)
        entry = self.entry[:beam]
        ids[:, : len(entry)] = entry
        distance = self._distance(queries, own, ids)
        open_ = ids >= 0
        order = np.argsort(distance, axis=1, kind="stable")
        ids, distance, open_ = (np.take_along_axis(x, order, 1) for x in (ids, distance, open_))
        active = np.arange(m)
        while len(active):
            i, d, o = ids[active], distance[active], open_[active]
            take = o & (np.cumsum(o, axis=1) <= AHEAD)
            row, col = np.nonzero(take)
            o[row, col] = False
            place = (np.cumsum(take, axis=1) - 1)[row, col]
            met = np.full((len(active), AHEAD, self.edges.shape[1]), -1, np.int64)
            met[row, place] = self.edges[i[row, col]]
            met = met.reshape(len(active), -1)
            every = np.concatenate([i, met], axis=1)
            by = np.argsort(every, axis=1, kind="stable")  # of equal ids, the one in the beam comes first
            ranked = np.take_along_axis(every, by, 1)
            again = np.zeros(every.shape, bool)
            np.put_along_axis(again, by[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
            met[again[:, beam:]] = -1
            new = self._distance(queries[active], own[active], met)
            every, d = np.concatenate([i, met], axis=1), np.concatenate([d, new], axis=1)
            o = np.concatenate([o, met >= 0], axis=1)
            best = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids[active], distance[active], open_[active] = (np.take_along_axis(x, best, 1) for x in (every, d, o))
            active = active[open_[active].any(1)]
        return ids, distance

    def within(self, queries: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, centroid) for all centroids at most `ratio` times as far as the nearest; the beam grows until it holds them."""
        rows, lists, todo, beam = [], [], np.arange(len(queries)), 64
        while len(todo):
            ids, distance = self.search(queries[todo], beam)
            limit = distance[:, :1] * ratio**2
            full = (distance[:, -1] <= limit[:, 0]) & (ids.shape[1] < len(self.centroids))
            row, col = np.nonzero((ids >= 0) & (distance <= limit) & ~full[:, None])
            rows.append(todo[row])
            lists.append(ids[row, col])
            todo, beam = todo[full], beam * 4
        return np.concatenate(rows) if rows else todo, np.concatenate(lists) if lists else todo

    def homes(self, vectors: np.ndarray, widen: float, copies: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, centroid): the lists each vector joins."""
        ids, distance = self.search(vectors, max(16, 4 * copies))
        fits = (ids >= 0) & (distance <= widen**2 * distance[:, :1])
        fits[:, 0] = True
        return np.nonzero(fits[:, :copies])[0], ids[:, :copies][fits[:, :copies]]


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, added up from the first component to the last whatever else is in rows."""
    return np.cumsum(rows * queries, axis=-1)[..., -1]


def best_of(asks: pd.DataFrame, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """ask, query_id, row, vec_id, score: the k best of these vectors for each of asks (ask, id, v), its own id left out."""
    out = []
    for a in range(0, len(asks), 256):
        some = asks.iloc[a : a + 256]
        queries, own, ask = np.stack(some["v"].to_list()).astype(float), some["id"].to_numpy(), some["ask"].to_numpy()
        rough = queries @ vectors.T
        rough[own[:, None] == ids[None, :]] = -np.inf
        # rounding can swap what lies this close: so many more are looked at exactly
        slack = 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max(initial=0.0)
        n = min(k + 8, rough.shape[1])
        near = np.argpartition(rough, -n, axis=1)[:, -n:]
        value = np.sort(np.take_along_axis(rough, near, 1), axis=1)
        unsure = (value[:, -min(k, n)] - slack <= value[:, 0]) & (n < rough.shape[1])
        for at in [np.flatnonzero(~unsure), *np.flatnonzero(unsure)[:, None]]:
            if not len(at):
                continue
            found = near[at] if not unsure[at[0]] else np.flatnonzero(rough[at[0]] >= value[at[0], -k] - slack[at[0]])[None, :]
            score = np.where(np.take_along_axis(rough[at], found, 1) > -np.inf, exact_scores(queries[at][:, None, :], vectors[found]), -np.inf)
            order = np.lexsort((rows[found], ids[found], -score))[:, :k]
            found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
            row, col = np.nonzero(score > -np.inf)
            at, found = at[row], found[row, col]
            out.append(pd.DataFrame({"ask": ask[at], "query_id": own[at], "row": rows[found], "vec_id": ids[found], "score": score[row, col]}))
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("ask", "query_id", "row", "vec_id", "score")})


def merged(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k best rows of each query; a vector met in several lists counts once."""
    every = pd.concat(found).drop_duplicates(["ask", "row"]).sort_values(["ask", "score", "vec_id", "row"], ascending=[True, False, True, True])
    return every.groupby("ask", sort=False).head(k)


FOUND = "ask long, query_id long, row long, vec_id long, score double"
#: Rows found that a task holds before it merges them.
HELD = 1 << 18


def _merging(found, k: int):
    """Merge frames as they come; what stays too much is sent on."""
    held, size = [], 0
    for one in found:
        held.append(one)
        size += len(one)
        if size > HELD:
            held = [merged(held, k)]
            size = len(held[0])
            if size > HELD // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield merged(held, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("ask", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _lengthened(v: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(0.0, longest - (v**2).sum(1)))[:, None]], axis=1)


def _asked(v: np.ndarray) -> np.ndarray:
    return np.concatenate([v, np.zeros((len(v), 1))], axis=1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.96, widen: float = 1.02, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query (rows whose id is divisible by `every`) the k nearest rows found: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    common.bound_batches(spark)
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    kept = kept.where(F.exists("v", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id())
    rows = common.stash(kept.withColumn("spread", F.xxhash64("row").bitwiseAND((1 << 40) - 1)), "neighbour-rows")
    asking = F.col("id") % every == 0
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, asked, shortest, width, longest = rows.agg(F.count(F.lit(1)), F.count_if(asking), F.min(F.size("v")), F.max(F.size("v")), F.max(square)).first()
    if shortest != width:
        raise ValueError(f"vectors of {shortest} to {width} components")
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    most = max(16, SAMPLE // width)
    drawn = rows.where(F.col("spread") < F.lit(int(min(1.0, most / total) * (1 << 40)))).orderBy("spread", "row").limit(2 * most)
    sample = np.stack([np.array(r["v"], float) for r in drawn.select("v").toLocalIterator()] or [np.zeros(width)])
    lists = max(1, min(LISTS, total // LIST, len(sample) // 16))
    graph = spark.sparkContext.broadcast(Graph(balanced_means(_lengthened(sample, longest), lists)))

    def assign(parts):
        for part in parts:
            if len(part):
                at, home = graph.value.homes(_lengthened(np.stack(part["v"].to_list()).astype(float), longest), widen, COPIES)
                yield part.iloc[at][["row", "id", "v", "spread"]].assign(list=home)

    kind = dict(rows.dtypes)["v"]
    placed = common.stash(rows.mapInPandas(assign, f"row long, id long, v {kind}, spread long, list long"), "neighbour-lists")
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # LISTS at most
    pieces = spark.createDataFrame([(c, -(-n // PIECE)) for c, n in sizes.items()], "list long, pieces long")

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        flat = np.stack(part["v"].to_list()).astype(float)
        return pd.DataFrame([{"list": key[0], "rows": part["row"].to_numpy().tobytes(), "ids": part["id"].to_numpy().tobytes(), "vs": flat.astype(np.float32 if "float" in kind else float).tobytes()}])

    cut = placed.join(F.broadcast(pieces), "list").withColumn("piece", F.col("spread") % F.col("pieces"))
    postings = common.stash(cut.groupBy("list", "piece").applyInPandas(pack, "list long, rows binary, ids binary, vs binary"), "neighbour-postings")

    # the ratio at which a sample of queries finds its neighbours
    measured = rows.where(asking).orderBy("spread", "row").limit(MEASURED).select(F.col("row").alias("ask"), "id", "v").toPandas()
    queries = np.stack(measured["v"].to_list()).astype(float)

    def brute(parts):
        yield from _merging((best_of(measured, p["id"].to_numpy(), p["row"].to_numpy(), np.stack(p["v"].to_list()).astype(float), k) for p in parts if len(p)), k)

    truth = _ranked(rows.mapInPandas(brute, FOUND), k).select("ask", "row")  # MEASURED * k rows at most
    homes = placed.select("row", "list").join(F.broadcast(truth), "row").toPandas()
    centroids = graph.value.centroids
    far = np.maximum(0.0, ((_asked(queries) ** 2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * _asked(queries) @ centroids.T))
    far = np.sqrt(np.maximum(far, 1e-18))
    far /= far.min(1, keepdims=True)
    number = {a: i for i, a in enumerate(measured["ask"])}
    homes["ratio"] = far[homes["ask"].map(number).to_numpy(int), homes["list"].to_numpy(int)] if len(homes) else 0.0
    needed = homes.groupby(["ask", "row"])["ratio"].min().to_numpy()
    ratio = float(np.quantile(needed, recall, method="higher")) * (1 + 1e-9) if len(needed) else 1.0

    def route(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(part["v"].to_list()).astype(float)
        query, home = graph.value.within(_asked(v), ratio)
        held = np.bincount(query, np.array([sizes.get(c, 0) for c in home.tolist()]), len(v))
        short = np.flatnonzero(held < COPIES * (k + 1))  # too few rows for k different ones: these queries read all lists
        keep = ~np.isin(query, short)
        query = np.concatenate([query[keep], np.repeat(short, lists)])
        home = np.concatenate([home[keep], np.tile(np.arange(lists), len(short))])
        order = np.argsort(home, kind="stable")
        query, home = query[order], home[order]
        out = []
        for at in np.split(np.arange(len(home)), np.flatnonzero(np.diff(home)) + 1):
            q = query[at]
            out.append({"list": home[at[0]], "asks": part["row"].to_numpy()[q].tobytes(), "own": part["id"].to_numpy()[q].tobytes(), "q": v[q].tobytes()})
        return pd.DataFrame(out)

    def search(parts):
        def each():
            for part in parts:
                for p in part.to_dict("records"):
                    asks, own = np.frombuffer(p["asks"], np.int64), np.frombuffer(p["own"], np.int64)
                    ids = np.frombuffer(p["ids"], np.int64)
                    v = np.frombuffer(p["vs"], np.float32 if "float" in kind else float).reshape(len(ids), -1).astype(float)
                    q = np.frombuffer(p["q"]).reshape(len(asks), -1)
                    yield best_of(pd.DataFrame({"ask": asks, "id": own, "v": list(q)}), ids, np.frombuffer(p["rows"], np.int64), v, k)

        yield from _merging(each(), k)

    chunks = rows.where(asking).withColumn("chunk", F.col("spread") % max(1, -(-asked // CHUNK)))
    routed = chunks.groupBy("chunk").applyInPandas(route, "list long, asks binary, own binary, q binary")
    found = routed.join(postings, "list").mapInPandas(search, FOUND)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
