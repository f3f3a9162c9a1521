"""Hard-negative mining by exact integer inner products, with coordinate pruning inside length buckets.

Vectors are quantised to floor(scale * x) and cut, from the longest down, into buckets of BUCKET rows. A bucket holds
sorted lists of each coordinate of its vectors divided by their lengths. For an anchor and a score to be reached, the
longest vector of a bucket tells what cosine is needed; each of the anchor's FOCUS largest coordinates then allows a range of
values only (if the cosine is c and the anchor's coordinate q: q * c - s to q * c + s, s = sqrt((1 - q^2) (1 - c^2))).
The ranges are looked up in the sorted lists, shortest first, and the sets of rows are intersected; what is left is
verified by exact products. A bucket whose vectors are too short is skipped; where the ranges leave more than a SHARE of a
bucket, it is verified as a whole, many anchors together.

Scores to be reached come from the search itself. One bucket is searched for each chunk of anchors first; its k-th best
scores bound what can still matter in all others. So an anchor's positives are found, and then, for each of them, the best
negatives in its band of scores.

Chunks of anchors meet buckets in an equi-join on the pair's number: packed buckets and packed anchors are replicated,
never vectors, and never pairs of them. A bucket's size is bounded, however many rows are equal.

Defined results: rows of a null id or label, or of a vector that is null, empty or holds a null or a non-finite component,
take no part; vectors of several lengths raise a ValueError; an id on several rows is several candidates and anchors of its
own, none of which serves that id's anchors; equal scores are ranked by the smaller id; a zero or negative positive score
leaves what the band says (nothing, or scores of zero); an empty table gives no rows. Only the three named columns are
read, whatever others are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Components of a bucket, anchors of a chunk, focus coordinates, the share of a bucket that is verified row by row, rows verified first.
COMPONENTS, CHUNK, FOCUS, SHARE, HEAD = 1 << 22, 512, 6, 0.15, 2048


class Bucket:
    """Vectors of similar lengths with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.labels, self.vectors, self.wide = ids, labels, vectors, vectors.astype(float)
        lengths = np.sqrt((self.wide**2).sum(1))
        self.longest = float(lengths.max(initial=0.0))
        self.unit = self.wide / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable").T.astype(np.int32) if order is None else order
        self.sorted = np.take_along_axis(self.unit.T, self.order, 1)

    def scores(self, anchors: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        """Exact inner products of anchors and these rows."""
        reach = self.longest * float(np.sqrt((anchors.astype(float) ** 2).sum(1).max(initial=0.0)))
        if reach < 2**52:  # every sum on the way is a whole number that doubles hold
            return (anchors.astype(float) @ self.wide[rows].T).astype(np.int64)
        if reach < 2**62:
            return anchors @ self.vectors[rows].astype(np.int64).T
        raise ValueError("scores pass 64 bits")

    def packed(self) -> dict:
        kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or np.abs(self.vectors).max(initial=0) <= np.iinfo(t).max)
        return {"ids": self.ids.tobytes(), "labels": self.labels.tobytes(), "kind": kind, "vs": self.vectors.astype(kind).tobytes(), "lists": self.order.tobytes()}

    @staticmethod
    def of(row: dict) -> Bucket:
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        return Bucket(ids, labels, np.frombuffer(row["vs"], row["kind"]).reshape(len(ids), -1), np.frombuffer(row["lists"], np.int32).reshape(-1, len(ids)))

    def candidates(self, anchor: np.ndarray, reach: float) -> np.ndarray | None:
        """Rows that can score `reach` or more; None if the lists leave too many to pick them one by one."""
        length = float(np.sqrt((anchor.astype(float) ** 2).sum()))
        if reach <= 0:
            return None
        if length * self.longest * (1 + 1e-9) < reach:
            return np.zeros(0, np.int64)
        cosine = min(1.0, reach / (length * self.longest)) - 1e-9
        q = anchor / length
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        spread = np.sqrt(np.maximum(0.0, (1 - q[focus] ** 2) * (1 - cosine**2))) + 1e-9
        low = [int(np.searchsorted(self.sorted[f], q[f] * cosine - s)) for f, s in zip(focus.tolist(), spread, strict=True)]
        # a coordinate may be larger than this only if the cosine can be, up to 1
        high = [int(np.searchsorted(self.sorted[f], q[f] * cosine + s if q[f] < cosine else 1.0 + 1e-9, "right")) for f, s in zip(focus.tolist(), spread, strict=True)]
        low = [a if q[f] > -cosine else 0 for a, f in zip(low, focus.tolist(), strict=True)]
        sizes = np.array(high) - np.array(low)
        by = np.argsort(sizes, kind="stable")
        if sizes[by[0]] > 0.5 * len(self.ids):
            return None
        left = self.order[focus[by[0]], low[by[0]] : high[by[0]]]
        for i in by[1:]:
            if len(left) <= 64:
                break
            values, bounds = self.unit[left, focus[i]], self.sorted[focus[i]]
            a, b = (bounds[low[i]] if low[i] < len(bounds) else np.inf), (bounds[high[i] - 1] if high[i] else -np.inf)
            left = left[(values >= a) & (values <= b)]
        return left if len(left) <= SHARE * len(self.ids) else None


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k + 64:
        kth = np.partition(scores, -k)[-k]
        some = np.flatnonzero(scores >= kth)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def verified(bucket: Bucket, anchors: np.ndarray, reach, take) -> None:
    """Give take(anchor number, rows, scores) the scores of all rows that can reach reach(anchor number), and more."""
    head = np.arange(min(HEAD, len(bucket.ids)))
    for i, scores in enumerate(bucket.scores(anchors, head)):
        take(i, head, scores)
    rest = np.arange(len(head), len(bucket.ids))
    if not len(rest):
        return
    whole = []
    for i, anchor in enumerate(anchors):
        some = bucket.candidates(anchor, reach(i))
        if some is None:
            whole.append(i)
        else:
            some = some[some >= len(head)]
            take(i, some, bucket.scores(anchor[None], some)[0])
    for at in range(0, len(whole), 32):
        some = whole[at : at + 32]
        for i, scores in zip(some, bucket.scores(anchors[some], slice(len(head), None)), strict=True):
            take(i, rest, scores)


def positives_in(bucket: Bucket, chunk: pd.DataFrame, k: int) -> pd.DataFrame:
    """anchor, place of the k best rows of the anchors' labels in this bucket, from a score on that is known to be reached."""
    anchors, floor = np.stack(chunk["v"].to_list()), np.array([x[0] for x in chunk["least"]], np.int64)
    own, label = chunk["id"].to_numpy(), chunk["label"].to_numpy()
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2 for _ in own]

    def take(i, rows, scores):
        fits = (bucket.labels[rows] == label[i]) & (bucket.ids[rows] != own[i]) & (scores >= floor[i])
        ids, scores = np.append(held[i][0], bucket.ids[rows[fits]]), np.append(held[i][1], scores[fits])
        top = best(scores, ids, k)
        held[i] = ids[top], scores[top]
        if len(top) == k:
            floor[i] = max(floor[i], scores[top].min())

    verified(bucket, anchors, lambda i: float(floor[i]), take)
    counts = [len(x[0]) for x in held]
    return pd.DataFrame({"anchor": np.repeat(chunk["anchor"].to_numpy(), counts), "vec_id": np.concatenate([x[0] for x in held]), "score": np.concatenate([x[1] for x in held])})


def negatives_in(bucket: Bucket, chunk: pd.DataFrame, k: int) -> pd.DataFrame:
    """anchor, place, vec_id, score: for each positive of the anchors the k best rows of other labels in this bucket whose scores are in its band."""
    anchors = np.stack(chunk["v"].to_list())
    own, label = chunk["id"].to_numpy(), chunk["label"].to_numpy()
    least, most = ([np.array(x, np.int64) for x in chunk[c]] for c in ("least", "most"))
    held = [[(np.zeros(0, np.int64),) * 2 for _ in x] for x in least]

    def take(i, rows, scores):
        if not len(least[i]):
            return
        fits = (bucket.labels[rows] != label[i]) & (bucket.ids[rows] != own[i]) & (scores >= least[i].min()) & (scores <= most[i].max())
        ids, scores = bucket.ids[rows[fits]], scores[fits]
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        for j in range(len(least[i])):
            a, b = np.searchsorted(-scores, -most[i][j], "left"), np.searchsorted(-scores, -least[i][j], "right")
            b = max(a, min(a + k, b))
            joined, score = np.append(held[i][j][0], ids[a:b]), np.append(held[i][j][1], scores[a:b])
            top = best(score, joined, k)
            held[i][j] = joined[top], score[top]
            if len(top) == k:
                least[i][j] = max(least[i][j], score[top].min())

    verified(bucket, anchors, lambda i: float(least[i].min()) if len(least[i]) else np.inf, take)
    flat = [(a, j, *x) for a, of in zip(chunk["anchor"].tolist(), held, strict=True) for j, x in enumerate(of)]
    counts = [len(x[2]) for x in flat]
    return pd.DataFrame({
        "anchor": np.repeat(np.array([x[0] for x in flat], np.int64), counts), "place": np.repeat(np.array([x[1] for x in flat], np.int32), counts),
        "vec_id": np.concatenate([x[2] for x in flat]) if flat else [], "score": np.concatenate([x[3] for x in flat]) if flat else [],
    })


BUCKET = "bucket long, ids binary, labels binary, kind string, vs binary, lists binary"
#: Classes of length at most; each is cut into as many buckets as its rows need.
CLASSES = 256


def _index(rows: DataFrame, total: int, width: int) -> tuple[DataFrame, int]:
    """The stored buckets (BUCKET), numbered from 0 for the longest vectors on, and their number."""
    held = max(1, COMPONENTS // width)
    classes = min(CLASSES, -(-total // held))
    bounds = rows.agg(F.expr(f"percentile_approx(square, array({', '.join(f'{i}e0 / {classes}' for i in range(1, classes))}), 10000)")).first()[0] if classes > 1 else []
    longer = F.array(*[F.lit(float(b)) for b in sorted(set(bounds or []))])
    classed = rows.withColumn("class", F.size(F.filter(longer, lambda b: b > F.col("square"))) if bounds else F.lit(0))
    sizes = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # CLASSES at most
    first, number = {}, 0
    for c in sorted(sizes):
        first[c] = (number, -(-sizes[c] // held))
        number += first[c][1]
    pick = lambda at: F.element_at(F.create_map(*[x for c, v in first.items() for x in (F.lit(c), F.lit(v[at]))]), F.col("class"))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["square", "row"], ascending=[False, True])
        return pd.DataFrame([{"bucket": key[0]} | Bucket(part["id"].to_numpy(), part["label"].to_numpy(), np.stack(part["v"].to_list())).packed()])

    dealt = classed.withColumn("bucket", (pick(0) + F.col("spread") % pick(1)).cast("long"))
    return common.stash(dealt.groupBy("bucket").applyInPandas(pack, BUCKET), "negatives-index"), number


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows whose id is divisible
    by `every`) and each of its best rows of the same label, the best rows of others that score low to high percent of it."""
    spark = vectors.sparkSession
    common.bound_batches(spark)
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"), F.monotonically_increasing_id().alias("row"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = common.stash(rows.withColumns({"square": square, "spread": F.xxhash64("row").bitwiseAND((1 << 40) - 1)}), "negatives-rows")
    asking = F.col("id") % every == 0
    total, asked, shortest, width = rows.agg(F.count(F.lit(1)), F.count_if(asking), F.min(F.size("v")), F.max(F.size("v"))).first()
    if shortest != width:
        raise ValueError(f"vectors of {shortest} to {width} components")
    if not asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index, buckets = _index(rows, total, width)
    size = min(CHUNK, max(64, -(-asked * buckets // common.shuffle_parts(spark))))
    chunks = -(-asked // size)
    asks = rows.where(asking).select(F.col("row").alias("anchor"), "id", "label", "v", (F.col("spread") % chunks).alias("chunk"))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(part["v"].to_list())
        out = {"chunk": key[0], "anchors": part["anchor"].tolist(), "own": part["id"].tolist(), "of": part["label"].tolist(), "q": v.astype(np.int64).tobytes()}
        return pd.DataFrame([out | {c: [[int(y) for y in x] for x in part[c]] for c in ("least", "most")}])

    def met(bounds: DataFrame, everywhere: bool, search, k: int, shape: str) -> DataFrame:
        """What search finds for the anchors with these bounds (anchor, least, most) in all buckets, or in one a chunk."""
        packed = asks.join(bounds, "anchor").groupBy("chunk").applyInPandas(pack, "chunk long, anchors array<long>, own array<long>, of array<long>, q binary, least array<array<long>>, most array<array<long>>")
        packed = common.stash(packed, "negatives-chunks")
        number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        one = F.col("chunk") % buckets
        left = index.withColumn("chunk", number(chunks))
        left = left if everywhere else left.where(one == F.col("bucket"))
        right = packed.withColumn("bucket", number(buckets) if everywhere else one)
        dealt = max(common.shuffle_parts(spark), 2 * chunks * (buckets if everywhere else 1))
        pairs = left.repartition(dealt, "bucket", "chunk").join(right.repartition(dealt, "bucket", "chunk").hint("merge"), ["bucket", "chunk"])

        def run(parts):
            for part in parts:
                for p in part.to_dict("records"):
                    anchors = np.frombuffer(p["q"], np.int64).reshape(len(p["anchors"]), -1)
                    chunk = pd.DataFrame({"anchor": p["anchors"], "id": p["own"], "label": p["of"], "v": list(anchors), "least": list(p["least"]), "most": list(p["most"])})
                    yield search(Bucket.of(p), chunk, k)

        return pairs.mapInPandas(run, shape)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    none = F.array().cast("array<long>")
    bounds = asks.select("anchor", F.array(F.lit(-(1 << 62)).cast("long")).alias("least"), none.alias("most"))
    shape = "anchor long, vec_id long, score long"
    if buckets > 1:  # one bucket tells what the others have to reach
        known = first(met(bounds, False, positives_in, positives, shape), ["anchor"], positives).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        bounds = bounds.join(known, "anchor", "left").select("anchor", F.when(F.col("n") == positives, F.array("kth")).otherwise(F.col("least")).alias("least"), "most")
    good = first(met(bounds, True, positives_in, positives, shape), ["anchor"], positives)
    good = common.stash(good.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    # the band of each positive in whole scores; the places of its arrays are those of the positives
    least, most = F.expr(f"-floor(-positive_score * {low} / 100BD)").cast("long"), F.expr(f"floor(positive_score * {high} / 100BD)").cast("long")
    bands = good.select("anchor", "place", least.alias("least"), most.alias("most"))
    shape = "anchor long, place int, vec_id long, score long"

    def arrays(bands: DataFrame) -> DataFrame:
        every = F.array_sort(F.collect_list(F.struct("place", "least", "most")))  # as many as an anchor has positives
        return bands.groupBy("anchor").agg(every.alias("x")).select("anchor", F.col("x.least").alias("least"), F.col("x.most").alias("most"))

    if buckets > 1:
        known = first(met(arrays(bands), False, negatives_in, negatives, shape), ["anchor", "place"], negatives).groupBy("anchor", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        bands = bands.join(known, ["anchor", "place"], "left").select("anchor", "place", F.when(F.col("n") == negatives, F.col("kth")).otherwise(F.col("least")).alias("least"), "most")
    bad = first(met(arrays(bands), True, negatives_in, negatives, shape), ["anchor", "place"], negatives)
    out = bad.join(good, ["anchor", "place"]).join(asks.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
