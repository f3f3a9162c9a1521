"""Exact top-k by integer inner product over a bit-sliced index.

Components are quantised to floor(scale * x). A block of at most BLOCK vectors keeps, for each component, one bitmap a
bit of (value - least value of the component). A query's scores for the whole block are added up with bitmap arithmetic
alone: bitmap b of a component counts 2**(b + c) for each set bit c of the query's component (complements stand in for
negative components), and full adders reduce all bitmaps of a weight to one and carry the rest upward, which leaves the
scores themselves bit-sliced. The top rows are then selected from the most significant slice downward; rows that tie at
the boundary are resolved exactly by the smaller id.

The slices of a block are built once and stored. Blocks of queries then meet every block of the index through an equi-join
on the pair's key; each pair leaves k rows a query, and these are merged. What is replicated is packed slices, once for
so many queries, and packed queries, once for so many vectors; never the vectors, never pairs of them.

Defined results: vectors that are null or hold a null or a non-finite component take no part, nor do rows of a null
id; an id on several rows is several candidates, and none of them serves that id's queries; vectors of several lengths
raise a ValueError; an empty table gives no rows. Only the two named columns are read, whatever others are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors of an index block hold at most so many components in all; queries of a query block, fewest and most.
COMPONENTS, FEWEST, MOST = 1 << 22, 128, 8192


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """(least value, bits) of each component and its bitmaps, least significant first, as words of 64 rows."""
    low = values.min(0)
    span = values.max(0) - low
    bits = np.array([int(s).bit_length() for s in span])
    words = -(-len(values) // 64)
    maps = []
    for d in range(values.shape[1]):
        v = np.zeros(words * 64, np.int64)
        v[: len(values)] = values[:, d] - low[d]
        maps.append([np.packbits((v >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(bits[d])])
    return low, bits, maps


class Adder:
    """Adds bitmaps by weight; buffers are used again from query to query."""

    def __init__(self, words: int):
        self.words, self.free = words, []

    def take(self) -> np.ndarray:
        return self.free.pop() if self.free else np.empty(self.words, np.uint64)

    def total(self, weights: list[list[np.ndarray]]) -> list[np.ndarray]:
        """One bitmap a weight, least significant first. weights[i]: bitmaps that count 2**i; they aren't changed."""
        out, mine = [], set()
        i = 0
        while i < len(weights):
            todo = weights[i]
            if i + 1 == len(weights) and len(todo) > 1:
                weights.append([])
            at = 0
            while len(todo) - at > 1:
                x, y = todo[at], todo[at + 1]
                half, carry = self.take(), self.take()
                np.bitwise_xor(x, y, out=half)
                if len(todo) - at > 2:
                    z = todo[at + 2]
                    at += 3
                    np.bitwise_and(half, z, out=carry)
                    np.bitwise_xor(half, z, out=half)
                    # of x and y: both, or the half and z
                    both = self.take()
                    np.bitwise_and(x, y, out=both)
                    np.bitwise_or(carry, both, out=carry)
                    self.free.append(both)
                    gone = (x, y, z)
                else:
                    at += 2
                    np.bitwise_and(x, y, out=carry)
                    gone = (x, y)
                for g in gone:
                    if id(g) in mine:
                        mine.discard(id(g))
                        self.free.append(g)
                mine.update((id(half), id(carry)))
                todo.append(half)
                weights[i + 1].append(carry)
            out.append(todo[at] if len(todo) > at else np.zeros(self.words, np.uint64))
            i += 1
        self.free += [o for o in out if id(o) in mine]
        return out


def top_rows(total: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Places of at least min(k, all) rows that include the k highest; more only if they tie at the boundary."""
    sure, open_ = np.zeros_like(alive), alive.copy()
    need = k
    for s in reversed(total):
        high = open_ & s
        n = int(np.bitwise_count(high).sum())
        if n >= need:
            open_ = high
        else:
            sure |= high
            need -= n
            open_ &= ~s
            if not need:
                break
    found = sure | open_ if need else sure
    return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))


def build(ids: np.ndarray, values: np.ndarray) -> dict[str, bytes]:
    """The packed index of a block: ids in order, least values, bits and bitmaps of the components one after another."""
    order = np.argsort(ids, kind="stable")
    low, bits, maps = slices(values[order])
    packed = [m for of in maps for m in of]
    return {"ids": ids[order].tobytes(), "low": low.tobytes(), "bits": bits.tobytes(), "maps": np.concatenate(packed).tobytes() if packed else b""}


def search_block(block: dict[str, bytes], query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query id, row id, score) of the k best rows of this block for each query; scores are read from the sum's slices."""
    ids, low, bits = (np.frombuffer(block[c], np.int64) for c in ("ids", "low", "bits"))
    n, adder = len(ids), Adder(-(-len(ids) // 64))
    flat = np.frombuffer(block["maps"], np.uint64).reshape(-1, adder.words)
    maps = np.split(flat, np.cumsum(bits)[:-1])
    inverse = [~m for m in maps]
    everyone = np.packbits(np.arange(adder.words * 64) < n, bitorder="little").view(np.uint64)
    out = []
    for q_id, q in zip(query_ids.tolist(), queries, strict=True):
        weights: list[list[np.ndarray]] = [[] for _ in range(int(np.abs(q).max()).bit_length() + int(bits.max()) + 1)]
        for d in np.flatnonzero(q).tolist():
            size = abs(int(q[d]))
            for b, m in enumerate(maps[d] if q[d] > 0 else inverse[d]):
                for c in range(size.bit_length()):
                    if size >> c & 1:
                        weights[b + c].append(m)
        total = adder.total(weights)
        alive = everyone.copy()
        a, b = np.searchsorted(ids, q_id, "left"), np.searchsorted(ids, q_id, "right")
        for own in range(a, b):
            alive[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        rows = top_rows(total, alive, k)
        rows = rows[(rows < a) | (rows >= b)]
        # the sum counts |q| * (v - low) where q > 0, and |q| * (2**bits - 1 - (v - low)) where q < 0
        score = np.full(len(rows), q @ low + (np.minimum(q, 0) * ((1 << bits) - 1)).sum())
        for weight, t in enumerate(total):
            score += (t[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << weight
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), q_id), ids[rows][best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query (rows whose id is divisible by `every`) its k best other rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))
    rows = rows.withColumn("spread", F.abs(F.xxhash64("id", F.monotonically_increasing_id()) % (1 << 40)))
    asking = F.col("id") % every == 0
    total, asked, shortest, longest = rows.agg(F.count(F.lit(1)), F.count_if(asking), F.min(F.size("v")), F.max(F.size("v"))).first()
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} to {longest} components")
    blocks = max(1, -(-total * (longest or 1) // COMPONENTS))
    # enough pairs for all tasks of a shuffle, each of as many queries as that allows
    queries = min(MOST, max(FEWEST, -(-asked * blocks // common.shuffle_parts(spark))))
    chunks = max(1, -(-asked // queries))

    def indexed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"block": key[0]} | build(part["id"].to_numpy(), np.stack(part["v"].to_list()))])

    def gathered(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"chunk": key[0], "asks": part["id"].to_numpy().tobytes(), "q": np.stack(part["v"].to_list()).tobytes()}])

    def search(parts):
        for part in parts:
            for pair in part.to_dict("records"):
                asks = np.frombuffer(pair["asks"], np.int64)
                found = search_block(pair, asks, np.frombuffer(pair["q"], np.int64).reshape(len(asks), -1), k)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    common.bound_batches(spark)
    index = rows.withColumn("block", F.col("spread") % blocks).groupBy("block").applyInPandas(indexed, "block long, ids binary, low binary, bits binary, maps binary")
    index = common.stash(index, "topk-index")
    query = rows.where(asking).withColumn("chunk", F.col("spread") % chunks).groupBy("chunk").applyInPandas(gathered, "chunk long, asks binary, q binary")
    query = common.stash(query, "topk-queries")
    dealt = max(common.shuffle_parts(spark), 2 * blocks * chunks)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left, right = index.withColumn("chunk", numbers(chunks)), query.withColumn("block", numbers(blocks))
    pairs = left.repartition(dealt, "block", "chunk").join(right.repartition(dealt, "block", "chunk").hint("merge"), ["block", "chunk"])
    near = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
