"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has a bit set if more than half of its shingles' 64-bit hashes have it set. Fingerprints link
at `distance` or fewer differing bits. They are cut into distance + 1 bands; linked fingerprints agree on one band at
least, so each band is the top pattern of an upper node in which all its links of that band lie. Inside such a node
fingerprints are sorted by Gray rank and grouped by eights into a tree; every group keeps the bits on which all its
members agree (a mask and a pattern). A fingerprint descends the tree, and a group is dropped as a whole once the
differences on its agreed bits exceed the distance. A node with more than NODE fingerprints is parted again by the
bands of the remaining bits before it goes to a task, so no task holds an unbounded group.

Linked fingerprints of one node leave as one link each to the smallest of their cluster, never as all pairs; classes
are the connected components over these links.

Defined results: null, empty and wordless texts have fingerprint zero, which links like any other; equal ids are
separate rows of one document class; null ids count after all others; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Fingerprints that one node may bring to a task before it is parted again.
NODE = 200_000
#: Pairs of a fingerprint and a group that a task looks at together.
FRONT = 250_000
#: Fingerprints of whole nodes that a task takes together.
TOGETHER = 50_000


def fingerprint_many(texts: list[bytes | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    import xxhash

    digest, out, hashes, sizes = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64), [], []
    where, held = [], 0

    def flush():
        nonlocal hashes, sizes, where, held
        if where:
            flat = np.array(hashes, np.uint64)
            ends = np.cumsum(sizes)
            for k, (i, a, b) in enumerate(zip(where, ends - np.array(sizes), ends, strict=True)):
                bits = np.unpackbits(flat[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                set_ = bits.sum(0, dtype=np.int32) * 2 > sizes[k]
                out[i] = np.packbits(set_, bitorder="little").view(np.uint64)[0]
        hashes, sizes, where, held = [], [], [], 0

    for i, text in enumerate(texts):
        words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
        if not words:
            continue
        if len(words) <= shingle:
            hs = [digest(b" ".join(words), seed)]
        else:
            line = b" ".join(words)
            starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
            hs = [digest(line[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])]  # noqa: B905
        hashes += hs
        sizes.append(len(hs))
        where.append(i)
        held += len(hs)
        if held > 100_000:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    common.bound_batches(docs.sparkSession)

    def mark(batches):
        for batch in batches:
            fp = fingerprint_many(batch.column(1).to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("body")).mapInArrow(mark, "id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    out = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def close_pairs(fp: np.ndarray, node: np.ndarray, distance: int):
    """Yield arrays (i, j), i < j, of places in fp with the same node and at most `distance` differing bits.

    node is ascending, and fp is in Gray order within a node.
    """
    n = len(fp)
    if n < 2:
        return
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.append(first, n))
    # the levels of the tree, from groups of up to eight fingerprints to one group a node; a group never spans two nodes
    levels = [(np.arange(n), np.full(n, ~np.uint64(0)), fp, np.arange(n), np.arange(n) + 1, first, size)]
    while (levels[-1][6] > 1).any():
        _, mask, pattern, low, high, f, s = levels[-1]
        groups = -(-s // 8)
        gf = np.cumsum(groups) - groups
        within = np.arange(int(groups.sum())) - np.repeat(gf, groups)
        start = np.repeat(f, groups) + 8 * within
        every, some = np.bitwise_and.reduceat(pattern, start), np.bitwise_or.reduceat(pattern, start)
        agreed = np.bitwise_and.reduceat(mask, start) & ~(every ^ some)
        end = np.minimum(start + 8, np.repeat(f + s, groups))
        levels.append((start, agreed, every & agreed, low[start], high[end - 1], gf, groups))
    top = levels[-1][5]
    root = np.repeat(top, size)
    for a in range(0, n, 16384):
        work = [(len(levels) - 1, np.arange(a, min(n, a + 16384)), root[a : a + 16384])]
        while work:
            level, q, g = work.pop()
            _, mask, pattern, _, high, _, _ = levels[level]
            later = high[g] > q + 1 if level else g > q  # each pair once
            q, g = q[later], g[later]
            keep = np.bitwise_count((fp[q] ^ pattern[g]) & mask[g]) <= distance
            q, g = q[keep], g[keep]
            if not q.size:
                continue
            if not level:
                yield q, g
                continue
            start = levels[level][0]
            below = levels[level - 1]
            total = len(below[1])
            # a group's children run to the next group's first, or to the end of its node
            stop = np.append(start[1:], total)[g]
            count = stop - start[g]
            step = max(1, FRONT // 8)
            for b in range(0, len(q), step):
                c = count[b : b + step]
                at = np.repeat(start[g[b : b + step]] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
                work.append((level - 1, np.repeat(q[b : b + step], c), at))


def smallest_linked(n: int, pairs) -> np.ndarray:
    """For each of n places the smallest place linked with it through pairs."""
    root = np.arange(n)

    def up(x):
        while (root[x] != x).any():
            nxt = root[root[x]]
            root[x] = nxt
            if (nxt == x).all():
                break
            x = np.where(root[nxt] == nxt, nxt, root[nxt])
        return x

    for i, j in pairs:
        while True:
            a, b = up(i), up(j)
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
    while (root[root] != root).any():
        root = root[root]
    return root


def busiest_neighbours(n: int, pairs) -> np.ndarray:
    """For each of n places its neighbour with most neighbours (of equals the first), or -1; pairs() gives them afresh."""
    degree, best = np.zeros(n, np.int64), np.full(n, -1)
    for i, j in pairs():
        degree += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    key = degree * n + np.arange(n)[::-1]
    for i, j in pairs():
        np.maximum.at(best, i, key[j])
        np.maximum.at(best, j, key[i])
    return np.where(best < 0, -1, n - 1 - best % n)


def _link_nodes(distance: int, busiest: bool):
    def link(batches):
        """Rows come sorted by node; whole nodes are taken together, some TOGETHER fingerprints at a time."""

        def solve(node, fp):
            rank = gray_rank(fp)
            order = np.lexsort((rank, node))
            node, fp = node[order], fp[order]
            root = smallest_linked(len(fp), close_pairs(fp, node, distance))
            out = np.flatnonzero(root != np.arange(len(fp)))
            if not out.size:
                return None
            a, b = out, root[out]
            if busiest:
                hub = busiest_neighbours(len(fp), lambda: close_pairs(fp, node, distance))
                linked = np.flatnonzero(hub >= 0)
                a, b = np.concatenate([a, linked]), np.concatenate([b, hub[linked]])
            return pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (a, b)], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            rows += len(batch)
            if rows >= TOGETHER:
                node, fp = (np.concatenate([h[i] for h in held]) for i in range(2))
                cut = int(np.searchsorted(node, node[-1]))
                if cut:
                    if (done := solve(node[:cut], fp[:cut])) is not None:
                        yield done
                held, rows = [(node[cut:], fp[cut:])], len(node) - cut
        if rows:
            if (done := solve(*(np.concatenate([h[i] for h in held]) for i in range(2)))) is not None:
                yield done

    return link


def _bands(fp, bits: list[int], parts: int):
    """The values of `parts` bands over these bit numbers, as columns."""
    cut = [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]
    return [(F.shiftrightunsigned(fp, b[0]).bitwiseAND(F.lit((1 << len(b)) - 1)), b) for b in cut]


def links(distinct: DataFrame, distance: int = 3, busiest: bool = False) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all pairs at `distance` or less.

    With a column seed, only fingerprints of one seed link. With `busiest`, every fingerprint is also linked to that
    one of its neighbours in a node which has most neighbours: the original of a group of copies, where there is one.
    """
    if "seed" not in distinct.columns:
        distinct = distinct.withColumn("seed", F.lit(0))
    parts, bits = distance + 1, list(range(64))
    first = _bands(F.col("fp"), bits, parts)
    keyed = distinct.select("fp", "seed", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), v.alias("value")) for i, (v, _) in enumerate(first)])).alias("k"))
    # (band, value) in one number; a hash would do, but two nodes must not become one
    width = max(len(b) for _, b in first)
    keyed = keyed.select("fp", "k.band", (F.shiftleft((F.col("seed") * parts + F.col("k.band")).cast("long"), width) + F.col("k.value")).alias("node"))
    keyed = common.stash(keyed, "bands")
    full = keyed.groupBy("node").count().where(F.col("count") > NODE).select("node", F.lit(True).alias("full"))
    placed = keyed.join(full, "node", "left")
    rest = []
    for i, (_, own) in enumerate(first):  # the remaining bits of a band's full nodes, rotated so that they are adjacent
        left = [b for b in bits if b not in own]
        low, high = [b for b in left if b < own[0]], [b for b in left if b > own[-1]]
        turned = F.shiftrightunsigned("fp", high[0]) if high else F.lit(0).cast("long")
        if low:
            turned = F.shiftleft(turned, len(low)).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << len(low)) - 1)))
        sub = _bands(turned, list(range(len(left))), parts)
        rest.append(F.when(F.col("band") == i, F.array(*[F.xxhash64(F.lit(j), F.col("node"), v) for j, (v, _) in enumerate(sub)])))
    whole = F.array(F.xxhash64("node"))
    placed = placed.select("fp", F.explode(F.when(F.col("full"), F.coalesce(*rest)).otherwise(whole)).alias("node"))
    common.bound_batches(distinct.sparkSession)
    found = placed.repartition("node").sortWithinPartitions("node").select("node", "fp").mapInArrow(_link_nodes(distance, busiest), "a long, b long")
    found.bands = keyed  # stored; of no use once the links are
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (smallest id reachable over links)."""
    marked = common.stash(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    codes = common.stash(marked.groupBy("fp").agg(F.min("id").alias("least_id")), "codes")
    roots = components(links(codes.select("fp"), distance))
    classes = codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = classes.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of a text's set of words, and the differing bits at which two of them make a candidate.
_SET_SEEDS, _SET_DISTANCE = 12, 4
#: Buckets of the counts that refute candidates before their texts are fetched.
BUCKETS = 256
#: Longs of the parities that refute pairs of the prefix join, 64 buckets each.
PARITIES = 4
_PARITY = [f"p{i}" for i in range(PARITIES)]
#: Frequent shingles that go last in the order of prefixes.
COMMON = 100_000


def set_fingerprints(docs: DataFrame, seeds: int = _SET_SEEDS) -> DataFrame:
    """(row, seed, fp) of docs (row, body): SimHash of the set of a text's words, once a seed."""
    mixes = [np.uint64(m) for m in (np.random.default_rng(11).integers(1, 2**63, seeds, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()]

    def mark(batches):
        import xxhash

        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = np.zeros((seeds, len(texts)), np.uint64)
            for i, text in enumerate(texts):
                words = set((text or b"").lower().split())
                if words:
                    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
                    for s, m in enumerate(mixes):
                        x = h * m
                        x ^= x >> np.uint64(32)
                        x *= m
                        x ^= x >> np.uint64(29)
                        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
                        out[s, i] = np.packbits(bits * 2 > len(h), bitorder="little").view(np.uint64)[0]
            n = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(batch.column(0).to_numpy(zero_copy_only=False), seeds)), pa.array(np.repeat(np.arange(seeds, dtype=np.int32), n)), pa.array(out.ravel().view(np.int64))], names=["row", "seed", "fp"])

    return docs.mapInArrow(mark, "row long, seed int, fp long")


def _similar(rows: DataFrame, edges: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of edges (a, b), rows of `rows` (row, body), whose sets of shingles have this Jaccard similarity or more."""
    import zstandard

    def squeeze(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["row", "packed"])

    def look(batches):
        import xxhash

        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = opener.decompress(packed).lower().split()
                grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
                codes = np.unique(np.array([xxhash.xxh3_64_intdigest(g) for g in grams], np.uint64)).tobytes()
                for at in range(0, len(ends), 256):
                    some = ends[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([e["a"] for e in some], pa.int64()), pa.array([e["b"] for e in some], pa.int64()), pa.array([codes] * len(some), pa.binary())], names=["a", "b", "codes"])

    def compare(batches):
        key, left = None, b""
        for batch in batches:
            out = []
            for a, b, codes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (a, b) != key:
                    key, left = (a, b), codes
                    continue
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(codes, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

    ends = edges.select(F.col("a").alias("row"), "a", "b").unionByName(edges.select(F.col("b").alias("row"), "a", "b"))
    parts = ends.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / 1024).alias("parts"))
    lists = ends.join(parts, "row").groupBy("row", F.pmod(F.xxhash64("a", "b"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("a", "b")).alias("ends"))
    sides = common.join_apart(rows.mapInArrow(squeeze, "row long, packed binary"), lists, ["row"]).select("packed", "ends").mapInArrow(look, "a long, b long, codes binary")
    return sides.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(compare, "a long, b long")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


_HASHES = _Words()
_MIX = np.random.default_rng(13).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_codes(text: bytes, shingle: int) -> np.ndarray:
    """64-bit codes of the set of a text's shingles, ascending; a text of fewer words is one shingle."""
    words = np.array([_HASHES[w] for w in text.lower().split()], np.uint64)
    n = min(len(words), shingle)
    grams = max(1, len(words) - shingle + 1)
    h = np.full(grams, n, np.uint64)
    for i in range(n):
        x = words[i : i + grams] * _MIX[i % 64]
        h = (h ^ (x ^ (x >> np.uint64(32)))) * _MIX[63]
    h ^= h >> np.uint64(31)
    return np.unique(h)


def _set_digests(texts: DataFrame, shingle: int) -> DataFrame:
    """(row, digest, size, sketch, p0, p1, ...) of texts (row, body): 128 bits of each set of shingles, its size, how many of its
    codes fall into each of BUCKETS buckets (null for sets too large to count so), and in which of 64 * PARITIES buckets an odd number do."""

    def mark(batches):
        import xxhash

        common.claim("near", _HASHES)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                codes = shingle_codes(t, shingle)
                counts = np.bincount((codes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                odd = np.bincount((codes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
                bits = np.packbits(odd.astype(bool), bitorder="little").view(np.int64).tolist()
                out.append((xxhash.xxh3_128_digest(codes.tobytes()), len(codes), counts.astype("<u2").tobytes() if counts.max() < 1 << 16 else None, *bits))
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["row", "digest", "size", "sketch", *_PARITY])

    types = (pa.binary(), pa.int32(), pa.binary(), *[pa.int64()] * PARITIES)
    return texts.mapInArrow(mark, "row long, digest binary, size int, sketch binary, " + ", ".join(f"{p} long" for p in _PARITY))


def _possible(edges: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of edges (a, b) that can be this similar: the sums of the lesser counts of each bucket bound what sets share from above."""

    def keep(batches):
        for batch in batches:
            a, b, x, y, left, right = (batch.column(i) for i in range(6))
            counts = [np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, BUCKETS) for c in (left, right)]
            shared = np.minimum(*counts).sum(1, dtype=np.int64) if len(batch) else np.zeros(0, np.int64)
            sizes = x.to_numpy(zero_copy_only=False).astype(np.int64) + y.to_numpy(zero_copy_only=False)
            fine = pa.array(shared >= similarity / (1 + similarity) * sizes - 1e-6)
            yield pa.RecordBatch.from_arrays([a.filter(fine), b.filter(fine)], names=["a", "b"])

    x, y = (sketches.select(F.col("row").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    both = edges.select("a", "b").join(x, "a").join(y, "b").where(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6)
    counted = F.col("sketch_a").isNotNull() & F.col("sketch_b").isNotNull()
    sure = both.where(counted).select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(keep, "a long, b long")
    return sure.unionByName(both.where(~counted).select("a", "b"))


def _common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes that are frequent in a sixteenth of the texts, ascending, and their counts. They only set an order."""

    def emit(batches):
        common.claim("near", _HASHES)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_codes(t, shingle).view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(16)) == 0).select("body").mapInArrow(emit, "h long")
    top = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 8").orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    codes, counts = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(codes)
    return codes[order], counts[order]


def shingle_prefix(codes: np.ndarray, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first codes of a set in the order (how common, code): two sets this similar share one of theirs."""
    known, counts = often
    rank = np.zeros(len(codes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        rank = np.where(known[at] == codes, counts[at], 0)
    need = int(np.ceil(similarity * len(codes) - 1e-9))
    return codes[np.lexsort((codes, rank))[: len(codes) - need + 1]]


def _prefix_pairs(texts: DataFrame, parities: DataFrame, classes: DataFrame, doubles: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows in different classes that can be this similar: all that are, and few others.

    Sets of similarity t share t / (1 + t) of their sizes' sum, the rest differs. Each difference turns one of the parities
    (row, p0, p1, ...) at most, so sets whose parities differ in more places are refuted in the join itself. Two more tests
    hold at the first shingle that two prefixes share, in the common order, which is enough for the pair to be met: it isn't
    preceded by one and the same shingle in both, and what follows it in either set suffices. Shingles are joined, nothing is
    capped; those of one class only, and the rows of `doubles` (sets that another row has), can't add a link and stay out.

    A prefix is stored once, as one array a row. Only codes, rows and places are dealt out to find the codes of several
    classes; all else is added to the few that stay.
    """
    often = _common_shingles(texts, shingle)

    def emit(batches):
        common.claim("near", _HASHES)
        for batch in batches:
            rows, sizes, ends, held = [], [], [0], []

            def done():
                codes = pa.array(np.concatenate(held).view(np.int64))
                return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), codes)], names=["row", "size", "prefix"])

            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = shingle_codes(t, shingle)
                held.append(shingle_prefix(codes, similarity, often))
                rows.append(row)
                sizes.append(len(codes))
                ends.append(ends[-1] + len(held[-1]))
                if ends[-1] > 100_000:
                    yield done()
                    rows, sizes, ends, held = [], [], [0], []
            if rows:
                yield done()

    found = texts.mapInArrow(emit, "row long, size int, prefix array<long>").join(doubles, "row", "left_anti")
    found = found.join(classes.select(F.col("node").alias("row"), "root"), "row", "left")
    found = common.stash(found.select("row", "size", F.coalesce("root", "row").alias("class"), "prefix"), "prefixes")
    mixed = found.select(F.explode("prefix").alias("h"), "class").groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("h")
    mixed = common.stash(mixed, "mixed")
    placed = common.stash(found.select("row", F.posexplode("prefix").alias("place", "h")).join(mixed, "h"), "placed")
    before = F.when(F.col("place") > 0, F.element_at("prefix", F.greatest("place", F.lit(1)))).alias("before")
    kept = placed.join(found, "row").select("h", "row", "size", "place", before, "class").join(parities, "row")
    kept = common.stash(kept, "kept-prefixes")
    common.discard(found, mixed, placed)
    x, y = (kept.select("h", *[F.col(c).alias(f"{c}_{side}") for c in kept.columns if c != "h"]) for side in "ab")
    low, high = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    need = F.ceil(similarity / (1 + similarity) * (low + high) - 1e-6)
    turned = reduce(add, [F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in _PARITY])
    fits = low >= similarity * high - 1e-6
    first = ~F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False))
    enough = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= need
    pairs = x.join(y, "h").where((F.col("row_a") < F.col("row_b")) & (F.col("class_a") != F.col("class_b")) & fits & first & enough & (turned <= low + high - 2 * need))
    pairs = pairs.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct()
    pairs.prefixes = kept  # stored; of no use once the pairs are
    return pairs


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seeds: int = _SET_SEEDS, distance: int = _SET_DISTANCE) -> DataFrame:
    """One row per input row: id_col, component_id, text_sha256, kept, over links of `similarity` or more between sets of
    `shingle`-word shingles. kept: the row of the class with the smallest id, of several rows of that id one.

    Texts with one set of shingles are settled by 128 bits of it. Then candidates are pairs whose word-set fingerprints
    differ in `distance` bits or fewer under one of the seeds, found through the index. Counts of shingles by bucket refute
    most of those that aren't alike; the others are verified on whole texts. The index only finds classes cheaply.
    Whatever it leaves in different classes meets in an exact join on the prefixes of the sets of shingles, which loses no
    pair of this similarity.
    Wordless texts are alike. Rows with null ids keep to themselves only if no id is in their class.
    """
    common.bound_batches(docs.sparkSession)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), body.alias("body"), F.sha2(body, 256).alias("sha"))
    rows = common.stash(rows, "numbered")  # row numbers are those of this table in every job
    digests = common.stash(_set_digests(rows.select("row", "body"), shingle), "set-digests")
    sets = digests.groupBy("digest").agg(F.min("row").alias("rep"))
    equal = common.stash(digests.select("row", "digest").join(sets, "digest").where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b")), "equal")
    marked = common.stash(set_fingerprints(rows.select("row", "body"), seeds), "set-fingerprints")
    codes = common.stash(marked.groupBy("seed", "fp").agg(F.min("row").alias("rep")), "codes")
    same = marked.join(codes, ["seed", "fp"]).where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    near = links(codes.select("fp", "seed"), distance, busiest=True)
    bands = near.bands
    near = near.join(codes.select(F.col("fp").alias("a"), "seed", F.col("rep").alias("x")), "a").join(codes.select(F.col("fp").alias("b"), "seed", F.col("rep").alias("y")), ["b", "seed"])
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b")
    edges = common.stash(same.unionByName(near).select("a", "b").distinct(), "edges")
    common.discard(marked, codes, bands)
    texts, sketches = rows.select("row", "body"), digests.select("row", "size", "sketch")

    def verified(pairs):
        possible = common.stash(_possible(pairs, sketches, similarity), "possible")
        ends = possible.select(F.col("a").alias("row")).union(possible.select(F.col("b").alias("row"))).distinct()
        alike = common.stash(_similar(texts.join(ends, "row", "left_semi"), possible, shingle, similarity), "alike")
        common.discard(possible)
        return alike

    alike = verified(edges).unionByName(equal)
    at = common.stash(components(alike), "classes")
    pairs = _prefix_pairs(texts, digests.select("row", *_PARITY), at, equal.select(F.col("b").alias("row")), shingle, similarity)
    more = verified(pairs.join(edges, ["a", "b"], "left_anti"))
    common.discard(pairs.prefixes, edges, digests, at)
    roots = components(alike.unionByName(more))
    keyed = rows.select("row", "id", "sha").join(roots, F.col("row") == F.col("node"), "left").select("row", "id", "sha", F.coalesce("root", "row").alias("root"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    named = keyed.groupBy("root").agg(F.min("id").alias("component_id"), best)
    out = keyed.join(named, "root").select(F.col("id").alias(id_col), "component_id", F.col("sha").alias("text_sha256"), (F.col("row") == F.col("best.row")).alias("kept"))
    out.numbered = rows  # stored; of no use once the answers are
    return out
