"""Removal of long repeated byte strings through sparse enhanced suffix arrays.

A string of `length` bytes that starts at two places holds, at both, the same anchor: the leftmost of its GRAM-byte
strings whose hash is smallest. Only anchors (about two in each length - GRAM bytes) are suffixes to sort, and suffixes
that share an anchor string form a part of the suffix array of their own, which is how the array is spread out:

1. Each task hashes every anchor string and its whole reach (the bytes of all `length`-byte strings that have it as
   anchor). Anchors whose string occurs once drop out.
2. Occurrences with one and the same reach (64 bits of its bytes beside the 64 of its anchor string) are repeats over all
   of it; they are settled, and one of them stands for all from here on. This is the combining step for groups of copies.
3. The others bring the bytes of their reach. Within a part Spark sorts suffixes by the bytes from the anchor on;
   neighbours' common prefixes are computed, and a stack scan walks the tree of common-prefix intervals. In each interval
   the bytes to the left, sorted from the anchor backwards, tell how far each occurrence extends to the left in common
   with another one; where left extensions differ the repeat is maximal. Each occurrence of a maximal repeat of `length`
   bytes or more gives a span.
4. A part with more than PART suffixes is divided by longer common strings (the core of the `length`-byte strings that
   start in one of some eight ranges left of the anchor), counted with pre-aggregation; a range whose core repeats, but not
   as a whole, is divided further, down to single strings. So no task holds an unbounded part.

Spans are then joined to the texts. Matches never cross documents; every byte of every text takes part.

Defined results: null counts as empty; texts shorter than `length` lose nothing; equal and null ids are separate
documents; an empty table gives no rows; columns besides the two named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 32
#: A part with more suffixes is divided; so small that frequent strings pass it at any size of the table.
PART = 64
#: Bytes that a task hashes together.
CHUNK = 1 << 20
_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = np.uint64((1 << 22) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _finish(x: np.ndarray, salt: int) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9 + 2 * salt)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


class Anchors:
    """Finds anchors in texts; one a task."""

    def __init__(self, length: int):
        self.length, self.reach = length, length - GRAM
        self.up, self.down = _powers(CHUNK + 8 * length + 2)

    def of(self, texts: list[bytes]):
        """Yield arrays (text number, place, hash of the anchor string, hash of its reach)."""
        held, size = [], 0
        for i, text in enumerate(texts):
            windows = len(text) - self.length + 1
            for a in range(0, windows, CHUNK // 2):
                b = min(windows, a + CHUNK // 2)
                low, high = max(0, a - self.length), min(len(text), b + 2 * self.length)
                if size + high - low > CHUNK:
                    yield self._hash(held)
                    held, size = [], 0
                held.append((i, text[low:high], low, a - low, b - low))
                size += high - low
        if held:
            yield self._hash(held)

    def _hash(self, held):
        raw = np.frombuffer(b"".join(h[1] for h in held), np.uint8)
        n, w = len(raw), self.reach + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.up[:n], out=sums[1:])
        grams = n - GRAM + 1
        h = _finish((sums[GRAM:] - sums[:grams]) * self.down[:grams], 0)
        key = np.full(-(-(grams + w) // w) * w, ~np.uint64(0), np.uint64)
        key[:grams] = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64)
        rows = key.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: grams - w + 1], ahead[w - 1 : grams]) & _PLACE
        starts = np.cumsum([0] + [len(x[1]) for x in held])
        number, place, lows, highs = [], [], [], []
        for (i, text, low, a, b), s in zip(held, starts[:-1].tolist(), strict=True):
            p = least[s + a : s + b]
            p = p[np.concatenate([[True], p[1:] != p[:-1]])].astype(np.int64)
            if low + a > 0:  # a later chunk: the anchor of the window before it is in the chunk before
                p = p[p != np.int64(least[s + a - 1])]
            place.append(p)
            number.append(np.full(len(p), i))
            lows.append(np.maximum(p - self.reach, s))
            highs.append(np.minimum(p + self.length, s + len(text)))
            # a chunk's own ends are the text's ends, or lie beyond the reach of its anchors
        p, lo, hi = np.concatenate(place), np.concatenate(lows), np.concatenate(highs)
        whole = memoryview(raw)
        reach = np.array([xxhash.xxh3_64_intdigest(whole[x:y], y - z) for x, y, z in zip(lo.tolist(), hi.tolist(), p.tolist(), strict=True)], np.uint64)
        origin = np.repeat(np.array([x[2] for x in held]) - starts[:-1], [len(x) for x in place])
        return np.concatenate(number), p + origin, h[p], reach


def _batch(columns, names):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    def find(batches):
        finder = Anchors(length)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for number, place, h, reach in finder.of(batch.column(1).to_pylist()):
                yield _batch([keys[number], place.astype(np.int32), h.view(np.int64), reach.view(np.int64)], ["row", "pos", "h", "reach"])

    return rows.mapInArrow(find, "row long, pos int, h long, reach long")


def _intervals(lcp: list[int], least: int, count: int):
    """Yield (first, last, common prefix) of every interval of the tree; lcp[i] belongs to suffixes i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, count + 1):
        here, first = (lcp[i] if i < count else 0), i - 1
        while stack and here < stack[-1][1]:
            first, prefix = stack.pop()
            yield first, i - 1, prefix
        if here >= least and (not stack or here > stack[-1][1]):
            stack.append((first, here))


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    out = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width)
    return out, sizes


def _common(m: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and j."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 65536):
        x, y = i[a : a + 65536], j[a : a + 65536]
        differ = m[x] != m[y]
        at = np.where(differ.any(1), differ.argmax(1), m.shape[1])
        out[a : a + 65536] = np.minimum(at, np.minimum(size[x], size[y]))
    return out


def repeat_spans(h: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, bytes to the left, bytes to the right) of occurrences of maximal repeats of `length` bytes or more.

    Suffixes are sorted by h and right; left holds the bytes before the anchor, backwards.
    """
    right_m, right_n = _matrix(right, length)
    left_m, left_n = _matrix(left, length - GRAM)
    n = len(h)
    place = np.arange(n)
    lcp = np.zeros(n, np.int64)
    same = np.flatnonzero(h[1:] == h[:-1]) + 1
    lcp[same] = _common(right_m, right_n, same - 1, same)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(first, n))
    which, members, prefix = [], [], []
    count = 0
    values = lcp.tolist()
    for f, s in zip(first.tolist(), sizes.tolist(), strict=True):
        if s == 1:
            continue
        found = [(0, 1, values[f + 1])] if s == 2 else _intervals(values[f : f + s], GRAM, s)
        for a, b, r in found:
            if r >= GRAM:
                members.append(place[f + a : f + b + 1])
                which.append(np.full(b - a + 1, count))
                prefix.append(r)
                count += 1
    if not count:
        return place[:0], place[:0], place[:0]
    which, members, prefix = np.concatenate(which), np.concatenate(members), np.array(prefix)
    words = np.pad(left_m, ((0, 0), (0, -left_m.shape[1] % 8))).view(">u8")
    by_left = np.empty(n, np.int64)
    by_left[np.lexsort((left_n, *words.T[::-1]))] = place
    order = np.lexsort((by_left[members], which))
    which, members = which[order], members[order]
    common_left = np.zeros(len(members), np.int64)
    next_to = np.flatnonzero(which[1:] == which[:-1])
    shared = _common(left_m, left_n, members[next_to], members[next_to + 1])
    np.maximum.at(common_left, next_to, shared)
    np.maximum.at(common_left, next_to + 1, shared)
    reach = prefix[which]
    long_ = common_left + reach >= length
    return members[long_], common_left[long_], reach[long_]


def _spans(contexts: DataFrame, length: int) -> DataFrame:
    def scan(batches):
        def solve(held):
            h, row, pos, single, left, right = (np.concatenate([b[i] for b in held]) if i < 4 else [x for b in held for x in b[i]] for i in range(6))
            i, before, after = repeat_spans(h, left, right, length)
            own = single[i]  # the copies of one reach are settled
            i, before, after = i[own], before[own], after[own]
            return _batch([row[i], (pos[i] - before).astype(np.int32), (pos[i] + after).astype(np.int32)], ["row", "low", "high"])

        held, size = [], 0
        for batch in batches:
            col = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)] + [batch.column(k).to_pylist() for k in (4, 5)]
            held.append(col)
            size += len(batch)
            if size >= 8192:
                col = [np.concatenate([b[k] for b in held]) if k < 4 else [x for b in held for x in b[k]] for k in range(6)]
                cut = int(np.flatnonzero(col[0] != col[0][-1])[-1]) + 1 if col[0][0] != col[0][-1] else 0
                if cut:
                    yield solve([[c[:cut] for c in col]])
                held, size = [[c[cut:] for c in col]], len(col[0]) - cut
        if size:
            yield solve(held)

    ranked = contexts.repartition("h").sortWithinPartitions("h", "after", "row", "pos")
    return ranked.select("h", "row", "pos", "single", "before", "after").mapInArrow(scan, "row long, low int, high int")


def _divide(hot: DataFrame, length: int) -> DataFrame:
    """Spans of the parts with too many suffixes, by counting the cores and then the strings themselves."""
    reach = length - GRAM

    def digest(*parts) -> int:
        return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)

    def cores(outer: int, width: int):
        def cut(batches):
            for batch in batches:
                rows = []
                for h, row, pos, before, after, lows in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    text, at = before[::-1] + after, len(before)
                    for low in (x for start in lows for x in range(start, min(start + outer, reach + 1), width)):
                        high = min(low + width - 1, reach)
                        a, b = at - low, at + length - high  # bytes of all strings that start low to high bytes before the anchor
                        if a >= 0 and b <= len(text):
                            x, y = max(0, at - high), min(len(text), at + length - low)
                            head = b"%d %d " % (h, low)
                            rows.append((digest(head, text[a:b]), digest(head, b"%d %d " % (at - x, y - at), text[x:y]), row, pos, low))
                yield _batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["core", "whole", "row", "pos", "low"])

        return cut

    texts, outer, out = hot.withColumn("lows", F.array(F.lit(0))), reach + 1, None
    for width in (5 * -(-outer // 40), 5, 1):  # each a multiple of the next, so that ranges nest
        cut = texts.select("h", "row", "pos", "before", "after", "lows").mapInArrow(cores(outer, width), "core long, whole long, row long, pos int, low int")
        pieces = common.stash(cut, "cores")
        classes = pieces.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "pos", "low")).alias("one"))
        settled = pieces.join(classes.where("n > 1").select("core", "whole"), ["core", "whole"])
        far = F.least(F.col("low") + (width - 1), F.lit(reach))
        settled = settled.select("row", (F.col("pos") - far).alias("low"), (F.col("pos") - F.col("low") + length).alias("high"))
        settled = common.stash(settled.groupBy("row", "low").agg(F.max("high").alias("high")), "settled")
        out = settled if out is None else out.unionByName(settled)
        # one of each class goes on, settled ones too: others may share a part with it
        several = classes.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core")
        on = classes.join(several, "core").groupBy("one.row", "one.pos").agg(F.collect_list("one.low").alias("lows"))
        texts = hot.join(common.stash(on, "divided"), ["row", "pos"])
        common.discard(pieces)
        outer = width
    return out


def _packed(rows: DataFrame) -> DataFrame:
    """(row, packed): texts compressed one by one, so that they are cheap to shuffle."""

    def squeeze(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield _batch([batch.column(0), pa.array([packer.compress(t) for t in batch.column(1).to_pylist()], pa.binary())], ["row", "packed"])

    return rows.mapInArrow(squeeze, "row long, packed binary")


def _contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (row, pos, h, single) with the bytes before the anchor, backwards, and from the anchor on."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("pos", "h", "single")).alias("at"))

    def look(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row, packed, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = opener.decompress(packed)
                for x in at:
                    p = x["pos"]
                    out.append((row, p, x["h"], x["single"], text[max(0, p - length + GRAM) : p][::-1], text[p : p + length]))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield _batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], ["row", "pos", "h", "single", "before", "after"])

    joined = _packed(rows).join(lists, "row").select("row", "packed", "at")
    return joined.mapInArrow(look, "row long, pos int, h long, single boolean, before binary, after binary")


def spans(rows: DataFrame, length: int) -> DataFrame:
    """(row, low, high), perhaps overlapping: bytes of strings of `length` bytes that start at two places or more."""
    found = common.stash(_anchors(rows, length), "anchors")
    twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = common.stash(common.join_counted(found, twice, ["h"], found.count()), "anchors")
    common.discard(found)
    # counts of each reach, and for each anchor string the number of different reaches: both pre-aggregated
    reaches = common.stash(again.groupBy("h", "reach").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "pos")).alias("one")), "reaches")
    many = reaches.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    settled = common.join_counted(again, reaches.where("n > 1").select("h", "reach", "n"), ["h", "reach"], again.count()).select("row", "pos")
    settled = settled.select("row", (F.col("pos") - (length - GRAM)).alias("low"), (F.col("pos") + length).alias("high"))
    wanted = reaches.join(many, "h").select("one.row", "one.pos", "h", (F.col("n") == 1).alias("single"), (F.col("kinds") > PART).alias("hot"))
    contexts = common.stash(_contexts(rows, wanted.drop("hot"), length), "contexts")
    hot = many.where(F.col("kinds") > PART).select("h", F.lit(True).alias("hot"))
    placed = contexts.join(hot, "h", "left")
    large = placed.where("hot")
    return settled.unionByName(_spans(placed.where("hot is null"), length)).unionByName(_divide(large, length))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256 (and with_text: kept, the remaining bytes)."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    common.bound_batches(docs.sparkSession)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), body.alias("body"))
    rows = common.stash(rows, "numbered")  # row numbers are those of this table in every job
    # spans of a row in few numbers: low and high together, without those that another one of the same start covers
    marks = spans(rows.select("row", "body"), length).groupBy("row", "low").agg(F.max("high").alias("high"))
    lists = common.stash(marks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("at")), "spans")

    def cut(text: bytes, at) -> tuple[int, int, bytes]:
        kept, end, removed, count = [], 0, 0, 0
        edge = -1
        for x in at:
            low, high = max(0, x["low"]), min(len(text), x["high"])
            if low > edge:
                kept.append(text[end:low])
                count += 1
                removed += high - low
                end = edge = high
            elif high > edge:
                removed += high - edge
                end = edge = high
        kept.append(text[end:])
        return removed, count, b"".join(kept)

    kinds = [("id", pa.int64(), "long"), ("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    kinds += [("kept", pa.binary(), "binary")] * with_text

    def finish(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for i, packed, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = opener.decompress(packed)
                removed, count, kept = cut(text, at or [])
                out.append((i, len(text), removed, count, hashlib.sha256(kept).hexdigest(), kept)[: len(kinds)])
            yield _batch([pa.array(c, t) for c, (_, t, _) in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], [k for k, _, _ in kinds])

    def squeeze(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield _batch([batch.column(0), batch.column(1), pa.array([packer.compress(t) for t in batch.column(2).to_pylist()], pa.binary())], ["row", "id", "packed"])

    packed = rows.mapInArrow(squeeze, "row long, id long, packed binary")
    done = packed.join(lists, "row", "left").select("id", "packed", "at").mapInArrow(finish, ", ".join(f"{k} {s}" for k, _, s in kinds))
    return done.withColumnRenamed("id", id_col)
