"""Fuzzy passages that several documents share, by collinear chaining of k-mer seeds.

1. Seeds are the K-word strings of lower-cased words whose hash is below a threshold (one in SPARSE): edits elsewhere don't
   change which these are. A seed goes with codes of the words to its right.
2. Occurrences of a seed are sorted by the words to the right. Each is matched with the first one of them and with its
   neighbour in this order, so m occurrences give fewer than 2 m matches and never all pairs. No match is dropped for the
   words around it: the alignment judges.
3. Besides, each string of min_words words is settled exactly: it has an anchor, its ANCHOR-word string of smallest hash.
   Anchors with equal words all around are matched with the first of these; where they differ, the strings themselves are
   hashed and each is matched with its first occurrence.
4. The matches of two documents are merged along diagonals and chained: each is worth its words, a step costs COST for each
   word of gap on either side, and the best chain that ends in a match is a prefix maximum, kept in a Fenwick tree.
   A chain of one seed goes if short codes of the words beside it show that its alignment can't get past them; most are
   seeds that unrelated documents share by chance, ever more of them in a larger table.
5. Chains are aligned word by word: inside matches, in the gaps between them, and beyond their ends until edits outweigh
   matches. Parts of min_words words or more and min_identity of matched words are passages; a gap too bad for that parts
   two of them.

Frequent seeds are met in a small sample first and spread over SALTS tasks by row; what stands first in each is matched with
what stands first in all.

Defined results: null and empty texts hold no passage; passages inside one document are none; equal and null ids are
separate documents; an empty table gives no rows; columns besides the two named are not read.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, SPARSE, COST = 5, 7, 0.1
#: Words to the right of a seed that its occurrences are sorted by.
AROUND = 8
#: Words on either side of a seed, of CODE bits each, that tell whether an alignment can start from it alone.
BESIDE, CODE = 12, 5
#: Matched words that an edit outweighs in an alignment; each is tried, the longest passage that is accepted counts.
PENALTIES = (1.5, 4.0, 1e9)
#: Words of an anchor: long enough to be rare outside of passages that are repeated word for word.
ANCHOR = 12
#: Matches on one diagonal with at most so many words between them are one.
MERGED = 40
#: Chains of one document that are looked up together.
LIST = 512
#: One document in SAMPLE tells frequent seeds: those in one of FREQUENT sampled documents. They are spread over SALTS tasks.
SAMPLE, FREQUENT, SALTS = 64, 100, 64
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_MIX = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 22) - 1)
#: Bytes from which a word is hashed by itself.
LONG_WORD = 64
#: Words that are numbered together; longer texts come in overlapping pieces.
PIECE = 2_000_000


def _word_codes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all at a time; words of up to eight bytes never get the same one."""
    n = len(words)
    _, offsets, data = words.buffers()
    if not n or data is None:
        return np.zeros(n, np.uint64)
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = np.concatenate([np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)])
    at, size = offsets[:-1] - offsets[0], np.diff(offsets)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out, left, done = np.zeros(n, np.uint64), np.arange(n), 0
    while len(left):
        h = (out[left] ^ (eight[at[left] + done] & mask[np.minimum(size[left] - done, 8)])) * _MIX[61]
        h ^= h >> np.uint64(32)
        h *= _MIX[60]
        out[left] = h ^ (h >> np.uint64(29))
        done += 8
        left = left[size[left] > done]
        if done >= LONG_WORD and len(left):
            out[left] = [xxhash.xxh3_64_intdigest(words[i].as_buffer()) for i in left.tolist()]
            break
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lower-cased words of texts one after another, and where each text begins (and the last ends)."""
    low = pc.ascii_lower(pc.ascii_trim_whitespace(texts.cast(pa.string())))
    words = pc.ascii_split_whitespace(low)
    sizes = np.where(pc.binary_length(low).to_numpy(zero_copy_only=False) > 0, np.diff(words.offsets.to_numpy()), 0)
    flat = words.flatten()
    return _word_codes(flat.filter(pc.greater(pc.binary_length(flat), 0))), np.concatenate([[0], np.cumsum(sizes)])


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += words[i : i + n] * _MIX[i]
    h ^= h >> np.uint64(31)
    h *= _MIX[63]
    h ^= h >> np.uint64(29)
    return h


def seeds_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among all words, hash, codes of the words to the right) of the seeds of texts."""
    number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = _grams(words, K)
    at = np.flatnonzero((h < np.uint64(2**64 // SPARSE)) & (number[: len(h)] == number[K - 1 :]))
    # texts with AROUND words without a code between them, so that nothing is read across their ends
    place = np.arange(len(words)) + AROUND * (number + 1)
    codes = np.zeros(len(words) + AROUND * (len(bounds) + 1), np.uint64)
    codes[place] = (words * _MIX[50]) >> np.uint64(56)
    right, here = np.zeros(len(at), np.uint64), place[at]
    for i in range(AROUND):
        right |= codes[here + K + i] << np.uint64(56 - 8 * i)
    return at, h[at], right


def beside_seeds(words: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the BESIDE words to the left and to the right of seeds at these places, the nearest one in the lowest bits; 0 where a text has ended."""
    number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(words)) + BESIDE * (number + 1)
    codes = np.zeros(len(words) + BESIDE * (len(bounds) + 1) + K, np.uint64)
    # of the bits that alignments compare
    codes[place] = ((words >> np.uint64(32)) * _MIX[51]) >> np.uint64(64 - CODE)
    left, right, here = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), place[at]
    for i in range(BESIDE):
        left |= codes[here - 1 - i] << np.uint64(CODE * i)
        right |= codes[here + K + i] << np.uint64(CODE * i)
    return left.view(np.int64), right.view(np.int64)


def stuck(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether alignments can't get further than one word into what these codes (of beside_seeds, negative: not known) stand for.

    _trace passes a first edit only over three words that the next eleven of both texts share, or over two that the next four
    share. Seen from the seed's end these lie in the first twelve and five words if one word at most precedes the edit; if two
    did, they were two that the first five share.
    """
    out = (a >= 0) & (b >= 0)
    for n, within in ((3, BESIDE), (2, 5)):
        x, y = ([((c >> (CODE * i)) & ((1 << CODE * n) - 1)).astype(np.uint16) for i in range(within - n + 1)] for c in (a, b))
        for p in x:
            for q in y:
                out &= p != q
    return out


def minimisers(words: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first word) of the k-word string of smallest hash of each window that lies in one text."""
    h = _grams(words, k)
    grams = len(h)
    if grams < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.full(-(-(grams + window) // window) * window, ~np.uint64(0), np.uint64)
    key[:grams] = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64)
    rows = key.reshape(-1, window)
    ahead, back = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[: grams - window + 1], ahead[window - 1 : grams]) & _PLACE).astype(np.int64)
    number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.flatnonzero(number[: len(least)] == number[window + k - 2 : window + k - 2 + len(least)])
    p = least[first]
    return p, h[p], first


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


_SEEDS = "h long, ctx long, row long, at long, salt int, left long, right long"


def _pieces(words: np.ndarray, bounds: np.ndarray, overlap: int):
    """(words, bounds, number of the first text, its words before the piece) of some PIECE words; long texts come in overlapping pieces."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PIECE, "right")) - 1)
        size = bounds[i + 1] - bounds[i]
        if j == i + 1 and size > PIECE:
            for a in range(0, size, PIECE):
                end = min(size, a + PIECE + overlap)
                low = max(0, a - overlap)
                yield words[bounds[i] + low : bounds[i] + end], np.array([0, end - low]), i, low, a - low if a else 0
        else:
            yield words[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i, 0, 0
        i = j


def _found(rows: DataFrame, min_words: int, frequent: np.ndarray) -> DataFrame:
    """Seeds (ctx: the words to the right; left, right: codes of the words beside) and, with odd h, anchors (ctx: all words around).
    at: the place, and in the lower half how many words before it an anchor's ctx has."""
    k = min(ANCHOR, min_words)
    window = min_words - k + 1

    def find(batches):
        def out(keys, h, ctx, pos, side, left, right):
            salt = np.where(np.isin(h, frequent), (keys.astype(np.uint64) * _MIX[40] >> np.uint64(40)).astype(np.int64) % SALTS, 0)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), ctx.view(np.int64), keys, pos << 32 | side, salt.astype(np.int32), left, right)], names=["h", "ctx", "row", "at", "salt", "left", "right"])

        common.claim("passages")
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for words, bounds, text, before, fresh in _pieces(*word_hashes(batch.column(1)), 2 * min_words):
                number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                at, h, right = seeds_of(words, bounds)
                new = at >= fresh  # what a piece shares with the one before it is found there
                at, h, right = (x[new] for x in (at, h, right))
                beside = beside_seeds(words, bounds, at)
                if before or len(words) > PIECE:  # a piece's ends aren't those of the text
                    cut = (at < BESIDE) | (at + K + BESIDE > len(words))
                    beside = [np.where(cut, -1, c) for c in beside]
                yield out(keys[text + number[at]], h & ~np.uint64(1), right, at - bounds[number[at]] + before, np.zeros(len(at), np.int64), *beside)
                p, _, _ = minimisers(words, bounds, k, window)
                p = np.unique(p)
                hs, low, high = _grams(words, k)[p], np.maximum(p - window + 1, bounds[number[p]]), np.minimum(p + min_words, bounds[number[p] + 1])
                raw = memoryview(words.tobytes())
                reach = np.array([xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b], c - a) for a, b, c in zip(low.tolist(), high.tolist(), p.tolist(), strict=True)], np.uint64)
                yield out(keys[text + number[p]], hs | np.uint64(1), reach, p - bounds[number[p]] + before, p - low, *[np.zeros(len(p), np.int64)] * 2)

    return rows.mapInArrow(find, _SEEDS)


#: kind 0: words x to x + size of row are words y on of other; 1: an anchor (x) with other words around it elsewhere; 2: the
#: first occurrence (row, x) of a frequent seed (other: its hash) in a task. alone: no alignment from this seed alone gets past the words beside it.
_MATCHES = "kind int, row long, other long, x int, y int, size int, alone boolean"


def _linked(found: DataFrame, frequent: np.ndarray, k: int) -> DataFrame:
    frequent = frequent.view(np.int64)

    def link(batches):
        def solve(h, ctx, row, at, left, right):
            """Whole groups, in any order within one."""
            new = np.concatenate([[True], h[1:] != h[:-1]])
            group = np.cumsum(new) - 1
            count = np.bincount(group)
            hot = np.isin(h[new], frequent)
            stays = ((count > 1) | hot)[group]
            if not stays.any():
                return None
            order = np.flatnonzero(stays)
            order = order[np.lexsort((at[order], row[order], ctx[order], h[order]))]
            h, ctx, row, at, left, right = (c[order] for c in (h, ctx, row, at, left, right))
            pos, side = at >> 32, at & 0xFFFFFFFF
            new = np.concatenate([[True], h[1:] != h[:-1]])
            group, hot = np.cumsum(new) - 1, np.isin(h[new], frequent)
            order = np.lexsort((pos, row, group))
            first = order[np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))]
            odd, i = (h & 1).astype(bool), np.arange(len(h))
            one = first[group]
            out = []

            def emit(kind, a, b, x, y, size, alone=False):
                full = lambda v: v if isinstance(v, np.ndarray) else np.full(len(a), v)
                out.append([full(kind), a, full(b), x, full(y), full(size), full(alone)])

            # seeds: with the first one, and with the neighbour in the order of the words to the right
            near = np.maximum(i - 1, 0)
            beside = ~odd & (i > 0) & (group[near] == group) & (near != one)
            a, b = np.concatenate([i[~odd], i[beside]]), np.concatenate([one[~odd], near[beside]])
            a, b = np.where(row[a] > row[b], a, b), np.where(row[a] > row[b], b, a)
            other = row[a] != row[b]
            a, b = a[other], b[other]
            emit(0, row[a], row[b], pos[a], pos[b], K, stuck(left[a], left[b]) & stuck(right[a], right[b]))
            # anchors: with the first one of the same words around, and the first ones themselves where there are several kinds
            class_ = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])])) - 1
            starts = np.flatnonzero(np.concatenate([[True], class_[1:] != class_[:-1]]))
            head, kinds = starts[class_], np.bincount(group[starts])
            a = i[odd & (row != row[head])]
            b, before = head[a], side[a]
            emit(0, row[a], row[b], pos[a] - before, pos[b] - before, before + k)
            a = i[odd & (row == row[head]) & ((kinds > 1) | hot)[group]]
            emit(1, row[a], 0, pos[a], 0, 0)
            a = first[hot & ~odd[first]]
            emit(2, row[a], h[a], pos[a], 0, 0)
            columns = [np.concatenate([o[c] for o in out]) for c in range(7)]
            kinds = (np.int32, np.int64, np.int64, np.int32, np.int32, np.int32, np.bool_)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, kinds, strict=True)], names=["kind", "row", "other", "x", "y", "size", "alone"])

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)])
            size += len(batch)
            if size >= 200_000:
                columns = [np.concatenate([x[c] for x in held]) for c in range(6)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last group may go on
                if cut and (done := solve(*(c[:cut] for c in columns))) is not None:
                    yield done
                held, size = [[c[cut:] for c in columns]], size - cut
        if size and (done := solve(*(np.concatenate([x[c] for x in held]) for c in range(6)))) is not None:
            yield done

    # Spark sorts by one long far faster than by four; most seeds stand alone, and those that don't are sorted in the tasks
    parted = found.repartition("h", "salt").select("h", "ctx", "row", "at", "left", "right").sortWithinPartitions("h")
    return parted.mapInArrow(link, _MATCHES)


def _frequent(rows: DataFrame, min_words: int) -> np.ndarray:
    """Seeds and anchors in one of FREQUENT sampled documents at least: FREQUENT times the mean number a document at most. They
    only tell which rows are spread, not what is found."""
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    found = _found(some, min_words, np.zeros(0, np.uint64)).groupBy("h").agg(F.count_distinct("row").alias("n")).where("n >= 16")
    least = max(16, some.count() // FREQUENT)
    return np.array(sorted(r["h"] for r in found.where(F.col("n") >= least).select("h").collect()), np.int64).view(np.uint64)


def _strings(packed: DataFrame, anchors: DataFrame, min_words: int) -> DataFrame:
    """Matches of the strings of min_words words that have one of these anchors (row, x) with their first occurrences, as runs."""
    k = min(ANCHOR, min_words)
    window = min_words - k + 1
    lists = anchors.groupBy("row").agg(F.collect_set("x").alias("at"))

    def strings(batches):
        opener, base = zstandard.ZstdDecompressor(), int(_MIX[62])
        factors = np.array([pow(base, i, 2**64) for i in range(min_words)], np.uint64)
        for batch in batches:
            flat, bounds = word_hashes(pa.array([opener.decompress(t) for t in batch.column(1).to_pylist()], pa.binary()))
            for j, (row, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                every, places = flat[bounds[j] : bounds[j + 1]], np.array(at, np.int64)
                # pieces overlap by what a string has beyond its first word, so that each string is in one of them
                for a in range(0, len(every), PIECE):
                    words = every[a : a + PIECE + min_words - 1]
                    p, _, first = minimisers(words, np.array([0, len(words)]), k, window)
                    first = first[np.isin(p + a, places)]
                    if not len(first):
                        continue
                    low, high = int(first[0]), int(first[-1]) + min_words
                    mixed = words[low:high] ^ (words[low:high] >> np.uint64(29))
                    for b in range(0, len(first), 65536):
                        some = first[b : b + 65536]
                        h = np.zeros(len(some), np.uint64)
                        for i in range(min_words):
                            h += mixed[some + (i - low)] * factors[i]
                        h ^= h >> np.uint64(31)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row)), pa.array((some + a).astype(np.int32)), pa.array(h.view(np.int64))], names=["row", "pos", "h"])

    whole = common.stash(common.join_apart(packed.select("row", "packed"), lists, ["row"]).select("row", "packed", "at").mapInArrow(strings, "row long, pos int, h long"), "strings")
    first = whole.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "pos")).alias("one")).where("n > 1").select("h", "n", "one")
    same = common.join_counted(whole, first, ["h"], whole.count()).where(F.col("row") != F.col("one.row"))
    same = same.select("row", F.col("one.row").alias("other"), "pos", (F.col("one.pos") - F.col("pos")).alias("by"))
    # neighbouring strings with neighbouring first occurrences are one run
    order = Window.partitionBy("row", "other", "by").orderBy("pos")
    runs = same.withColumn("run", F.col("pos") - F.row_number().over(order)).groupBy("row", "other", "by", "run").agg(F.min("pos").alias("x"), F.max("pos").alias("last"))
    return runs.select("row", "other", "x", (F.col("x") + F.col("by")).alias("y"), (F.col("last") - F.col("x") + min_words).alias("size"))


def chains(x: list[int], y: list[int], size: list[int] | None = None, least: int = 2) -> list[list[int]]:
    """Chains of matches (x ascending), best first, each match in one at most; those of fewer than `least` matches left out.

    A match follows another one that ends before it in both texts; matches of several words may overlap by a few."""
    n = len(x)
    worth = size or [K] * n
    ends = [max(1, s - K + 1) if size else 1 for s in worth]
    x_end, y_end = [a + e for a, e in zip(x, ends, strict=True)], [b + e for b, e in zip(y, ends, strict=True)]
    marks = sorted(set(y_end))
    rank = {v: i + 1 for i, v in enumerate(marks)}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(rank) + 1)
    score, before = [0.0] * n, [-1] * n
    ending, done = sorted(range(n), key=x_end.__getitem__), 0
    for i in range(n):
        while done < n and x_end[ending[done]] <= x[i]:
            j = ending[done]
            done += 1
            entry, r = (score[j] + COST * (x_end[j] + y_end[j]), j), rank[y_end[j]]
            while r <= len(rank):
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        best, r = (-1e18, -1), bisect.bisect_right(marks, y[i])
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        gain = best[0] - COST * (x[i] + y[i])
        score[i], before[i] = (worth[i] + gain, best[1]) if gain > 0 else (worth[i], -1)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if len(chain) >= least:
            out.append(chain[::-1])
    return out


def _chained(matches: DataFrame) -> DataFrame:
    """(row, other, chain, x, y, size): chains as arrays of merged matches, without those of one seed that has no passage alone."""
    kinds = [("row", pa.int64()), ("other", pa.int64()), ("chain", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("x", "y", "size"))]

    def run(batches):
        def solve(row, other, x, y, size, alone):
            key = np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | ((x - y)[1:] != (x - y)[:-1])])
            lane = np.cumsum(key) - 1
            wide = np.int64(1 << 33)
            end = np.maximum.accumulate(lane * wide + x + size)  # the furthest end on this diagonal so far
            start = np.flatnonzero(key | np.concatenate([[True], lane[1:] * wide + x[1:] > end[:-1] + MERGED]))
            last = np.append(start[1:], len(x)) - 1
            alone = np.minimum.reduceat(alone, start) > 0
            row, other, x, y, size = row[start], other[start], x[start], y[start], (end[last] - lane[last] * wide) - x[start]
            alone &= size == K
            pair = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])]))
            out = []
            for a, b in zip(pair.tolist(), [*pair[1:].tolist(), len(row)], strict=True):
                if b - a == 1:
                    if alone[a]:
                        continue
                    out.append((int(row[a]), int(other[a]), 0, [int(x[a])], [int(y[a])], [int(size[a])]))
                    continue
                order = np.lexsort((y[a:b], x[a:b])) + a
                xs, ys, ns = x[order].tolist(), y[order].tolist(), size[order].tolist()
                out += [(int(row[a]), int(other[a]), k, [xs[i] for i in c], [ys[i] for i in c], [ns[i] for i in c]) for k, c in enumerate(chains(xs, ys, ns, 1)) if len(c) > 1 or not alone[order[c[0]]]]
            return _batch(out, kinds)

        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(6)])
            rows += len(batch)
            if rows >= 50_000:
                columns = [np.concatenate([h[c] for h in held]) for c in range(6)]
                cut = int(np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))[-1]) + 1 if ((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1])).any() else 0
                if cut:
                    yield solve(*(c[:cut] for c in columns))
                held, rows = [[c[cut:] for c in columns]], rows - cut
        if rows:
            yield solve(*(np.concatenate([h[c] for h in held]) for c in range(6)))

    sorted_ = matches.withColumn("by", F.col("x") - F.col("y")).repartition("row", "other").sortWithinPartitions("row", "other", "by", "x")
    return sorted_.select("row", "other", "x", "y", "size", "alone").mapInArrow(run, "row long, other long, chain int, x array<int>, y array<int>, size array<int>")


#: Words of either text that an edit may skip, the least skipped first; in the last words of a passage two are enough to go on.
_SKIPS = [(p, q) for d in range(1, 9) for p, q in [(d, d), *((d, q) for q in range(d)), *((p, d) for p in range(d))]]
_SHORT_SKIPS = [x for x in _SKIPS if max(x) <= 2]


def _trace(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(words of a, words of b, matched, edits) after each run of equal words of prefixes, until edits outweigh matches."""
    la, lb = a.tolist(), b.tolist()
    i = j = matched = edits = 0
    top, least, out = 0.0, min(PENALTIES), []
    while i < len(la) and j < len(lb):
        if la[i] == lb[j]:
            n = next((k for k, (x, y) in enumerate(zip(la[i:], lb[j:])) if x != y), min(len(la) - i, len(lb) - j))  # noqa: B905
            i, j, matched = i + n, j + n, matched + n
            out.append((i, j, matched, edits))
            top = max(top, matched - least * edits)
            continue
        wa, wb = la[i : i + 11], lb[j : j + 11]
        x, y = list(zip(wa, wa[1:], wa[2:])), list(zip(wb, wb[1:], wb[2:]))  # noqa: B905
        found = None
        if not set(x).isdisjoint(y):
            found = next(((p, q) for p, q in _SKIPS if p < len(x) and q < len(y) and x[p] == y[q]), None)
        if not found:
            x, y = list(zip(wa[:4], wa[1:4])), list(zip(wb[:4], wb[1:4]))  # noqa: B905
            if set(x).isdisjoint(y):
                break
            found = next(((p, q) for p, q in _SHORT_SKIPS if p < len(x) and q < len(y) and x[p] == y[q]), None)
            if not found:
                break
        i, j, edits = i + found[0], j + found[1], edits + max(found)
        if matched - least * edits < top - 60:
            break
    return out


def _extend(trace: list[tuple[int, int, int, int]], penalty: float) -> tuple[int, int, int, int]:
    """The best place of a trace; it ends once edits outweigh matches."""
    best, top, before = (0, 0, 0, 0), 0.0, 0
    for x in trace:
        if before - penalty * x[3] < top - 60:
            break
        before = x[2]
        if before - penalty * x[3] > top:
            top, best = before - penalty * x[3], x
    return best


def _between(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(matched words, edits) of the best alignment of two gaps; wide ones count as replaced."""
    n, m = len(a), len(b)
    if not n or not m or n * m > 4096:
        return 0, max(n, m)
    rows, width = a.tolist(), b.tolist()
    if set(rows).isdisjoint(width):
        return 0, max(n, m)
    # fewest edits, and of these the most words matched: edits times EDIT less the words
    edit = 1 << 13
    above = list(range(0, (m + 1) * edit, edit))
    for i, word in enumerate(rows):
        last = (i + 1) * edit
        line = [last]
        for other, here, up in zip(width, above, above[1:]):  # noqa: B905
            here = here - 1 if word == other else here + edit
            last = min(here, up + edit, last + edit)
            line.append(last)
        above = line
    edits = -(-above[m] // edit)
    return edits * edit - above[m], edits


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]], min_words: int, min_identity: float) -> list[tuple[int, int, int, int, int, int]]:
    """Passages (start and end in a, start and end in b, matched words, edits) along a chain of matches (x, y, size)."""
    steps = []  # (words of a, words of b, matched, edits)
    at, to = chain[0][0], chain[0][1]
    for x, y, size in chain:
        skip = max(0, at - x, to - y)  # matches may overlap
        if skip >= size:
            continue
        x, y, size = x + skip, y + skip, size - skip
        if x > at or y > to:
            steps.append((x - at, y - to, *_between(a[at:x], b[to:y])))
        equal = a[x : x + size] == b[y : y + size]
        cut = [0, *(np.flatnonzero(equal[1:] != equal[:-1]) + 1).tolist(), len(equal)]
        steps += [(n - m, n - m, n - m, 0) if equal[m] else (n - m, n - m, 0, n - m) for m, n in zip(cut[:-1], cut[1:], strict=True)]
        at, to = x + size, y + size
    first_a, first_b = chain[0][0], chain[0][1]
    found, ends = [], {}

    def beyond(hi_a, hi_b, penalty):
        if (1, hi_a, hi_b) not in ends:
            ends[1, hi_a, hi_b] = _trace(a[hi_a:], b[hi_b:])
        return _extend(ends[1, hi_a, hi_b], penalty)

    def ahead(lo_a, lo_b, penalty):
        if (0, lo_a, lo_b) not in ends:
            ends[0, lo_a, lo_b] = _trace(a[:lo_a][::-1], b[:lo_b][::-1])
        return _extend(ends[0, lo_a, lo_b], penalty)

    def look(steps, start_a, start_b):
        """The best run of steps that is accepted, then those before and after it."""
        for penalty in PENALTIES:
            best, top, low, total = None, 0.0, 0, 0.0
            for i, (_, _, m, e) in enumerate(steps):
                if total <= 0:
                    low, total = i, 0.0
                total += m - penalty * e
                if total > top:
                    best, top = (low, i + 1), total
            if not best:
                return
            i, j = best
            lo_a, lo_b = start_a + sum(s[0] for s in steps[:i]), start_b + sum(s[1] for s in steps[:i])
            hi_a, hi_b = lo_a + sum(s[0] for s in steps[i:j]), lo_b + sum(s[1] for s in steps[i:j])
            p, q, m, e = beyond(hi_a, hi_b, penalty) if j == len(steps) and start_a + sum(s[0] for s in steps) == at else (0, 0, 0, 0)
            r, s, n, f = ahead(lo_a, lo_b, penalty) if not i and start_a == first_a else (0, 0, 0, 0)
            matched, edits = m + n + sum(x[2] for x in steps[i:j]), e + f + sum(x[3] for x in steps[i:j])
            if min(hi_a + p - lo_a + r, hi_b + q - lo_b + s) >= min_words and matched >= min_identity * (matched + edits):
                found.append((lo_a - r, hi_a + p, lo_b - s, hi_b + q, matched, edits))
                if i and sum(x[0] for x in steps[:i]) >= min_words:
                    look(steps[:i], start_a, start_b)
                if j < len(steps) and sum(x[0] for x in steps[j:]) >= min_words:
                    look(steps[j:], hi_a, hi_b)
                return

    look(steps, first_a, first_b)
    return found


def _packed(rows: DataFrame) -> DataFrame:
    """(row, id, packed): bodies compressed one by one, so that they are cheap to shuffle."""

    def squeeze(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([packer.compress(t) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["row", "id", "packed"])

    return rows.select("row", "id", "body").mapInArrow(squeeze, "row long, id long, packed binary")


def _regions(packed: DataFrame, linked: DataFrame, margin: int) -> DataFrame:
    """Both sides of each chain with the hashes of their words and of `margin` words around them."""
    pair = ("row", "other", "chain")
    sides = [linked.select(F.col(doc).alias("doc"), *pair, F.lit(n).alias("side"), F.array_min(c).alias("a"), F.array_max(F.zip_with(c, "size", lambda p, q: p + q)).alias("b")) for n, (doc, c) in enumerate((("row", "x"), ("other", "y")))]
    wanted = sides[0].unionByName(sides[1])
    # a document that stands for many others is met by all their chains: they come in lists of LIST at most, about
    parts = wanted.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("parts"))
    wanted = wanted.join(parts, "doc").withColumn("part", F.pmod(F.xxhash64("row", "chain"), F.col("parts")))
    kinds = [("row", pa.int64()), ("other", pa.int64()), ("chain", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("low", pa.int32()), ("words", pa.binary())]

    def look(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            out, size = [], 0
            flat, bounds = word_hashes(pa.array([opener.decompress(t) for t in batch.column(1).to_pylist()], pa.binary()))
            flat = (flat >> np.uint64(32)).astype(np.uint32)
            for j, (i, lists) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = flat[bounds[j] : bounds[j + 1]]
                for x in lists:
                    low, high = max(0, x["a"] - margin), min(len(words), x["b"] + margin)
                    out.append((x["row"], x["other"], x["chain"], x["side"], i, low, words[low:high].tobytes()))
                    size += high - low
                    if size >= 1_000_000:
                        yield _batch(out, kinds)
                        out, size = [], 0
            yield _batch(out, kinds)

    lists = wanted.groupBy("doc", "part").agg(F.collect_list(F.struct("row", "other", "chain", "side", "a", "b")).alias("at"))
    joined = common.join_apart(packed.withColumnRenamed("row", "doc"), lists, ["doc"]).select("id", "packed", "at")
    return joined.mapInArrow(look, "row long, other long, chain int, side int, id long, low int, words binary")


_PASSAGES = "row long, id long, start_word int, end_word int, source_row long, source_id long, source_start int, source_end int, n_words int, identity double, seeds int"


def least_cover(ranges: list[tuple[int, int]]) -> list[int]:
    """The numbers of as few ranges (from, to; ascending) as cover together what all of them cover."""
    chosen, end, best = [], -1, None
    for i, (low, high) in enumerate([*ranges, (1 << 62, 0)]):
        if low > end and best is not None:
            chosen.append(best)
            end, best = ranges[best][1], None
        if low > end:
            end = low
        if high > end and (best is None or high > ranges[best][1]):
            best = i
    return chosen


def _covering(linked: DataFrame) -> DataFrame:
    """linked with from, to (words of row) and first: whether the chain is one of the few that cover what all of the row cover."""

    def pick(batches):
        def choose(held):
            """Whole rows, chains in order."""
            row, low, high = (held.column(c).to_numpy() for c in ("row", "from", "to"))
            cut = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)]
            first = np.zeros(len(row), bool)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                first[[a + i for i in least_cover(list(zip(low[a:b].tolist(), high[a:b].tolist(), strict=True)))]] = True
            return held.append_column("first", pa.array(first)).combine_chunks().to_batches()

        held = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            row = batch.column(0).to_numpy()
            if held[0].column(0)[0].as_py() != row[-1]:
                cut = int(np.searchsorted(row, row[-1]))
                yield from choose(pa.Table.from_batches([*held[:-1], batch[:cut]]))
                held = [batch[cut:]]
        if held:
            yield from choose(pa.Table.from_batches(held))

    extent = linked.select("*", F.array_min("x").alias("from"), F.array_max(F.zip_with("x", "size", lambda p, q: p + q)).alias("to"))
    ordered = extent.repartition("row").sortWithinPartitions("row", "from", F.desc("to"), "other", "chain")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(pick, f"{names}, first boolean")


def _outside(linked: DataFrame, done: DataFrame) -> DataFrame:
    """Those of linked that don't lie within what passages of their row cover together."""

    kinds = [("row", pa.int64()), ("other", pa.int64()), ("chain", pa.int32())]

    def check(batches):
        last, cover = None, []
        for batch in batches:
            out = []
            for row, other, chain, low, high in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if row != last:
                    last, cover = row, []
                if chain < 0 and cover and low <= cover[-1][1]:
                    cover[-1] = (cover[-1][0], max(cover[-1][1], high))
                elif chain < 0:
                    cover.append((low, high))
                else:
                    i = bisect.bisect_right(cover, (low, 1 << 40)) - 1
                    if i < 0 or cover[i][1] < high:
                        out.append((row, other, chain))
            yield _batch(out, kinds)

    # the passages of a row come before its chains
    known = done.select("row", F.lit(0).cast("long").alias("other"), F.lit(-1).alias("chain"), F.col("start_word").alias("from"), F.col("end_word").alias("to"), F.lit(0).alias("kind"))
    both = known.unionByName(linked.select("row", "other", "chain", "from", "to", F.lit(1).alias("kind")))
    both = both.repartition("row").sortWithinPartitions("row", "kind", "from").select("row", "other", "chain", "from", "to")
    return linked.join(both.mapInArrow(check, "row long, other long, chain int"), ["row", "other", "chain"])


def passages(rows: DataFrame, min_words: int = 50, min_identity: float = 0.8) -> DataFrame:
    """Passages of rows (row, id, body): where a later document repeats words of an earlier one, unless it shares them in a
    passage with another one already."""
    common.bound_batches(rows.sparkSession)
    texts = rows.select("row", "body")
    frequent = _frequent(texts, min_words)
    found = common.stash(_linked(_found(texts, min_words, frequent), frequent, min(ANCHOR, min_words)), "matches")
    # a seed with the words it can reach alone is shorter than any passage
    pieces = found.where("kind = 0").select("row", "other", "x", "y", "size", F.col("alone") if min_words > K + 2 else F.lit(False).alias("alone"))
    heads = found.where("kind = 2").select(F.col("other").alias("h"), "row", F.col("x"))
    heads = heads.groupBy("h").agg(F.min(F.struct("row", "x")).alias("one")).join(heads, "h").where(F.col("row") != F.col("one.row"))
    heads = heads.select("row", F.col("one.row").alias("other"), "x", F.col("one.x").alias("y"), F.lit(K).alias("size"), F.lit(False).alias("alone"))
    packed = common.stash(_packed(rows), "packed", "none")
    runs = _strings(packed, found.where("kind = 1").select("row", "x"), min_words).withColumn("alone", F.lit(False))
    chained = common.stash(_chained(pieces.unionByName(heads).unionByName(runs)), "chains")
    common.discard(found)
    linked = common.stash(_covering(chained), "chains")
    common.discard(chained)
    # most chains of a text lie in others with other texts: the few that cover all are aligned first, then what they left
    done = common.stash(_aligned(packed, linked.where("first"), min_words, min_identity), "passages")
    rest = common.stash(_outside(linked.where("not first"), done), "chains")
    common.discard(linked)
    more = common.stash(_aligned(packed, rest, min_words, min_identity), "passages")
    common.discard(rest, packed)
    return done.unionByName(more)


def _aligned(packed: DataFrame, linked: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """The passages of chains."""
    # the shortest passage has so many words in the longer of its two texts
    sides = _regions(packed, linked, int(np.ceil(min_words / min_identity)))
    # the chain itself comes before its two sides
    itself = linked.select("row", "other", "chain", F.lit(-1).alias("side"), "x", "y", "size")
    regions = sides.unionByName(itself, allowMissingColumns=True).repartition("row", "other").sortWithinPartitions("row", "other", "chain", "side")
    names = ("row", "id", "start_word", "end_word", "source_row", "source_id", "source_start", "source_end", "n_words", "identity", "seeds")
    kinds = list(zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()), strict=True))

    def finish(batches):
        left, chain, key, held = None, None, None, []

        def largest(held):
            """Passages of one pair of documents that lie in no other one of them."""
            kept = []
            for x in sorted(set(held), key=lambda x: (x[3] - x[2], x[9], x[10]), reverse=True):
                if not any(y[2] <= x[2] and x[3] <= y[3] and y[6] <= x[6] and x[7] <= y[7] for y in kept):
                    kept.append(x)
            return kept

        for batch in batches:
            out = []
            for row, other, _, side, i, low, raw, xs, ys, ns in zip(*(batch.column(c).to_pylist() for c in range(10)), strict=True):
                if side < 0:
                    chain = list(zip(xs, ys, ns, strict=True))
                    continue
                words = np.frombuffer(raw, np.uint32)
                if not side:
                    left = (i, low, words)
                    continue
                if key != (row, other):
                    out += largest(held)
                    key, held = (row, other), []
                i0, low0, words0 = left
                for a, b, c, d, matched, edits in align(words0, words, [(x - low0, y - low, n) for x, y, n in chain], min_words, min_identity):
                    held.append((row, i0, low0 + a, low0 + b, other, i, low + c, low + d, b - a, matched / (matched + edits), len(chain)))
            yield _batch(out, kinds)
        yield _batch(largest(held), kinds)

    columns = ("row", "other", "chain", "side", "id", "low", "words", "x", "y", "size")
    return regions.select(*columns).mapInArrow(finish, _PASSAGES)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), body.alias("body"))


def shared_passages(docs: DataFrame, min_words: int = 50, min_identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each passage that a document shares with an earlier one: ids, word ranges, identity, seeds."""
    found = passages(common.stash(_rows(docs, id_col, text_col), "numbered"), min_words, min_identity)
    return found.select(F.col("id").alias(id_col), "start_word", "end_word", F.col("source_id").alias(f"source_{id_col}"), "source_start", "source_end", "n_words", "identity", "seeds")


def drop_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without these ranges of words and the white space after them."""
    raw = text.encode()
    starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    kept, end = [], 0
    for a, b in sorted(ranges):
        low, high = starts[min(a, len(starts) - 1)], starts[min(b, len(starts) - 1)]
        if low > end:
            kept.append(raw[end:low])
        end = max(end, high)
    kept.append(raw[end:])
    return b"".join(kept).decode()


def remove_passages(docs: DataFrame, min_words: int = 50, min_identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of shared passages cut out of their texts; all other rows and columns stay as they are."""
    row, of, ranges = (common.fresh(n, docs.columns) for n in ("row", "of", "ranges"))
    # row numbers are those of this table in every job
    numbered = common.stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body")
    found = passages(numbered.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), body), min_words, min_identity)
    lists = found.groupBy(F.col("row").alias(of)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(ranges))

    @F.udf("string", useArrow=True)
    def drop(text, ranges):
        return text if text is None or not ranges else drop_words(text, [(r["start_word"], r["end_word"]) for r in ranges])

    cut = drop.asNondeterministic()  # else a filter on the text cuts it once more
    joined = numbered.join(lists, F.col(row) == F.col(of), "left")
    return joined.withColumn(text_col, F.when(F.col(ranges).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col).cast("string"), F.col(ranges)))).select(*docs.columns)
