"""Phrase collocation mining: frequent word n-grams of each language, scored by how much their parts belong together.

1. Every task counts the n-grams of its texts by hash and deals the counts out by the hash's leading bits. Each of these
   hash partitions is merged, chunk by chunk, into a Misra-Gries summary whose capacity exceeds its mass (occurrences)
   divided by the threshold: when it is full, the counter that is one too many is taken off all counters. What is taken
   off altogether stays below the threshold, so every frequent n-gram keeps a counter; a hash collision can only raise one.
   Chunks come sorted by partition, so a task holds one summary and one chunk at a time.
2. What survives is marked in a bitmap of bounded size, in which each partition owns its slice. A second pass over the
   texts counts, exactly and by their words, the n-grams whose bit is set, and all single words; counts are added up
   before they are shuffled. More survivors than bits only make the bitmap let more through.

Parts of a frequent phrase are frequent themselves, so their counts are in the same table, and scores come from joins.

Defined results: a null text is empty, a null language counts as `und` (together with one called so); only A-Z are
lower-cased; equal rows count once each; a very long text is read in slices that overlap by the words of an n-gram, so
memory doesn't depend on it; equal scores are ranked by count, then by the phrase's bytes; an empty table gives no rows.
Only the two named columns are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: What parts pieces, and what parts words.
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text a slice holds, counters a task holds before it sends them, bytes of text a hash partition stands for.
SLICE, HELD, SHARE = 12 << 20, 1 << 21, 1 << 25
#: Bits of the survivors' bitmap, for each survivor and at most.
BITS_EACH, BITS_MOST = 64, 1 << 28
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(PIECE_ENDS)] = 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts in a row: lang (number of the language), code (number in `distinct`), piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, own: int):
        """data: bytes of all texts; offsets: where texts begin, and the end; lang: of each text; own: n-grams that begin before this byte count."""
        kind = _KIND[data]
        word = kind == 0
        begins = word.copy()
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        begins[1:] &= ~word[:-1] | first[1:-1]
        at = np.flatnonzero(begins)
        text = np.searchsorted(offsets[1:], at, "right")
        ends = np.cumsum(kind == 2, dtype=np.int64)
        self.piece = ends[at] + text
        self.lang = lang[text]
        letters = _LOWER[data[word]]
        bounds = np.append(np.cumsum(word, dtype=np.int64)[at] - 1, len(letters)).astype(np.int32)
        strings = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        coded = strings.dictionary_encode()
        self.code, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.own = int(np.searchsorted(at, own))

    def starts(self, n: int) -> np.ndarray:
        """Places of the n-grams that count: all their words are in one piece (pieces of a text follow one another)."""
        last = max(0, len(self.code) - n + 1)
        at = np.flatnonzero(self.piece[:last] == self.piece[n - 1 : n - 1 + last])
        return at[: np.searchsorted(at, self.own)]

    def hashes(self, most: int, langs: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """For n from 2 to most: (n, hash of the n words from each place on)."""
        words = np.array([xxhash.xxh64_intdigest(x) for x in self.distinct.to_pylist()], np.uint64)
        each = words[self.code] if len(words) else np.zeros(0, np.uint64)
        salt = np.array([xxhash.xxh64_intdigest(x, 7) for x in langs], np.uint64)
        run = _mix(each ^ salt[self.lang]) if len(each) else each
        for n in range(2, most + 1):
            run = _mix(run[:-1] * _ODD + each[n - 1 :]) if len(run) else run
            yield n, run


def slices(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[Words, list[bytes]]]:
    """Texts of batches(lang, text) in slices of some SLICE bytes, cut between words; a slice reads `overlap` words on."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, lang = [x.encode() for x in langs.dictionary.to_pylist()], langs.indices.to_numpy().astype(np.int64)
        text = batch.column(1)
        if not len(text):
            continue
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        held = text.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        at = 0
        while at < len(data):
            end = _cut(data, at + SLICE)
            reach, left = end, overlap
            while left and reach < len(data):  # the words after the cut that n-grams before it reach
                word = _KIND[data[reach : reach + 4096]] == 0
                gaps = np.flatnonzero(word[:-1] & ~word[1:])
                if len(gaps) >= left:
                    reach, left = reach + int(gaps[left - 1]) + 1, 0
                else:
                    reach, left = min(len(data), reach + 4096), left - len(gaps)
            reach = _cut(data, reach)
            a, b = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, reach, "left")
            inside = np.clip(offsets[a : b + 1] - at, 0, reach - at)
            yield Words(data[at:reach], inside, lang[a:b], end - at), names
            at = end


def _cut(data: np.ndarray, at: int) -> int:
    """The first place from `at` on that lies between words, or the end."""
    while at < len(data):
        gaps = np.flatnonzero(_KIND[data[at : at + 4096]])
        if len(gaps):
            return at + int(gaps[0])
        at += 4096
    return len(data)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Summary:
    """A Misra-Gries summary: counters fall short of the truth by `lost` at most, which is below mass / capacity."""

    def __init__(self, capacity: int, keys: np.dtype = np.dtype(np.uint32)):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, keys), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        self.keys, self.counts = added(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.lost += lost
        if len(self.keys) > 2 * self.capacity:
            self.shrink()

    def shrink(self) -> None:
        """Take the largest counter that is one too many off all: each unit costs capacity + 1 occurrences."""
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            self.lost += off
            kept = self.counts > off
            self.keys, self.counts = self.keys[kept], self.counts[kept] - off

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys that can have reached the threshold; every one that has is among them."""
        return self.keys[self.counts + self.lost >= threshold]


def _survivors(texts: DataFrame, longest: int, threshold: int, bits: int) -> DataFrame:
    """(p, n, keys): for each of 2**bits hash partitions the survivors of its summary."""

    def count(batches):
        keys, counts, size = [], [], 0

        def send():
            k, c = added(np.concatenate(keys), np.concatenate(counts))
            part = (k >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(cut[1:], len(k))
            mass = np.add.reduceat(c, cut)
            low = k.astype(np.uint32)
            p, n = part[cut].astype(np.int32), len(cut)
            packed = [low[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], [c[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, ends, strict=True)]
            kinds = ((0, mass, [b""] * n, [b""] * n), (1, np.zeros(n, np.int64), *packed))
            for kind, m, a, b in kinds:
                yield pa.record_batch([pa.array(p), pa.array(np.full(n, kind, np.int32)), pa.array(m), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["p", "kind", "mass", "keys", "counts"])

        for words, langs in slices(batches, longest - 1):
            for n, run in words.hashes(longest, langs):
                h = run[words.starts(n)] >> np.uint64(32 - bits)
                k, c = np.unique(h, return_counts=True)
                keys.append(k)
                counts.append(c)
                size += len(k)
            if size > HELD:
                yield from send()
                keys, counts, size = [], [], 0
        if size:
            yield from send()

    def merge(batches):
        now, mass, summary = None, 0, None

        def out():
            kept = summary.survivors(threshold) if summary else np.zeros(0, np.uint32)
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([len(kept)], pa.int64()), pa.array([kept.tobytes()], pa.binary())], ["p", "n", "keys"])

        for batch in batches:
            for p, kind, m, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != now:
                    if now is not None:
                        yield out()
                    now, mass, summary = p, 0, None
                if kind == 0:
                    mass += m
                    continue
                summary = summary or Summary(mass // threshold + 1)
                summary.merge(np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.uint32).astype(np.int64))
        if now is not None:
            yield out()

    counted = texts.mapInArrow(count, "p int, kind int, mass long, keys binary, counts binary")
    return counted.repartition(1 << bits, "p").sortWithinPartitions("p", "kind").mapInArrow(merge, "p int, n long, keys binary")


def _bitmap(kept: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """The survivors' bitmap, and how many leading bits of a hash number its bits. Each partition fills its own slice."""
    total = kept.agg(F.sum("n")).first()[0] or 0
    order = max(bits + 6, min(BITS_MOST.bit_length() - 1, (BITS_EACH * total).bit_length()))
    own = order - bits

    def mark(batches):
        for batch in batches:
            for p, keys in zip(batch.column("p").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                on = np.zeros(1 << own, bool)
                on[np.frombuffer(keys, np.uint32) >> np.uint32(32 - own)] = True
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["p", "marks"])

    out = np.zeros(1 << (order - 3), np.uint8)
    for row in kept.where("n > 0").select("p", "keys").mapInArrow(mark, "p int, marks binary").toLocalIterator():
        out[row["p"] << (own - 3) :][: 1 << (own - 3)] = np.frombuffer(row["marks"], np.uint8)
    return out, order


def _counted(texts: DataFrame, longest: int, threshold: int, bitmap: np.ndarray, order: int) -> DataFrame:
    """(lang, size, phrase, f): exact counts of all words, and of the longer phrases that reach the threshold."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def count(batches):
        marks = np.frombuffer(sent.value, np.uint8)
        for words, langs in slices(batches, longest - 1):
            places = {1: np.arange(words.own)}
            for n, run in words.hashes(longest, langs):
                at = words.starts(n)
                bit = run[at] >> np.uint64(64 - order)
                places[n] = at[(marks[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)]
            base = max(1, len(words.distinct))
            for n, at in places.items():
                if not len(at):
                    continue
                ids = words.lang[at] * base + words.code[at]
                for k in range(1, n):
                    if k > 1:  # numbers of what was met, so that the next product fits
                        ids = np.unique(ids, return_inverse=True)[1]
                    ids = ids * base + words.code[at + k]
                _, first, f = np.unique(ids, return_index=True, return_counts=True)
                at = at[first]
                parts = [words.distinct.take(pa.array(words.code[at + k])).to_pylist() for k in range(n)]
                phrase = pa.array([b" ".join(x) for x in zip(*parts, strict=True)] if n > 1 else parts[0], pa.binary()).cast(pa.string())
                name = pa.array([x.decode() for x in langs]).take(pa.array(words.lang[at]))
                yield pa.record_batch([name, pa.array(np.full(len(at), n, np.int32)), phrase, pa.array(f.astype(np.int64))], ["lang", "size", "phrase", "f"])

    rows = texts.mapInArrow(count, "lang string, size int, phrase string, f long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("size") == 1) | (F.col("f") >= threshold))


def collocations(docs: DataFrame, longest: int = 3, threshold: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that occur `threshold`
    times or more. A phrase inside a longer candidate that has `share` percent of its occurrences or more is left out."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // SHARE).bit_length())
    kept = common.stash(_survivors(texts, longest, threshold, bits), "phrase-survivors")
    counts = common.stash(_counted(texts, longest, threshold, *_bitmap(kept, bits)), "phrase-counts")
    common.discard(kept)

    totals = counts.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where(F.col("f") >= threshold)
    found = known.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    words, part = F.split("phrase", " "), lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = found.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    for name, side in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(name), F.col("f").alias(side)), ["lang", name])
    wide = "CAST({} AS DECIMAL(19, 0))".format  # products of longs, in 38 digits
    cuts = cuts.withColumn("score", F.expr(f"({wide('a')} * {wide('a')} * 1000000) DIV ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    # phrases inside longer ones
    lengths = [F.explode(F.sequence(F.lit(2), F.col("size") - 1)), F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1))]
    inner = found.where("size > 2").withColumn("w", words).withColumn("m", lengths[0]).withColumn("from", lengths[1])
    inner = inner.select("lang", part(F.col("from"), F.col("m")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    # the best of each language among the best of its parts, so that no task sorts a language
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = alone.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(common.shuffle_parts(spark))))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = ranked.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
