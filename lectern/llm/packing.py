"""Packing documents into sequences: shortest-pack-first over the histogram of piece lengths.

Every document is encoded whole and cut into pieces of at most `size` ids. The histogram of piece lengths has at most
`size` bins; on it, lengths are placed longest first into the shortest pack that still has room, a whole bin at a
time, which gives packing patterns and their counts. Each piece has a rank among the pieces of its length, and patterns
are joined back to pieces by that rank. Ids never leave the task that made them; only piece rows are shuffled.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, word_tokens

_PIECES = "id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", remembered: int = word_tokens.REMEMBERED) -> DataFrame:
    """One row per piece, stored; nth counts the pieces of this length before it in its part."""
    common.bound_batches(docs.sparkSession)

    def pieces(batches):
        part, coder, seen = TaskContext.get().partitionId(), word_tokens.coder(tokenizer, end_id, remembered), np.zeros(size + 1, np.int64)
        for batch in batches:
            rows = []
            for d, ids in zip(batch.column(0).to_pylist(), coder.encode_many(batch.column(1).to_pylist()), strict=True):
                raw, n = memoryview(ids.tobytes()), len(ids)
                for a in range(0, n, size):
                    b = min(n, a + size)
                    rows.append((d, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n, part, int(seen[b - a])))
                    seen[b - a] += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return common.stash(rows.mapInArrow(pieces, _PIECES), "pieces")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: [(how many sequences, [(length, times), ...]), ...], with every piece of the histogram placed.

    Bins go longest first. The open pattern with most room takes one piece of a length in each of its sequences; when fewer
    pieces are left than it has sequences, the pattern is split. When none has room, new sequences are filled with this length.
    """
    room: list[tuple[int, int, int, tuple]] = []  # (-room, serial, count, contents)
    done, serial = [], 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        back = []
        while left:
            if room and -room[0][0] >= length:
                (free, _, count, inside), each = heapq.heappop(room), 1
            else:  # nothing has room: new sequences take as many pieces of this length as they hold
                each = min(size // length, left)
                free, count, inside = -size, left // each, ()
            used = min(count, left)
            if used < count:
                back.append((free, serial, count - used, inside))
                serial += 1
            left -= used * each
            again = bool(inside) and inside[-1][0] == length
            inside = (*inside[:-1], (length, inside[-1][1] + each)) if again else (*inside, (length, each))
            item = (free + length * each, serial, used, inside)
            serial += 1
            if item[0]:
                heapq.heappush(room, item)
            else:
                done.append(item)
            for x in back:
                heapq.heappush(room, x)
            back = []
    return [(count, list(inside)) for _, _, count, inside in [*done, *room]]


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length the ranks that each pattern takes: arrays length, rank (first), times, sequence (first), offset; sorted."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, inside in found:
        offset = 0
        for length, times in inside:
            rows.append((length, taken.get(length, 0), times, sequence, offset))
            taken[length] = taken.get(length, 0) + count * times
            offset += length * times
        sequence += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "sequence", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, size: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Pieces with sequence_id and offset: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Defined results: a null text is the end id alone; null and repeated ids keep their pieces apart; an empty table
    gives no pieces. A sequence's offsets are gapless from 0.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = spark.sparkContext.broadcast(slots(patterns(histogram, size)))  # its size depends on `size`, not on the documents
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        t = table.value
        bounds = np.searchsorted(t["length"], np.arange(size + 2))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 5))
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                here, a, b = length == n, bounds[n], bounds[n + 1]
                at[here] = a + np.searchsorted(t["rank"][a:b], rank[here], side="right") - 1
            nth, times = rank - t["rank"][at], t["times"][at]
            sequence, offset = t["sequence"][at] + nth // times, t["offset"][at] + nth % times * length
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length), batch.column(3), batch.column(4), pa.array(sequence), pa.array(offset)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", remembered: int = word_tokens.REMEMBERED) -> DataFrame:
    """The pieces of docs with their places; `remembered` bounds the words a worker keeps, and changes no result."""
    return pack(cut(docs, tokenizer, end_id, size, id_col, text_col, remembered), size, id_col)
