"""Token-id files in Simple-8b word-aligned coding.

Ids are packed into 64-bit words: four bits of selector, sixty of payload. A selector says how many ids of how many
bits the payload holds; selector 0 is an escape, and the whole next word is one id too wide for a payload. Ids are cut
into blocks of BLOCK, each starting at a word of its own whose offset is kept, so blocks are packed and unpacked side
by side with array operations.

A segment is one self-contained piece of a file (numbers little-endian):
  magic 'S8BSEG1\\0', then uint64 n_docs, n_ids, n_words; int64 doc_id[n_docs]; uint64 known[n_docs] (0: null id);
  uint64 length[n_docs]; uint64 offset[n_blocks + 1]; uint64 word[n_words].
A file (shard-00000.s8b and so on) is some segments one after another; files, and segments in them, are in ascending
doc_id order. Tasks write files under names of their attempts; a manifest (shard, seq, file, at, size, n_docs, n_ids: a row a
segment) goes through Spark's commit protocol and so names those of the attempts that count; these files are then renamed.
Files are reached through pyarrow's file systems (local, HDFS, S3 and others by the folder's scheme), in a folder that all
executors share.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, word_tokens

MAGIC = b"S8BSEG1\0"
BLOCK = 512
#: Ids per word and bits per id, by selector from 1 on.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 61
#: A segment is closed once it holds so many ids; a longer document has one of its own.
SEGMENT_IDS = 1 << 18


#: By selector, ids taken; the last entry stands for a place past its block's end.
_COUNT = np.array([1, *(c for c, _ in LAYOUTS), 0], np.int32)
_PAST = len(LAYOUTS) + 1
_BITS16 = np.array([i.bit_length() for i in range(1 << 16)], np.int8)


def _widths(values: np.ndarray) -> np.ndarray:
    if not values.size or values.max() < 1 << 16:
        return _BITS16[values]
    bits = np.frexp(values.astype(np.float64))[1]
    bits = np.where(values >> np.uint64(60) != 0, ESCAPE, np.minimum(bits, 60)).astype(np.int8)
    near = np.flatnonzero((bits > 50) & (bits < ESCAPE))  # float64 rounds wide ids up
    if near.size:
        bits[near] = [int(v).bit_length() for v in values[near].tolist()]
    return bits


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place of each block (a row) the selector that packs most ids from there on; places past the end are free."""
    tops, n = {1: np.concatenate([bits, np.zeros((len(bits), 60), np.int8)], 1)}, bits.shape[1]
    for k in (1, 2, 4, 8, 16):
        tops[2 * k] = np.maximum(tops[k][:, : tops[k].shape[1] - k], tops[k][:, k:])
    best = np.zeros(bits.shape, np.int8)
    for selector in range(len(LAYOUTS), 0, -1):
        count, width = LAYOUTS[selector - 1]
        k = 1 << (count.bit_length() - 1)
        top = np.maximum(tops[k][:, :n], tops[k][:, count - k : count - k + n])
        np.copyto(best, np.int8(selector), where=top <= width)
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block offsets, words) of unsigned ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    bits = np.zeros(blocks * BLOCK, np.int8)
    bits[:n] = _widths(ids)
    stride = BLOCK + 64
    best = np.full((blocks, stride), _PAST, np.int8)
    best[:, :BLOCK] = _selectors(bits.reshape(blocks, BLOCK))
    best[-1, n - BLOCK * (blocks - 1) :] = _PAST
    flat, at = best.ravel(), np.arange(0, blocks * stride, stride, dtype=np.int32)
    walk = []
    while (step := _COUNT[selector := flat[at]]).any():
        walk.append((at, selector))
        at = at + step
    at, selector = (np.stack([w[i] for w in walk]).T.ravel() for i in range(2))  # block by block, in order
    real = selector != _PAST
    at, selector = at[real], selector[real]
    start = np.arange(len(at), dtype=np.int64)
    if not selector.all():
        start += np.cumsum(selector == 0) - (selector == 0)  # an escape takes two words
    # zeros between blocks, so that a word may reach past its block's end
    padded = np.zeros((blocks, stride), np.uint32 if ids.dtype.itemsize <= 4 else np.uint64)
    padded[:-1, :BLOCK] = ids[: BLOCK * (blocks - 1)].reshape(-1, BLOCK)
    padded[-1, : n - BLOCK * (blocks - 1)] = ids[BLOCK * (blocks - 1) :]
    padded = padded.ravel()
    words = np.zeros(len(at) + int((selector == 0).sum()), np.uint64)
    for s, (c, w) in enumerate(LAYOUTS, 1):
        if (x := np.flatnonzero(selector == s)).size:
            from_, word = at[x], np.full(x.size, s, np.uint64)
            for i in range(c):
                word |= padded[from_ + np.int32(i)].astype(np.uint64) << np.uint64(4 + i * w)
            words[start[x]] = word
    if (x := np.flatnonzero(selector == 0)).size:
        words[start[x] + 1] = padded[at[x]]
    ends = np.append(start[np.searchsorted(at, np.arange(1, blocks, dtype=np.int64) * stride)], len(words))
    return np.concatenate([[0], ends]).astype(np.uint64), words


def unpack(n: int, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The n ids of pack()."""
    if not n:
        return np.zeros(0, np.uint64)
    blocks, stride = len(offsets) - 1, BLOCK + 64
    selector = (words & np.uint64(15)).astype(np.int8)
    block = np.repeat(np.arange(blocks, dtype=np.int32), np.diff(offsets.astype(np.int64)))
    if not selector.all():  # escapes: the word after one is raw, unless the escape is raw itself
        raw = np.zeros(len(words), bool)
        for i in np.flatnonzero(selector == 0).tolist():
            if not raw[i]:
                raw[i + 1] = True
        head = np.flatnonzero(~raw)
        selector, block = selector[head], block[head]
    else:
        head = None
    count = _COUNT[selector]
    before = np.cumsum(count, dtype=np.int64) - count
    first = np.searchsorted(block, np.arange(blocks, dtype=np.int32))
    place = (before - (before[first] - np.arange(blocks) * stride)[block]).astype(np.int32)
    kind = np.uint32 if not (selector == 0).any() and int(selector.max()) <= 12 else np.uint64
    out = np.zeros(blocks * stride, kind)
    for s, (c, w) in enumerate(LAYOUTS, 1):
        if (x := np.flatnonzero(selector == s)).size:
            word, to, mask = words[x if head is None else head[x]], place[x], np.uint64((1 << w) - 1)
            for i in range(c):
                out[to + np.int32(i)] = (word >> np.uint64(4 + i * w)) & mask  # past a block's end: its margin
    if (x := np.flatnonzero(selector == 0)).size:
        out[place[x]] = words[head[x] + 1]
    return out.reshape(blocks, stride)[:, :BLOCK].ravel()[:n]


def segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    offsets, words = pack(every)
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(every), len(words)], np.uint64).tobytes(),
        np.array([d or 0 for d in doc_ids], np.int64).tobytes(), np.array([d is not None for d in doc_ids], np.uint64).tobytes(),
        np.array([len(x) for x in ids], np.uint64).tobytes(), offsets.tobytes(), words.tobytes(),
    ])


def read_segment(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, known, lengths, ids) of a segment."""
    if image[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n, count = (int(x) for x in np.frombuffer(image, np.uint64, 3, 8))
    at, blocks = 32, -(-n // BLOCK)
    parts = []
    for kind, size in ((np.int64, docs), (np.uint64, docs), (np.uint64, docs), (np.uint64, blocks + 1), (np.uint64, count)):
        parts.append(np.frombuffer(image, kind, size, at))
        at += 8 * size
    return parts[0], parts[1] != 0, parts[2].astype(np.int64), unpack(n, parts[3], parts[4])


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    return pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode every whole text (null: empty), append end_id, write files in ascending id order; their manifest.

    folder: a new one; if none is named, one in the shared folder. Null ids sort first; rows of equal id are ordered by their
    text, and spread over partitions by its hash, so one id on many rows does no harm. An empty table gives no files. Columns
    besides the two named are not read.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    most = SEGMENT_IDS
    folder = (folder or f"{common.scratch(spark)}/ids-{uuid.uuid4().hex}").rstrip("/")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    ranged = rows.repartitionByRange(partitions or common.shuffle_parts(spark), "id", F.xxhash64("body")).sortWithinPartitions("id", F.xxhash64("body"), "body")

    def encode(batches):
        shard, seq, coder, held, ids, total = TaskContext.get().partitionId(), 0, word_tokens.coder(tokenizer, end_id), [], [], 0
        system, at, out, name = *_open(folder), None, f"{shard:05d}-{uuid.uuid4().hex}"
        done = 0

        def row():
            nonlocal out, done
            if out is None:
                system.create_dir(f"{at}/attempts")
                out = system.open_output_stream(f"{at}/attempts/{name}")
            image = segment(held, ids)
            out.write(image)
            done += len(image)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (seq, pa.int64()), (name, pa.string()), (done - len(image), pa.int64()), (len(image), pa.int64()), (len(held), pa.int64()), (total, pa.int64()))], names=["shard", "seq", "file", "at", "size", "n_docs", "n_ids"])

        made = []
        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), coder.encode_many(batch.column(1).to_pylist()), strict=True):
                held.append(d)
                ids.append(x)
                total += len(x)
                if total >= most:
                    made.append(row())
                    held, ids, total, seq = [], [], 0, seq + 1
        if held:
            made.append(row())
        if out is not None:
            out.close()
        yield from made  # a row a segment, and only once the file is whole

    manifest = common.stash(ranged.mapInArrow(encode, "shard int, seq long, file string, at long, size long, n_docs long, n_ids long"), "token-manifest")
    system, at = _open(folder)
    for r in manifest.select("shard", "file").distinct().toLocalIterator():  # as many as partitions
        system.move(f"{at}/attempts/{r['file']}", f"{at}/shard-{r['shard']:05d}.s8b")
    system.create_dir(f"{at}/attempts")
    system.delete_dir(f"{at}/attempts")
    return manifest.withColumn("file", F.format_string(f"{folder}/shard-%05d.s8b".replace("%", "%%").replace("%%05d", "%05d"), "shard"))


def read_ids(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files that a manifest names: id_col, start, n_tokens, ids_crc32."""
    spark = segments.sparkSession
    common.bound_batches(spark)
    # shards are as many as partitions wrote them: this window over one row a shard stays small
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = segments.select("shard", "seq", "n_ids").withColumn("seq_start", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids"))
    starts = within.join(F.broadcast(shards), "shard").select("shard", "seq", (F.col("shard_start") + F.col("seq_start")).alias("start"))

    def decode(batches):
        for batch in batches:
            for file, first, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = _open(file)
                with system.open_input_file(path) as f:
                    docs, known, lengths, ids = read_segment(f.read_at(size, first))
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for n, b in zip(lengths.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=~known), pa.array(ends - lengths + start), pa.array(lengths), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    # a row a segment on both sides; documents are joined to nothing
    dealt = segments.join(starts, ["shard", "seq"]).repartition(4 * common.shuffle_parts(spark), "shard", "seq").select("file", "at", "size", "start")
    read = dealt.mapInArrow(decode, "id long, start long, n_tokens long, ids_crc32 long")
    return read.select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")
