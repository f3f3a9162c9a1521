"""Exact deduplication by content sort.

Rows are range-partitioned by leading bytes, a hash of the whole text and the id, with splitters that Spark samples
(the sampled key is bounded, however long the texts are). Because the id is part of the key, a text that a third of
all rows share is spread over as many partitions as it needs. Each partition is sorted externally, equal texts become
neighbours and are found by comparing whole neighbouring texts. Runs at the ends of a partition may go on in the next
one; there are at most two a partition, and they are merged by their SHA-256.

Defined results: a null text counts as empty; equal ids are separate rows; a null id is kept only if its group holds
no other id; an empty table gives no rows; further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Leading bytes in the range key.
LEAD = 32
_RUNS = "id long, digest binary, part int, edge boolean, run_best long, run_size long"


def _runs(smallest: bool):
    best = (lambda v: int(v.min())) if smallest else (lambda v: int(v.max()))

    def scan(batches):
        part = TaskContext.get().partitionId()
        state = {"text": None, "ids": [], "first": True}

        def close(edge: bool):
            ids = pa.chunked_array(state["ids"], pa.int64()).combine_chunks() if len(state["ids"]) != 1 else state["ids"][0]
            n, known = len(ids), ids.drop_null().to_numpy(zero_copy_only=False)
            full = lambda v, t: pa.array([v], t).take(pa.array(np.zeros(n, np.int64)))
            digest = hashlib.sha256(state["text"]).digest()
            return pa.RecordBatch.from_arrays(
                [ids, full(digest, pa.binary()), full(part, pa.int32()), full(edge, pa.bool_()), full(best(known) if len(known) else None, pa.int64()), full(n, pa.int64())],
                names=["id", "digest", "part", "edge", "run_best", "run_size"],
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            same = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(~same.astype(bool)) + 1, [len(ids)]])
            for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                text = texts[int(a)].as_py()
                if state["text"] is None or k or text != state["text"]:
                    if state["text"] is not None:
                        held.append(close(state["first"]))
                        state["first"] = False
                    state["text"], state["ids"] = text, []
                state["ids"].append(ids.slice(int(a), int(b - a)))
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if state["text"] is not None:
            yield close(True)

    return scan


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", partitions: int | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256. keep: 'largest' or 'smallest' id of equal texts stays."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = docs.sparkSession
    common.bound_batches(spark)
    n = partitions or common.shuffle_parts(spark)
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("body"))
    key = [F.substring("body", 1, LEAD), F.xxhash64("body")]
    ranged = rows.repartitionByRange(n, *key, F.col("id")).sortWithinPartitions(*key, "body", "id")
    runs = common.stash(ranged.mapInArrow(_runs(keep == "smallest"), _RUNS), "exact-runs")
    pick = F.min if keep == "smallest" else F.max
    # at most two runs a partition: the merged table is bounded by the number of partitions
    ends = runs.where("edge").groupBy("digest", "part").agg(pick("run_best").alias("b"), F.first("run_size").alias("s"))
    ends = ends.groupBy("digest").agg(pick("b").alias("all_best"), F.sum("s").alias("all_size"))
    out = runs.join(F.broadcast(ends), "digest", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("all_best", "run_best").alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    kept = F.col(id_col).eqNullSafe(F.col("keep_id"))
    return out.select(id_col, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _first_of_runs(at: int, extra: list[str]):
    def scan(batches):
        part = TaskContext.get().partitionId()

        def out(rows: pa.RecordBatch, edge: list[bool]):
            digests = [hashlib.sha256((rows.column(at)[i].as_py() or "").encode()).digest() if e else None for i, e in enumerate(edge)]
            more = [pa.array(digests, pa.binary()), pa.array([part] * len(edge), pa.int32()), pa.array(edge, pa.bool_())]
            return pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, *extra])

        held, last, first = None, None, True  # the first row of the run at hand, and its text
        for batch in batches:
            if not len(batch):
                continue
            texts = pc.fill_null(batch.column(at), "")
            same = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False).astype(bool)
            where = np.flatnonzero(np.concatenate([[held is None or texts[0].as_py() != last], ~same]))
            if not where.size:
                continue
            new = batch.take(pa.array(where))
            if held is not None:
                yield out(held, [first])
                first = False
            if len(new) > 1:
                yield out(new.slice(0, len(new) - 1), [first] + [False] * (len(new) - 2))
                first = False
            held, last = batch.take(pa.array(where[-1:])), texts[int(where[-1])].as_py()
        if held is not None:
            yield out(held, [True])

    return scan


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Of the rows of docs with equal texts the one with the smallest id, all columns as they are (a null text equals an empty one).

    The same content sort carries whole rows, so documents are shuffled once. Of rows with equal text and id one stays;
    a null id stays only if its group holds no other id.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    n = partitions or common.shuffle_parts(spark)
    body, id_ = F.coalesce(F.col(text_col), F.lit("")).cast("binary"), F.col(id_col).cast("long")
    key = [F.substring(body, 1, LEAD), F.xxhash64(body)]
    ranged = docs.repartitionByRange(n, *key, id_.asc_nulls_last()).sortWithinPartitions(*key, body, id_.asc_nulls_last())
    digest, part, edge, best = (common.fresh(c, docs.columns) for c in ("digest", "part", "edge", "best"))
    extra = T.StructType().add(digest, "binary").add(part, "integer").add(edge, "boolean")
    rows = common.stash(ranged.mapInArrow(_first_of_runs(docs.columns.index(text_col), [digest, part, edge]), T.StructType(docs.schema.fields + extra.fields)), "exact-first")
    # at most two runs a partition can go on in another one
    ends = rows.where(F.col(edge)).groupBy(digest).agg(F.min(F.struct(id_.isNull(), id_, F.col(part).alias("at"))).alias(best))
    ends = ends.select(digest, F.col(best)["at"].alias(best))
    stays = ~F.col(edge) | (F.col(part) == F.col(best))
    return rows.join(F.broadcast(ends), digest, "left").where(stays).select(*docs.columns)
