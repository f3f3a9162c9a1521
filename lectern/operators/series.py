"""Long series cut into chunks of positions: windows with a halo, running sums and row numbers in two levels, exact quantiles.

A lecture of any length is spread over tasks: nothing here sorts or gathers a whole job in one of them. What is computed a
chunk at a time is put together from one row a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

#: Positions of a chunk.
CHUNK = 4096
#: Rows of a job or of a bucket that one task sorts, and buckets of a round.
SMALL, BUCKETS = 4096, 64


def halo(rows: DataFrame, before: int, after: int, index: str = "frame_index") -> DataFrame:
    """rows with chunk and core: each row in its own chunk (core), and beside it where a window of a neighbour's row reaches it."""
    if max(before, after) > CHUNK:
        raise ValueError(f"a halo of over {CHUNK} rows")
    own, at = F.expr(f"{index} DIV {CHUNK}"), F.col(index) % CHUNK
    chunks = F.filter(F.array(own, F.when(at >= CHUNK - before, own + 1), F.when(at < after, own - 1)), lambda c: c.isNotNull())
    return rows.withColumn("chunk", F.explode(chunks)).withColumn("core", F.col("chunk") == own)


def over_halo(rows: DataFrame, before: int, after: int, columns: Callable[[Window], dict[str, Column]], index: str = "frame_index") -> DataFrame:
    """rows (positions 0, 1, 2, ... a job) with columns of windows that reach at most so many rows to either side."""
    spread = halo(rows, before, after, index)
    return spread.withColumns(columns(Window.partitionBy("job_id", "chunk").orderBy(index))).where("core").drop("chunk", "core")


def running(rows: DataFrame, value: Column, name: str, index: str) -> DataFrame:
    """rows with the sum of value (whole numbers) over all rows of their job up to them, by index (a whole number, any gaps)."""
    cut = rows.withColumn("chunk", F.expr(f"{index} DIV {CHUNK}")).withColumn(name, value)
    sums = cut.groupBy("job_id", "chunk").agg(F.sum(name).alias("before"))
    earlier = Window.partitionBy("job_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("job_id", "chunk", F.coalesce(F.sum("before").over(earlier), F.lit(0)).alias("before"))  # a row a chunk
    inside = F.sum(name).over(Window.partitionBy("job_id", "chunk").orderBy(index))
    return cut.withColumn(name, inside).join(sums, ["job_id", "chunk"]).withColumn(name, F.col(name) + F.col("before")).drop("chunk", "before")


def positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """rows with their numbers from 0 in the order of their job; order is total, or equal rows share their numbers out as they lie."""
    dealt = rows.repartitionByRange("job_id", *order).withColumn("part", F.spark_partition_id())
    dealt = shared.stash(dealt, "positions")  # so that both uses see one dealing
    counts = dealt.groupBy("job_id", "part").agg(F.count(F.lit(1)).alias("before"))
    earlier = Window.partitionBy("job_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("job_id", "part", F.coalesce(F.sum("before").over(earlier), F.lit(0)).alias("before"))  # a row a part of a job
    inside = F.row_number().over(Window.partitionBy("job_id", "part").orderBy(*order))
    return dealt.withColumn(name, inside).join(counts, ["job_id", "part"]).withColumn(name, F.col(name) - 1 + F.col("before")).drop("part", "before")


def quantiles(rows: DataFrame, at: list[float]) -> DataFrame:
    """(job_id, p): exact quantiles of x in rows (job_id, x), between neighbours in proportion; x null or not finite is left out.

    Jobs of up to SMALL rows are sorted. For others each wanted rank is looked for by counting: the values that are still open
    are cut into BUCKETS of about the same number of rows, and the bucket that holds the rank is opened next, until its rows are few or
    equal. Rows are so divided by about BUCKETS a round, whatever the values are.
    """
    rows = rows.select("job_id", F.col("x").cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    rows = shared.stash(rows, "series")
    spans = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    spans = shared.stash(spans, "spans")
    few = rows.join(spans.where(F.col("n") <= SMALL).select("job_id"), "job_id").groupBy("job_id").agg(F.expr(f"percentile(x, array({', '.join(f'{p!r}D' for p in at)}))").alias("p"))
    many = spans.where(F.col("n") > SMALL)
    if not many.limit(1).count():
        return few
    # the two ranks beside each quantile
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in at]
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), (f(p)).cast("long").alias("rank"), (p - F.floor(p)).alias("share"), F.lit(k).alias("side")) for i, p in enumerate(place) for k, f in enumerate((F.floor, F.ceil))]))
    open_ = many.select("job_id", "n", "low", "high", wanted.alias("w")).select("job_id", "n", "low", "high", "w.*", F.col("w.rank").alias("inside"))
    open_ = shared.stash(open_, "ranks")
    done = []
    names = ["job_id", "q", "side", "share"]
    while True:
        found = open_.where("low = high").select(*names, F.col("low").alias("value"))
        short = open_.where((F.col("low") < F.col("high")) & (F.col("n") <= SMALL))
        inside = rows.join(short, "job_id").where(F.col("x").between(F.col("low"), F.col("high")))
        value = F.element_at(F.array_sort(F.collect_list("x")), F.first("inside").cast("int") + 1)  # of SMALL rows at most
        done += [found, inside.groupBy(*names).agg(value.alias("value"))]
        open_ = open_.where((F.col("low") < F.col("high")) & (F.col("n") > SMALL))
        if not open_.limit(1).count():
            break
        # spans that ranks share are cut once, at values of about equal depth; what equals a cut has a bucket of its own
        span = ["job_id", "low", "high"]
        held = rows.join(open_.select(*span).distinct(), "job_id").where(F.col("x").between(F.col("low"), F.col("high")))
        cuts = held.groupBy(*span).agg(F.expr(f"percentile_approx(x, array({', '.join(f'{i}D / {BUCKETS}' for i in range(BUCKETS + 1))}), 10000)").alias("cuts"))
        bucket = F.size(F.filter("cuts", lambda c: c < F.col("x"))) + F.size(F.filter("cuts", lambda c: c <= F.col("x")))
        held = held.join(shared.stash(cuts, "cuts"), span).groupBy(*span, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy(*span).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = open_.drop("n").join(held.withColumn("below", below), span).where((F.col("inside") >= F.col("below")) & (F.col("inside") < F.col("below") + F.col("n")))
        open_ = shared.stash(held.select("job_id", "n", F.col("least").alias("low"), F.col("most").alias("high"), "q", "rank", "share", "side", (F.col("inside") - F.col("below")).alias("inside")), "ranks")
    values = done[0]
    for d in done[1:]:
        values = values.unionByName(d)
    between = F.max(F.when(F.col("side") == 0, F.col("value"))) * (1 - F.first("share")) + F.max(F.when(F.col("side") == 1, F.col("value"))) * F.first("share")
    each = values.groupBy("job_id", "q").agg(between.alias("value"))
    return few.unionByName(each.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))), lambda x: x["value"]).alias("p")))


def spaced(found: DataFrame, gap: int, index: str = "frame_index") -> DataFrame:
    """Of each job's rows (job_id, index), in order, those at least `gap` after the last one kept.

    What a chunk does depends on one small number only: how many of its first positions the last kept row before it still
    blocks. Each chunk is folded for all of these `gap` numbers, which gives a map from the number it meets to the number it
    leaves; maps are composed by doubling (over 1, 2, 4, ... chunks), and chunks then keep rows from the numbers they met.
    """
    if gap > CHUNK:
        raise ValueError(f"a gap of over {CHUNK}")
    chunks = found.groupBy("job_id", F.expr(f"{index} DIV {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_set(F.col(index).cast("long"))).alias("xs"))
    first = F.col("chunk") * CHUNK
    free = lambda blocked: F.aggregate("xs", (first + blocked).cast("long"), lambda a, x: F.when(x >= a, x + gap).otherwise(a))
    leaves = F.transform(F.sequence(F.lit(0), F.lit(gap - 1)), lambda b: F.greatest(free(b) - first - CHUNK, F.lit(0)).cast("int"))
    chunks = shared.stash(chunks.withColumn("leaves", leaves), "chunks")
    maps, reach = chunks.select("job_id", "chunk", "leaves"), 1
    longest = chunks.agg(F.max("chunk") - F.min("chunk") + 1).first()[0] or 0
    while reach < longest:
        left = maps.select("job_id", (F.col("chunk") + reach).alias("chunk"), F.col("leaves").alias("before"))
        # a chunk without rows leaves nothing blocked
        met = F.transform(F.coalesce("before", F.array_repeat(F.lit(0), gap)), lambda b: F.element_at("leaves", b + 1))
        maps = shared.stash(maps.join(left, ["job_id", "chunk"], "left").select("job_id", "chunk", met.alias("leaves")), "chunks")
        reach *= 2
    entry = maps.select("job_id", (F.col("chunk") + 1).alias("chunk"), F.element_at("leaves", 1).alias("blocked"))
    start = (first + F.coalesce("blocked", F.lit(0))).cast("long")
    kept = F.aggregate("xs", F.struct(start.alias("free"), F.array().cast("array<long>").alias("kept")), lambda a, x: F.when(x >= a["free"], F.struct((x + gap).alias("free"), F.array_append(a["kept"], x).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return chunks.join(entry, ["job_id", "chunk"], "left").select("job_id", F.explode(kept).alias(index))
