"""Visual change over several lags, robust thresholds, peaks, candidates, appearances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import series

LAGS = {"short": (2, 0.25), "medium": (5, 0.40), "long": (10, 0.35)}
WEIGHTS = {"pixel": 0.30, "edge": 0.25, "hist": 0.15, "struct_": 0.30}


def transition_scores(frames: DataFrame) -> DataFrame:
    """job_id, frame_index, short, medium, long, combined; a lag that reaches before the first frame scores 0."""

    def changes(w):
        change = lambda k: sum(F.lit(x) * F.abs(F.col(c) - F.lag(c, k).over(w)) for c, x in WEIGHTS.items())
        return {n: F.coalesce(change(k), F.lit(0.0)) for n, (k, _) in LAGS.items()}

    rows = series.over_halo(frames, max(k for k, _ in LAGS.values()), 0, changes).select("job_id", "frame_index", *LAGS)
    return rows.withColumn("combined", sum(F.lit(x) * F.col(n) for n, (_, x) in LAGS.items()))


def thresholds(scores: DataFrame) -> DataFrame:
    """Strong and recovery thresholds of each job from the median, its absolute deviation and high percentiles."""
    first = series.quantiles(scores.select("job_id", F.col("combined").alias("x")), [0.5, 0.96, 0.92])
    apart = scores.join(first, "job_id").select("job_id", F.abs(F.col("combined") - F.col("p")[0]).alias("x"))
    mad = first.join(series.quantiles(apart, [0.5]).select("job_id", F.col("p")[0].alias("mad")), "job_id")
    m, med = F.greatest("mad", F.lit(1e-5)), F.col("p")[0]
    return mad.select("job_id", F.least(med + 5.0 * m, F.col("p")[1]).alias("strong"), F.greatest(med + 2.2 * m, F.least(med + 3.0 * m, F.col("p")[2])).alias("recovery"))


def peaks(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Frames from the 10th on that reach a threshold and are highest in their surroundings."""
    near = lambda w: {f"near{r}": F.max("combined").over(w.rowsBetween(-r, r)) for r in (2, 3)}
    rows = series.over_halo(scores, 3, 3, near).join(limits, "job_id").where("frame_index >= 10")
    strong = F.col("combined") >= F.col("strong")
    return rows.where((strong & (F.col("combined") >= F.col("near3"))) | (~strong & (F.col("combined") >= F.col("recovery")) & (F.col("combined") >= F.col("near2")))).select("job_id", "frame_index", "combined")


def candidates(found: DataFrame, gap: int = 3) -> DataFrame:
    """Peaks at least `gap` after the last one kept, job by job."""
    return series.spaced(found, gap)


def confirmed(frames: DataFrame, scores: DataFrame, found: DataFrame, share: float = 0.45) -> DataFrame:
    """Candidates whose change persists: of the frames 0 to 2 after one, two or more differ from the frame five before it
    by `share` of its score."""
    marks = found.join(scores.select("job_id", "frame_index", "combined"), ["job_id", "frame_index"]).where("frame_index > 0")
    marks = marks.select("job_id", "frame_index", "combined", F.greatest(F.col("frame_index") - 5, F.lit(0)).alias("before"), F.explode(F.expr("sequence(frame_index, frame_index + 2)")).alias("after"))
    for at in ("before", "after"):
        side = frames.select("job_id", F.col("frame_index").alias(at), *[F.col(c).alias(f"{at}_{c}") for c in WEIGHTS])
        marks = marks.join(side, ["job_id", at])
    change = sum(F.lit(x) * F.abs(F.col(f"after_{c}") - F.col(f"before_{c}")) for c, x in WEIGHTS.items())
    kept = marks.where(change >= F.col("combined") * share).groupBy("job_id", "frame_index").agg(F.count(F.lit(1)).alias("n"))
    return kept.where("n >= 2").select("job_id", "frame_index")


def representatives(frames: DataFrame, groups: DataFrame, samples: int = 12) -> DataFrame:
    """The clearest of some evenly spread frames of each appearance (frames: visibility, sharpness); of equals the first."""
    n = F.col("frame_count")
    spread = F.expr(f"transform(sequence(0, {samples - 1}), j -> start_frame + j * (frame_count - 1) DIV {samples - 1})")
    wanted = groups.withColumn("frame_index", F.explode(F.when(n <= samples, F.expr("sequence(start_frame, end_frame)")).otherwise(spread)))
    scored = wanted.join(frames, ["job_id", "frame_index"]).withColumn("score", 0.6 * F.col("visibility") + 0.4 * F.log(1.0 + F.col("sharpness")))
    return scored.groupBy("job_id", "appearance_index").agg(F.max_by("frame_index", F.struct("score", -F.col("frame_index"))).alias("frame_index"))


def appearances(frames: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Frames between boundaries, which begin new appearances."""
    marks = boundaries.select("job_id", "frame_index", F.lit(1).alias("mark"))
    rows = frames.select("job_id", "frame_index").join(marks, ["job_id", "frame_index"], "left")
    rows = series.running(rows, F.coalesce("mark", F.lit(0)), "appearance_index", "frame_index")
    return rows.groupBy("job_id", "appearance_index").agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.count(F.lit(1)).alias("frame_count"))
