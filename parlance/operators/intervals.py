"""Interval algebra over partitioned tables.

Intervals are rows with key columns and half-open integer bounds ``start_sample``,
``end_sample``.  Rows with null bounds or end <= start are empty and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S, E = "start_sample", "end_sample"
BIN = 1_440_000  # samples of a bin of the range join: one minute


def proper(df: DataFrame) -> DataFrame:
    return df.where(F.col(E) > F.col(S))


def merge_intervals(df: DataFrame, keys: list[str], gap: float = 0) -> DataFrame:
    """Unions of overlapping or touching intervals (or those at most ``gap`` apart), by key."""
    order = Window.partitionBy(*keys).orderBy(S, E)
    reach = F.max(E).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = proper(df).select(*keys, S, E, F.when(reach.isNull() | (F.col(S) > reach + gap), 1).otherwise(0).alias("__new"))
    numbered = flagged.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min(S).alias(S), F.max(E).alias(E)).drop("__island")


def union_length(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length): the length of the union of intervals."""
    return merge_intervals(df, keys).groupBy(*keys).agg(F.sum(F.col(E) - F.col(S)).alias("length"))


def merge_adjacent(df: DataFrame, keys: list[str], label: str, gap: float, order: list[str] | None = None) -> DataFrame:
    """Consecutive rows of one label, at most ``gap`` apart, become one."""
    w = Window.partitionBy(*keys).orderBy(*(order or [S, E, label]))
    reach = F.max(E).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label)) | (F.col(S) > reach + gap)
    marked = df.withColumn("__new", F.when(fresh, 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, label, "__island").agg(F.min(S).alias(S), F.max(E).alias(E)).drop("__island")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals; the right side's bounds come back as r_start, r_end.

    Both sides are spread over time bins and meet by (keys, bin); a pair counts in the first
    bin they share only, so no deduplication follows, and a long recording is many join keys.
    ``how`` may be inner or left; columns of the right side other than keys must differ from the left's.
    """
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))
    right = proper(right).withColumnsRenamed({S: "r_start", E: "r_end"})
    l_bins = proper(left).withColumn("__bin", F.explode(bins(S, E)))
    r_bins = right.withColumn("__bin", F.explode(bins("r_start", "r_end")))
    met = l_bins.join(r_bins, [*keys, "__bin"]).where((F.col(S) < F.col("r_end")) & (F.col("r_start") < F.col(E)))
    met = met.where(F.col("__bin") == F.floor(F.greatest(F.col(S), F.col("r_start")) / width)).drop("__bin")
    if how == "inner":
        return met
    extra = [c for c in right.columns if c not in keys]
    return _left_again(left, met, left.columns, extra)  # the left side's columns together identify a row


def _left_again(left: DataFrame, met: DataFrame, ids: list[str], extra: list[str]) -> DataFrame:
    renamed = met.select(*[F.col(c).alias(f"__{c}") for c in ids], *extra).alias("m")
    condition: Column = F.lit(True)
    for c in ids:
        condition = condition & left[c].eqNullSafe(F.col(f"__{c}"))
    return left.join(renamed, condition, "left").drop(*[f"__{c}" for c in ids])


def clip_to_windows(intervals: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals cut to each window they overlap; windows (keys, window, start_sample, end_sample)."""
    met = range_join(windows, intervals, keys)
    other = [c for c in intervals.columns if c not in (*keys, S, E)]
    return met.select(*keys, "window", *other, F.greatest(S, "r_start").alias(S), F.least(E, "r_end").alias(E))


def speaker_overlaps(activities: DataFrame) -> DataFrame:
    """Regions in which both A and B are active, by source."""
    merged = merge_intervals(activities, ["source_id", "speaker"])
    a, b = (merged.where(F.col("speaker") == s).drop("speaker") for s in "AB")
    both = range_join(a, b, ["source_id"]).select("source_id", F.greatest(S, "r_start").alias(S), F.least(E, "r_end").alias(E))
    return merge_intervals(both, ["source_id"])


def crowded_regions(activities: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Regions with at least ``least`` speakers at once, any number of speakers; ends count before starts."""
    merged = merge_intervals(activities, [*keys, "speaker"])
    steps = merged.select(*keys, F.col(S).alias("t"), F.lit(1).alias("d")).unionAll(merged.select(*keys, F.col(E).alias("t"), F.lit(-1).alias("d")))
    net = steps.groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("t")
    level = net.withColumn("n", F.sum("d").over(w)).withColumn("next", F.lead("t").over(w))
    return merge_intervals(level.where(F.col("n") >= least).select(*keys, F.col("t").alias(S), F.col("next").alias(E)), keys)


def silences(activities: DataFrame, durations: DataFrame) -> DataFrame:
    """The complement of all speech in [0, duration], head and tail included; durations (source_id, duration)."""
    return complement(activities, durations.select("source_id", F.lit(0).cast("long").alias(S), F.col("duration").alias(E)), ["source_id"])


def complement(cuts: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of frames (one row for each key) without the cuts."""
    frame = frames.select(*keys, F.col(S).alias("f0"), F.col(E).alias("f1"))
    inside = merge_intervals(cuts.select(*keys, S, E), keys).join(frame, keys)
    inside = inside.select(*keys, F.greatest(S, "f0").alias(S), F.least(E, "f1").alias(E)).where(F.col(E) > F.col(S))
    # the frame's ends as empty cuts, so that every gap lies between neighbours
    marks = inside.unionByName(frame.select(*keys, F.col("f0").alias(S), F.col("f0").alias(E))).unionByName(frame.select(*keys, F.col("f1").alias(S), F.col("f1").alias(E)))
    w = Window.partitionBy(*keys).orderBy(S, E)
    gaps = marks.select(*keys, F.col(E).alias("g0"), F.lead(S).over(w).alias("g1"))
    return gaps.where(F.col("g1") > F.col("g0")).select(*keys, F.col("g0").alias(S), F.col("g1").alias(E))


def exchange_counts(activities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, exchanges): changes of speaker in the order of (start, end, speaker)."""
    w = Window.partitionBy(*keys).orderBy(S, E, "speaker")
    changes = proper(activities).withColumn("__c", (F.lag("speaker").over(w) != F.col("speaker")).cast("long"))
    return changes.groupBy(*keys).agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("exchanges"))


def boundary_points(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The distinct bounds of all intervals, as (keys, point)."""
    parts = [df.select(*keys, F.explode(F.array(S, E)).alias("point")) for df in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def split_windows(intervals: DataFrame, clips: DataFrame, keys: list[str], longest: int, context: int, least_core: int) -> DataFrame:
    """Intervals cut into cores of at most ``longest - 2 * context`` samples, each with its context window inside the clip."""
    limit = max(least_core, longest - 2 * context)
    merged = merge_intervals(intervals, keys).join(clips.select(*keys, F.col(S).alias("c0"), F.col(E).alias("c1")), keys)
    cores = merged.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col(E) - F.col(S)) / limit) - 1)))
    core0, core1 = F.col(S) + F.col("k") * limit, F.least(F.col(E), F.col(S) + (F.col("k") + 1) * limit)
    return cores.select(*keys, core0.alias("core_start"), core1.alias("core_end"), F.greatest("c0", core0 - context).alias("window_start"), F.least("c1", core1 + context).alias("window_end"))
