"""Who speaks: words, utterances and timestamps assigned to speakers, and repairs of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings
from .intervals import E, S, merge_adjacent, merge_intervals, range_join


def best_overlap(items: DataFrame, segments: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """(keys, ids, best_speaker, best_overlap): the speaker with the greatest summed overlap; ties go to the larger label."""
    right = segments.select(*keys, F.col("speaker").alias("r_speaker"), S, E)
    met = range_join(items.select(*keys, *ids, S, E), right, keys)
    summed = met.groupBy(*keys, *ids, "r_speaker").agg(F.sum(F.least(E, "r_end") - F.greatest(S, "r_start")).alias("ov"))
    top = F.max(F.struct("ov", "r_speaker")).alias("m")
    return summed.groupBy(*keys, *ids).agg(top).select(*keys, *ids, F.col("m.r_speaker").alias("best_speaker"), F.col("m.ov").alias("best_overlap"))


def assign_speakers(words: DataFrame, segments: DataFrame, keys: list[str], ids: list[str], minimum: float = DEFAULT.assign_overlap) -> DataFrame:
    """Words with ``speaker`` (the old one stays where confidence is under the minimum), ``assignment_confidence`` and ``uncertain``."""
    out = words.join(best_overlap(words, segments, keys, ids), [*keys, *ids], "left")
    timed = F.col(E) > F.col(S)
    confidence = F.when(timed & F.col("best_overlap").isNotNull(), F.col("best_overlap") / (F.col(E) - F.col(S)))
    sure = F.coalesce(confidence >= minimum, F.lit(False))
    out = out.withColumn("assignment_confidence", confidence).withColumn("speaker", F.when(sure, F.col("best_speaker")).otherwise(F.col("speaker")))
    return out.withColumn("uncertain", ~sure).drop("best_speaker", "best_overlap")


def speaker_at(points: DataFrame, segments: DataFrame, keys: list[str], ids: list[str], order: str, last: bool = False) -> DataFrame:
    """(keys, ids, speaker_at) of points (``at``): the first segment in list order that holds the point, or the last."""
    spans = points.withColumn(S, F.col("at")).withColumn(E, F.col("at") + 1)
    met = range_join(spans, segments.select(*keys, F.col("speaker").alias("r_speaker"), F.col(order).alias("r_order"), S, E), keys)
    pick = (F.max_by if last else F.min_by)("r_speaker", "r_order")
    return points.join(met.groupBy(*keys, *ids).agg(pick.alias("speaker_at")), [*keys, *ids], "left")


def apply_overrides(segments: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Segments after overrides: elementary pieces take the last override that covers their midpoint, else the first base segment; touching pieces of one speaker merge."""
    points = segments.select(*keys, F.explode(F.array(S, E)).alias("p")).unionAll(overrides.select(*keys, F.explode(F.array(S, E)).alias("p"))).distinct()
    w = Window.partitionBy(*keys).orderBy("p")
    pieces = points.select(*keys, F.col("p").alias("p0"), F.lead("p").over(w).alias("p1")).where("p1 > p0")
    at = pieces.withColumn("at", F.expr("(p0 + p1) div 2"))
    base = speaker_at(at, segments, keys, ["p0", "p1"], "seg_no").withColumnRenamed("speaker_at", "base")
    both = speaker_at(base, overrides, keys, ["p0", "p1"], "override_no", last=True)
    named = both.select(*keys, F.coalesce("speaker_at", "base").alias("speaker"), F.col("p0").alias(S), F.col("p1").alias(E)).where("speaker is not null")
    return merge_adjacent(named, keys, "speaker", 0)


def override_words(words: DataFrame, overrides: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Words whose midpoint an override covers take its speaker, with confidence 1."""
    at = words.withColumn("at", F.expr(f"({S} + {E}) div 2"))
    found = speaker_at(at, overrides, keys, ids, "override_no", last=True)
    hit = F.col("speaker_at").isNotNull()
    found = found.withColumn("assignment_confidence", F.when(hit, 1.0).otherwise(F.col("assignment_confidence")))
    return found.withColumn("speaker", F.coalesce("speaker_at", "speaker")).drop("speaker_at", "at")


def flag_overlapping(utterances: DataFrame, overlaps: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Sets or clears ``overlapping_speech``: at least 6,000 samples and 5 % of the utterance; flags sorted."""
    met = range_join(utterances.select(*keys, *ids, S, E), overlaps.select(*keys, S, E), keys)
    total = met.groupBy(*keys, *ids).agg(F.sum(F.least(E, "r_end") - F.greatest(S, "r_start")).alias("__ov"))
    out = utterances.join(total, [*keys, *ids], "left")
    need = F.greatest(F.lit(6000), F.rint((F.col(E) - F.col(S)) * 0.05))
    plain = F.array_remove("quality_flags", "overlapping_speech")
    flags = F.when(F.coalesce("__ov", F.lit(0)) >= need, F.array_union(plain, F.array(F.lit("overlapping_speech")))).otherwise(plain)
    return out.withColumn("quality_flags", F.array_sort(F.array_distinct(flags))).drop("__ov")


def alignment_status(utterances: DataFrame, words: DataFrame, keys: list[str], ids: list[str], s: Settings = DEFAULT) -> DataFrame:
    """``alignment_status``: unaligned without a word, low_confidence with a word of null or low score, else aligned; two flags follow it."""
    met = range_join(utterances.select(*keys, *ids, S, E), words.select(*keys, F.col("score").alias("r_score"), S, E), keys)
    seen = met.groupBy(*keys, *ids).agg(F.bool_or(F.col("r_score").isNull() | (F.col("r_score") < s.low_score)).alias("__low"))
    out = utterances.join(seen, [*keys, *ids], "left")
    status = F.when(F.col("__low").isNull(), "unaligned").when(F.col("__low"), "low_confidence").otherwise("aligned")
    plain = F.array_except("quality_flags", F.array(F.lit("unaligned_words"), F.lit("low_confidence_alignment")))
    extra = F.when(F.col("__low").isNull(), F.array(F.lit("unaligned_words"))).when(F.col("__low"), F.array(F.lit("low_confidence_alignment"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("alignment_status", status).withColumn("quality_flags", F.array_sort(F.array_union(plain, extra))).drop("__low")


def close_gaps(activities: DataFrame, words: DataFrame, excluded: DataFrame, longest: int = DEFAULT.gap_samples) -> tuple[DataFrame, DataFrame]:
    """(regions, repairs): gaps of one speaker up to ``longest`` close if a word of the speaker lies in them and neither the other speaker nor an exclusion does."""
    keys = ["source_id", "speaker"]
    merged = merge_intervals(activities, keys)
    w = Window.partitionBy(*keys).orderBy(S)
    holes = merged.select(*keys, F.lag(E).over(w).alias(S), F.col(S).alias(E)).where(F.col(S).isNotNull() & (F.col(E) - F.col(S) <= longest))
    ids = [*keys, S, E]
    touched = lambda right: range_join(holes, right, ["source_id"]).select(*ids)
    rival = range_join(holes, activities.select("source_id", F.col("speaker").alias("r_speaker"), S, E), ["source_id"]).where("speaker <> r_speaker").select(*ids)
    own = range_join(holes, words.select(*keys, S, E), keys).select(*ids)
    repairs = holes.join(own, ids, "left_semi").join(rival, ids, "left_anti").join(touched(excluded.select("source_id", S, E)), ids, "left_anti")
    return merge_intervals(merged.unionByName(repairs), keys), repairs


def clean_turns(activities: DataFrame, shortest: int = 36_000, top: int = 25) -> DataFrame:
    """The longest turns of each speaker that the other speaker does not touch."""
    numbered = activities.select("source_id", "speaker", S, E).where(F.col(E) - F.col(S) >= shortest)
    rival = range_join(numbered, activities.select("source_id", F.col("speaker").alias("r_speaker"), S, E), ["source_id"]).where("speaker <> r_speaker")
    free = numbered.join(rival.select("source_id", "speaker", S, E), ["source_id", "speaker", S, E], "left_anti")
    w = Window.partitionBy("source_id", "speaker").orderBy((F.col(E) - F.col(S)).desc(), S)
    return free.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _apply(step: Column, label: Column) -> Column:
    """What a transition (s, u, v) makes of a label: u of the label s, v of all others."""
    return F.when(label == step["s"], step["u"]).otherwise(step["v"])


def _arrivals(steps: DataFrame, keys: list[str], width: int, levels: int) -> DataFrame:
    """(keys, i, x): the label that arrives at each transition (keys, i, s, u, v) in order of i, null at the first.

    Transitions one after the other are again a transition, so chunks of ``width`` are composed, what arrives
    at each chunk follows in the same way from the chunks, and each chunk is gone through by itself.
    """
    group = [*keys, "c"] if levels else keys
    df = steps.withColumn("c", F.floor(F.col("i") / width)) if levels else steps
    df = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", "s", "u", "v"))).alias("t"))
    start = F.lit(None).cast("string")
    if levels:
        first = F.struct(*[F.col("t")[0][c].alias(c) for c in "suv"])
        whole = F.aggregate(F.slice("t", F.lit(2), F.size("t")), first, lambda a, e: F.struct(a["s"].alias("s"), _apply(e, a["u"]).alias("u"), _apply(e, a["v"]).alias("v")))
        composed = df.select(*group, whole.alias("w")).select(*keys, F.col("c").alias("i"), "w.s", "w.u", "w.v")
        df, start = df.join(_arrivals(composed, keys, width, levels - 1).withColumnRenamed("i", "c"), group), F.col("x")
    none = F.struct(start.alias("x"), F.array().cast("array<string>").alias("out"))
    gone = F.aggregate("t", none, lambda a, e: F.struct(_apply(e, a["x"]).alias("x"), F.concat(a["out"], F.array(a["x"])).alias("out")))
    pairs = F.explode(F.arrays_zip(F.transform("t", lambda e: e["i"]).alias("i"), gone["out"].alias("x")))
    return df.select(*keys, pairs.alias("z")).select(*keys, "z.i", "z.x")


def smooth_turns(segments: DataFrame, short: float, keys: list[str], width: int = 256) -> DataFrame:
    """(keys, start_sample, end_sample, speaker, ambiguous): turns under ``short`` between two turns of one other speaker take its label; other short ones are ambiguous.

    The neighbour before is the one already rewritten; the first and the last turn never change.
    A short turn maps the label before it to its next one's, if it is the same, else to its own; a long turn maps all
    labels to its own.  A key's turns are composed in chunks of chunks of ``width``, so a run of short turns of any length is many tasks.
    """
    w = Window.partitionBy(*keys).orderBy(S, E, "speaker")
    df = segments.select(*keys, S, E, F.col("speaker").alias("p"), F.lag("speaker").over(w).alias("before"), F.lead("speaker").over(w).alias("after"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    brief = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col(E) - F.col(S) < short)
    df = df.withColumn("brief", brief).withColumns({"s": F.when(F.col("brief"), F.col("after")), "u": F.when(F.col("brief"), F.col("after")).otherwise(F.col("p")), "v": F.col("p")})
    arrived = _arrivals(df.select(*keys, "i", "s", "u", "v"), keys, width, 2)
    out = df.join(arrived, [*keys, "i"])
    same = F.coalesce((F.col("x") == F.col("after")) & (F.col("x") != F.col("p")), F.lit(False))
    return out.select(*keys, S, E, _apply(F.struct("s", "u", "v"), F.col("x")).alias("speaker"), (F.col("brief") & ~same).alias("ambiguous"))


def choose_assistant(labels: DataFrame, explicit: DataFrame, mapped: DataFrame) -> DataFrame:
    """(source_id, assistant, problem): the explicit choice, else the mapped one; it must be among the labels."""
    known = labels.groupBy("source_id").agg(F.collect_set("speaker").alias("labels"))
    out = known.join(explicit.select("source_id", F.col("speaker").alias("x")), "source_id", "left").join(mapped.select("source_id", F.col("speaker").alias("m")), "source_id", "left")
    choice = F.coalesce("x", "m")
    problem = F.when(choice.isNull(), "no_choice").when(~F.array_contains("labels", choice), "unknown_speaker")
    return out.select("source_id", F.when(problem.isNull(), choice).alias("assistant"), problem.alias("problem"))


def map_labels(segments: DataFrame) -> DataFrame:
    """Two detected labels become A and B in their order; sources with another number of labels get null."""
    per = segments.groupBy("source_id").agg(F.array_sort(F.collect_set("speaker")).alias("labels"))
    out = segments.join(per, "source_id")
    label = F.when(F.size("labels") == 2, F.when(F.col("speaker") == F.col("labels")[0], "A").otherwise("B"))
    return out.withColumn("detected", F.col("speaker")).withColumn("speaker", label).drop("labels")


def reset_verified(old: DataFrame, new: DataFrame) -> DataFrame:
    """New utterances with ``human_verified`` cleared where speaker, bounds or text differ from the old row of the id, or there is none."""
    sig = lambda: F.struct("speaker", S, E, "text")
    before = old.select("source_id", "id", sig().alias("__old"))
    out = new.join(before, ["source_id", "id"], "left")
    return out.withColumn("human_verified", F.col("human_verified") & F.coalesce(sig().eqNullSafe(F.col("__old")), F.lit(False))).drop("__old")
