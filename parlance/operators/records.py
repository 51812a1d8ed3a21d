"""Rows in and out: incoming segments and words, report scans, manifests, gates on runs, recoveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import CLOCK, DEFAULT, Settings
from ..writing import keeper
from .assign import speaker_at
from .intervals import E, S, merge_intervals, range_join


def clamp_bounds(regions: DataFrame, durations: DataFrame) -> DataFrame:
    """Regions cut to [0, duration]; those that become empty go.  Sources without a positive duration stay as they are."""
    df = regions.join(durations, "source_id", "left")
    known = F.coalesce(F.col("duration"), F.lit(0)) > 0
    cut = lambda c: F.when(known, F.greatest(F.lit(0), F.least("duration", c))).otherwise(F.col(c)).cast("long")
    return df.withColumn(S, cut(S)).withColumn(E, cut(E)).where(~known | (F.col(E) > F.col(S))).drop("duration")


def clamp_words(words: DataFrame, durations: DataFrame) -> DataFrame:
    """Words (start_s, end_s of any type) as numbers in [0, duration in seconds]; what is no finite number or empty goes."""
    df = words.join(durations, "source_id")
    seconds = F.col("duration") / CLOCK
    df = df.withColumn("start_s", T.bounded(F.col("start_s"), seconds)).withColumn("end_s", T.bounded(F.col("end_s"), seconds))
    return df.where("end_s > start_s").drop("duration")


def result_words(results: DataFrame) -> DataFrame:
    """(source_id, segment, word_no, word, start_s, end_s, speaker, score) of results (source_id, segments array of structs with words)."""
    segments = results.select("source_id", F.posexplode("segments").alias("segment", "s"))
    words = segments.select("source_id", "segment", F.posexplode("s.words").alias("word_no", "w"))
    number = lambda c: F.col(c).cast("double")
    return words.select("source_id", "segment", "word_no", F.trim(F.coalesce("w.word", F.lit(""))).alias("word"), number("w.start").alias("start_s"), number("w.end").alias("end_s"), "w.speaker", number("w.score").alias("score"))


def corrected_segments(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, violations) of corrected segments (start, end, text as texts): numbers, start at 0 or later, end after it; blank texts go."""
    start, end = F.col("start").try_cast("double"), F.col("end").try_cast("double")
    problem = F.when(start.isNull() | end.isNull() | F.col("text").isNull(), "needs_start_end_text").when((start < 0) | (end <= start), "invalid_timestamps")
    df = segments.withColumn("problem", problem)
    clean = df.where("problem is null").withColumn("start", start).withColumn("end", end).withColumn("text", F.trim("text")).where("text <> ''").drop("problem")
    return clean, df.where("problem is not null")


def raw_utterances(segments: DataFrame, speakers: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Utterances of raw segments (start_s, end_s, text, retry_text): the majority speaker, and the retry as a candidate where it says something else."""
    df = segments.where(F.col("end_s") > F.col("start_s")).withColumn(S, T.samples(F.col("start_s"))).withColumn(E, T.samples(F.col("end_s")))
    from .assign import best_overlap

    df = df.join(best_overlap(df, speakers, keys, ids).drop("best_overlap"), [*keys, *ids], "left")
    text, retry = F.trim("text"), F.trim(F.coalesce("retry_text", F.lit("")))
    return df.select(*keys, *ids, F.col("best_speaker").alias("speaker"), S, E, text.alias("text"), text.alias("model_text"), F.lit("aligned").alias("alignment_status"), F.when((retry != "") & (retry != text), retry).alias("candidate"))


def last_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: that which comes last in file order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def approvals(statuses: DataFrame, approved: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved paths, refused): a path is added only if it is a clip under review."""
    known = asked.select("path").distinct().join(statuses, "path", "left")
    fits = F.coalesce(F.col("status") == "REVIEW", F.lit(False))
    return approved.select("path").union(known.where(fits).select("path")).distinct(), known.where(~fits)


def discard_approvals(approved: DataFrame, discarded: DataFrame) -> DataFrame:
    """The distinct approved paths without the discarded ones; a null path is never approved."""
    return approved.where("path is not null").select("path").distinct().join(discarded.select("path").distinct(), "path", "left_anti")


def recovery_totals(recoveries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, regions, recovered) of recovery jobs (keys, status)."""
    return recoveries.groupBy(*keys).agg(F.count("*").alias("regions"), F.count_if(F.col("status") == "recovered").alias("recovered"))


def sections(parts: dict[str, tuple[DataFrame, Column]], keys: list[str]) -> DataFrame:
    """(keys, section, start_sample, end_sample, detail): a nested report as one row an entry, so that no report has to fit in a row."""
    out = None
    for name, (df, detail) in parts.items():
        bound = [F.col(c).cast("long") if c in df.columns else F.lit(None).cast("long") for c in (S, E)]
        rows = df.select(*keys, F.lit(name).alias("section"), bound[0].alias(S), bound[1].alias(E), detail.cast("string").alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out


def source_detail(durations: DataFrame, activities: DataFrame, overlaps: DataFrame, silences: DataFrame, recoveries: DataFrame, clips: DataFrame) -> DataFrame:
    """All that is known of each source: header, activities, derived overlaps and silences, recoveries, planned clips."""
    none = F.lit(None).cast("string")
    head = durations.select("source_id", F.lit(0).alias(S), F.col("duration").alias(E))
    return sections({"source": (head, none), "activity": (activities, F.col("speaker")), "overlap": (overlaps, none), "silence": (silences, none), "recovery": (recoveries, F.concat_ws(":", "version", "status", "decision")), "clip": (clips, F.col("clip_id"))}, ["source_id"])


def review_items(clips: DataFrame, segments: DataFrame, timeline: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(source_id, clip_id, section, ...): segments, timeline entries and overlaps that meet each clip, whole; overrides and corrections come in with the rows."""
    ids = ["source_id", "clip_id"]
    meet = lambda df: range_join(clips.select(*ids, S, E), df, ["source_id"]).drop(S, E).withColumnsRenamed({"r_start": S, "r_end": E})
    return sections({
        "segment": (meet(segments.select("source_id", S, E, "text")), F.col("text")), "timeline": (meet(timeline.select("source_id", S, E, "speaker")), F.col("speaker")),
        "overlap": (meet(overlaps.select("source_id", S, E)), F.lit(None)),
    }, ids)


def transcript_report(words: DataFrame, low: float = 0.4) -> DataFrame:
    """(source_id, value): JSON texts of the words without times and of the unsure words of Latin script, one line a word."""
    unaligned = F.col(S).isNull() | F.col(E).isNull()
    unsure = T.latin(F.col("word")) & (F.col("score").isNull() | (F.col("score") < low))
    kinds = F.array_compact(F.array(F.when(unaligned, F.lit("unaligned_words")), F.when(unsure, F.lit("low_confidence_latin_words"))))
    rows = words.withColumn("list", F.explode(kinds))
    return rows.select("source_id", F.to_json(F.struct("list", "word", S, E)).alias("value"))


def overlay_corrections(raw: DataFrame, existing: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """Raw segments (key, start, end, text) with corrected texts by bounds to a millisecond: new before existing before raw; of equal bounds the last row (``no``) counts."""
    bounds = [F.round("start", 3).alias("s3"), F.round("end", 3).alias("e3")]
    pick = lambda df, name: df.select(key, *bounds, "no", "text").groupBy(key, "s3", "e3").agg(F.max_by("text", "no").alias(name))
    out = raw.select("*", *bounds).join(pick(existing, "old_text"), [key, "s3", "e3"], "left").join(pick(new, "new_text"), [key, "s3", "e3"], "left")
    return out.select(key, "start", "end", F.trim(F.coalesce("new_text", "old_text", "text", F.lit(""))).alias("text"))


def suspicious_touching(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """(source_id, clip_id, suspicious, unresolved): flagged segments that touch a clip; only repeated n-grams stay unresolved."""
    met = range_join(clips.select("source_id", "clip_id", S, E), segments.select("source_id", "quality_flags", S, E), ["source_id"])
    per = met.groupBy("source_id", "clip_id").agg(F.count_if(F.size("quality_flags") > 0).alias("s"), F.count_if(F.array_contains("quality_flags", "repeated_ngram")).alias("u"))
    return clips.select("source_id", "clip_id").join(per, ["source_id", "clip_id"], "left").select("source_id", "clip_id", F.coalesce("s", F.lit(0)).alias("suspicious"), F.coalesce("u", F.lit(0)).alias("unresolved"))


def approved_recoveries(clips: DataFrame, recoveries: DataFrame, versions: DataFrame) -> DataFrame:
    """(source_id, clip_id, start_sample, end_sample): recovered, approved and auditioned regions of the current version, cut to the clips they meet."""
    good = recoveries.where("status = 'recovered' and decision = 'approve' and auditioned").join(versions, ["source_id", "version"], "left_semi")
    met = range_join(clips.select("source_id", "clip_id", S, E), good.select("source_id", S, E), ["source_id"])
    return met.select("source_id", "clip_id", F.greatest(S, "r_start").alias(S), F.least(E, "r_end").alias(E))


def coverage(expected: Column, recovered: Column) -> Column:
    """Share of the expected overlap that was recovered, 1 at most, 0 where none is expected."""
    return F.when(expected > 0, F.least(F.lit(1.0), recovered / expected)).otherwise(0.0)


def signature(utterances: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, signature): a digest of all that word alignment depends on (id, speaker, bounds, text), in the order of the ids.

    Each row is digested as JSON, nulls included, so no text can pass for another row or field; the signature is
    the digest of the rows' digests, so a source's texts never meet in one value.
    """
    row = F.sha2(F.to_json(F.struct("id", "speaker", S, E, "text"), {"ignoreNullFields": "false"}), 256)
    rows = F.array_sort(F.collect_list(F.struct("id", row.alias("r"))))
    return utterances.groupBy(key).agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["r"]), ""), 256).alias("signature"))


def diarization_report(segments: DataFrame, overlaps: DataFrame, short: float = DEFAULT.short_turn_s) -> DataFrame:
    """(source_id, speakers, speaker_count, more_than_two, short_turns, overlap_regions, overlap_samples)."""
    per = segments.groupBy("source_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"), F.count_if(F.col(E) - F.col(S) < short * CLOCK).alias("short_turns"))
    over = overlaps.groupBy("source_id").agg(F.count("*").alias("r"), F.sum(F.col(E) - F.col(S)).alias("n"))
    out = per.join(over, "source_id", "left")
    return out.select("source_id", F.array_join("speakers", ",").alias("speakers"), F.size("speakers").alias("speaker_count"), (F.size("speakers") > 2).alias("more_than_two"), "short_turns", F.coalesce("r", F.lit(0)).alias("overlap_regions"), F.coalesce("n", F.lit(0)).alias("overlap_samples"))


def run_totals(results: DataFrame, keys: list[str]) -> DataFrame:
    """Processed files and failures, and clips by status, of rows (file, status); a failed file has a null status."""
    count = lambda s: F.count_if(F.col("status") == s)
    df = results.groupBy(*keys).agg(F.count_distinct(F.when(F.col("status").isNotNull(), F.col("file"))).alias("processed"), count("PASS").alias("accepted"), count("REVIEW").alias("review"), count("REJECT").alias("rejected"), F.count_distinct(F.when(F.col("status").isNull(), F.col("file"))).alias("failed"))
    return df


def stage_report(stages: DataFrame, media: DataFrame) -> DataFrame:
    """(file, total_s, realtime_factor, cached): seconds of a run's stages (file, stage, elapsed, cache_hit) against the media's seconds."""
    per = stages.groupBy("file").agg(F.round(F.sum("elapsed"), 3).alias("total_s"), F.count_if("cache_hit").alias("cached"))
    return per.join(media, "file").select("file", "total_s", F.when(F.col("media_s") > 0, F.col("total_s") / F.col("media_s")).alias("realtime_factor"), "cached")


def acceptance(files: DataFrame, clips: DataFrame) -> DataFrame:
    """Five acceptance rules of each file (file, unresolved, speaker_errors, words, realtime, gpu_bytes) with its clips (file, status, a_share, b_share)."""
    short = (F.col("status") == "PASS") & (F.least("a_share", "b_share") < 0.12)
    per = clips.groupBy("file").agg(F.count_if(F.col("status") == "PASS").alias("accepted"), F.count_if(short).alias("unbalanced"))
    df = files.join(per, "file", "left").na.fill(0, ["accepted", "unbalanced"])
    rate = F.when(F.col("words") > 0, F.col("speaker_errors") / F.col("words"))
    return df.select(
        "file", "accepted", "unbalanced", rate.alias("speaker_error_rate"), (F.col("unresolved") == 0).alias("no_hallucination"), F.coalesce(rate == 0, F.lit(True)).alias("no_swaps"),
        (F.col("unbalanced") == 0).alias("balanced"), F.coalesce(F.col("realtime") <= 2.0, F.lit(False)).alias("fast"), F.coalesce(F.col("gpu_bytes") <= int(5.5 * 1024**3), F.lit(False)).alias("small"),
    )


def gold_labels(words: DataFrame, gold: DataFrame, keys: list[str], ids: list[str], order: str) -> DataFrame:
    """Words (keys, ids, start_sample, end_sample, detected) with ``gold``, the speaker of the first gold segment (by ``order``) at their middle; null without one, or without times or a detected label."""
    timed = words.where(F.col(S).isNotNull() & F.col(E).isNotNull() & F.col("detected").isNotNull())
    at = speaker_at(timed.select(*keys, *ids, F.expr(f"({S} + {E}) div 2").alias("at")), gold, keys, ids, order)
    return words.join(at.select(*keys, *ids, F.col("speaker_at").alias("gold")), [*keys, *ids], "left")


def best_permutation(words: DataFrame, speakers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mapping, errors, evaluated) of words (detected, gold) and the gold speakers (keys, speaker) of each key.

    Two detected labels and two gold ones are matched in both orders, and the one with fewer errors is taken, on a
    tie the straight one; other numbers of labels stand for themselves.  Labels are counted whether or
    not their words have a gold speaker; words without one are not evaluated.  Keys without a detected label have no row.
    """
    pairs = words.where("detected is not null").groupBy(*keys, "detected", "gold").agg(F.count("*").alias("n"))
    found = pairs.groupBy(*keys).agg(F.array_sort(F.collect_set("detected")).alias("d"))
    true = speakers.where("speaker is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("speaker")).alias("g"))
    df = pairs.join(found, keys).join(true, keys, "left").where("gold is not null")
    two = (F.size("d") == 2) & (F.coalesce(F.size("g"), F.lit(0)) == 2)
    at = F.array_position("d", F.col("detected"))
    wrong = lambda label: F.sum(F.when(label == F.col("gold"), 0).otherwise(F.col("n")))
    straight, crossed = F.when(two, F.get("g", (at - 1).cast("int"))).otherwise(F.col("detected")), F.when(two, F.get("g", (2 - at).cast("int")))
    per = df.groupBy(*keys).agg(wrong(straight).alias("x"), F.when(F.bool_or(two), wrong(crossed)).alias("y"), F.sum("n").alias("evaluated"), F.bool_or(two).alias("two"))
    name = F.when(~F.col("two"), "identity").when(F.col("x") <= F.col("y"), "straight").otherwise("crossed")
    return per.select(*keys, name.alias("mapping"), F.least("x", "y").alias("errors"), "evaluated")


def relabel_plans(plans: DataFrame) -> DataFrame:
    """Plans whose only fault is too much overlap become reviews for separation."""
    only = (F.col("status") == "REJECT") & (F.array_distinct("reasons") == F.array(F.lit("excessive_overlap")))
    new = {"status": F.when(only, "REVIEW").otherwise(F.col("status")), "reasons": F.when(only, F.array(F.lit("overlap_separation_required"))).otherwise(F.col("reasons"))}
    return plans.withColumns(new)


def running_totals(counts: DataFrame, key: str, n: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, before): the sum of ``n`` of all keys before each (one row a key), by ranges that are summed apart and then offset.

    ``keep`` writes the ranges down, as they must not be cut anew when they are read twice.
    """
    keep = keep or keeper(counts.sparkSession)
    parts = keep(counts.select(key, n).repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    offset = parts.groupBy("part").agg(F.sum(n).alias("total"))
    # one row a range
    offset = offset.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))
    inside = F.sum(n).over(Window.partitionBy("part").orderBy(key)) - F.col(n)
    return parts.withColumn("inside", inside).join(F.broadcast(offset), "part").select(key, (F.col("offset") + F.col("inside")).alias("before"))


def legacy_clip_ids(plans: DataFrame, previous: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(source_id, clip_no, clip_id): a source's former ids first, then numbers after the largest of all, in the order of the sources."""
    top = previous.agg(F.coalesce(F.max(F.regexp_extract("clip_id", r"^conversation_(\d+)$", 1).try_cast("long")), F.lit(0)).alias("top"))
    old = previous.select("source_id", F.row_number().over(Window.partitionBy("source_id").orderBy("clip_no")).alias("clip_no"), F.col("clip_id").alias("old_id"))
    df = plans.join(old, ["source_id", "clip_no"], "left")
    fresh = df.where("old_id is null").withColumn("at", F.row_number().over(Window.partitionBy("source_id").orderBy("clip_no")))
    before = running_totals(fresh.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "n", keep)
    named = fresh.join(before, "source_id").crossJoin(F.broadcast(top))  # a single row
    named = named.select("source_id", "clip_no", F.format_string("conversation_%03d", F.col("top") + F.col("before") + F.col("at")).alias("clip_id"))
    return named.unionByName(df.where("old_id is not null").select("source_id", "clip_no", F.col("old_id").alias("clip_id")))


def manifest_problems(rows: DataFrame) -> DataFrame:
    """(path, problem): paths with a back slash or another ending, and durations that are not positive."""
    problem = F.when(~F.col("path").rlike(r"^[^\\]+\.wav$"), "bad_path").when(~(F.col("duration") > 0), "bad_duration")
    return rows.select("path", problem.alias("problem")).where("problem is not null")


def qc_report_problems(reports: DataFrame) -> DataFrame:
    """(clip_id, problem) of report rows: a known status, an id and reasons are needed."""
    problem = F.when(F.col("clip_id").isNull(), "no_clip_id").when(F.col("status").isNull() | ~F.col("status").isin("PASS", "REVIEW", "REJECT"), "bad_status").when(F.col("reasons").isNull(), "no_reasons")
    return reports.select("clip_id", problem.alias("problem")).where("problem is not null")


def preconditions(sources: DataFrame) -> DataFrame:
    """(source_id, problem) of planning and rendering: assistant, finished activities, then a current feasible plan and words."""
    rules = [("no_assistant", F.col("assistant").isNull()), ("activities_not_final", ~F.col("finalized")), ("no_current_plan", F.coalesce(F.col("plan_version") != F.col("version"), F.lit(True))), ("plan_infeasible", ~F.coalesce("feasible", F.lit(False))), ("no_words", F.col("n_words") == 0)]
    problem = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        problem = problem.when(rule, name)
    return sources.select("source_id", problem.alias("problem"))


def longest_gap_cut(boundaries: DataFrame) -> DataFrame:
    """(source_id, middle): the middle of the longest gap between boundaries (source_id, pos); the first of equal gaps."""
    w = Window.partitionBy("source_id").orderBy("pos")
    gaps = boundaries.withColumn("next", F.lead("pos").over(w)).where("next is not null")
    best = gaps.groupBy("source_id").agg(F.max(F.struct((F.col("next") - F.col("pos")).alias("gap"), (-F.col("pos")).alias("pos"))).alias("m"))
    return best.select("source_id", F.expr("-m.pos + m.gap div 2").alias("middle"))


def sample_ranges(segments: DataFrame, most: int = 5) -> DataFrame:
    """(source_id, speaker, start_sample, end_sample, rank): the first ranges of each speaker, to choose by ear."""
    w = Window.partitionBy("source_id", "speaker").orderBy(S, E)
    return segments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("source_id", "speaker", S, E, "rank")


def remaining_overlap(overlaps: DataFrame, recovered: DataFrame, clips: DataFrame) -> DataFrame:
    """(source_id, clip_id, omitted): samples of overlap in a clip that no recovered region replaces."""
    from .intervals import union_length

    ids = ["source_id", "clip_id"]
    cut = lambda df: range_join(clips.select(*ids, S, E), df.select("source_id", S, E), ["source_id"]).select(*ids, F.greatest(S, "r_start").alias(S), F.least(E, "r_end").alias(E))
    over, good = merge_intervals(cut(overlaps), ids), merge_intervals(cut(recovered), ids)
    both = range_join(over, good, ids).select(*ids, F.greatest(S, "r_start").alias(S), F.least(E, "r_end").alias(E))
    out = clips.select(*ids).join(union_length(over, ids), ids, "left").join(union_length(both, ids).withColumnRenamed("length", "replaced"), ids, "left")
    return out.select(*ids, (F.coalesce("length", F.lit(0)) - F.coalesce("replaced", F.lit(0))).cast("long").alias("omitted"))


def export_summary(clips: DataFrame, golden: DataFrame, project: str = "project_id", least: int = 20) -> DataFrame:
    """Sources and clips of each side of the split, golden examples and the warnings of each project."""
    part = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("split") == s, F.col("source_id")))), ",")
    per = clips.groupBy(project).agg(part("train").alias("train_sources"), part("eval").alias("eval_sources"), F.count_if(F.col("split") == "train").alias("train_clips"), F.count_if(F.col("split") == "eval").alias("eval_clips"), F.count_distinct("source_id").alias("n"))
    df = per.join(golden.groupBy(project).agg(F.count("*").alias("g")), project, "left")
    count = F.coalesce("g", F.lit(0))
    warnings = F.array_compact(F.array(F.when(F.col("n") < 2, F.lit("single_source_split")), F.when(count < least, F.lit("small_golden_set"))))
    return df.select(project, "train_sources", "eval_sources", "train_clips", "eval_clips", count.alias("golden"), F.array_join(warnings, ",").alias("warnings"))


def provenance(sources: DataFrame, references: DataFrame) -> DataFrame:
    """Sources with their rights, split and reference regions, as they stand in an export."""
    refs = references.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(S, E, "speaker"))), lambda r: F.concat_ws(":", r["speaker"], r[S], r[E])), ",").alias("speaker_references"))
    return sources.join(refs, "source_id", "left").withColumn("speaker_references", F.coalesce("speaker_references", F.lit("")))
