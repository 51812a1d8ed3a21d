"""Quality control and gates: sidecars, clip verdicts, review decisions, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HIGH_RISK
from ..settings import CLOCK, DEFAULT, Settings
from .intervals import E, S, range_join

SPEAKER = "SPEAKER_MAIN"  # fixed value of sidecars
RANKS = {"PASS": 0, "REVIEW": 1, "REJECT": 2}


def sidecar_problems(alignments: DataFrame, durations: DataFrame) -> DataFrame:
    """(clip_id, reasons) of sidecar rows (clip_id, pos, word, start_s, end_s, speaker) and durations (clip_id, duration)."""
    w = Window.partitionBy("clip_id").orderBy("pos")
    df = durations.join(alignments, "clip_id", "left").withColumn("before", F.lag("start_s").over(w))
    broken = F.col("word").isNull() | (F.length("word") < 1) | (F.col("start_s") < 0) | (F.col("end_s") <= 0) | (F.col("speaker") != SPEAKER) | F.col("start_s").isNull() | F.col("end_s").isNull()
    nan = F.isnan("start_s") | F.isnan("end_s") | (F.abs("end_s") == float("inf"))
    outside = nan | (F.col("end_s") > F.col("duration") + 1e-6) | (F.col("start_s") >= F.col("end_s"))
    per = df.groupBy("clip_id").agg(F.bool_or(broken).alias("b"), F.bool_or(outside).alias("o"), F.bool_or(F.col("start_s") < F.col("before")).alias("u"))
    late = F.array_compact(F.array(F.when(F.col("o"), F.lit("alignment_timestamp_out_of_bounds")), F.when(F.col("u"), F.lit("alignment_timestamps_not_ordered"))))
    return per.select("clip_id", F.when(F.col("b"), F.array(F.lit("invalid_alignment_schema"))).otherwise(late).alias("reasons"))


def clip_verdicts(clips: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``status`` and sorted ``reasons`` of one wide row a clip; see the column names below, null counts as absent.

    A missing or unreadable file (``problem`` wav_missing, json_missing or wav_unreadable) is the only reason of its clip.
    """
    c = lambda name, other=0.0: F.coalesce(F.col(name), F.lit(other))
    ratio = lambda n: F.when(c("total_words") > 0, c(n) / c("total_words")).otherwise(0.0)
    low, unsure = ratio("low_confidence_words"), ratio("uncertain_words")
    clipping = F.greatest(c("left_clipping"), c("right_clipping"))
    rest = c("overlap_ratio") * F.greatest(F.lit(0.0), 1.0 - c("separation_coverage"))
    incomplete = (c("overlap_ratio") > s.max_overlap) & (c("separation_coverage") < 0.95)
    stereo = c("channels", 0) == 2
    reject = [
        ("wav_not_stereo", ~stereo),
        ("channel_count_mismatch", ~stereo),
        ("wrong_sample_rate", c("sample_rate", 0) != CLOCK),
        ("invalid_duration", c("duration") <= 0),
        ("left_channel_silent", stereo & (c("left_rms") == 0)),
        ("right_channel_silent", stereo & (c("right_rms") == 0)),
        ("channel_silence_ratio_above_reject_threshold", stereo & (F.greatest(c("left_silence"), c("right_silence")) > s.channel_silence)),
        ("clipping_ratio_above_reject_threshold", stereo & (clipping > s.clipping_reject)),
        ("overlap_separation_incomplete", incomplete),
        ("overlap_ratio_above_reject_threshold", ~incomplete & (rest > s.max_overlap)),
        ("low_confidence_ratio_above_reject_threshold", low > s.low_confidence_reject),
        ("uncertain_assignment_ratio_above_reject_threshold", unsure > s.uncertain_reject),
        ("unresolved_transcript_hallucination", c("unresolved") > 0),
    ]
    review = [
        ("clipping_ratio_above_warning_threshold", stereo & (clipping <= s.clipping_reject) & (clipping > s.clipping_review)),
        ("possible_right_channel_leakage", stereo & (c("right_leakage") > s.leakage_review)),
        ("possible_left_channel_leakage", stereo & (c("left_leakage") > s.leakage_review)),
        ("possible_swapped_channels", stereo & c("swapped", False)),
        ("possible_swapped_or_missing_left_channel", stereo & (c("left_energy") < c("right_energy") * 1e-4)),
        ("separated_overlap_requires_review", c("separation_used", False)),
        ("overlap_ratio_above_warning_threshold", ~incomplete & (rest <= s.max_overlap) & (rest > s.warn_overlap)),
        ("unaligned_words_present", c("unaligned_words") > 0),
        ("low_confidence_words_present", (low <= s.low_confidence_reject) & (low > s.low_confidence_review)),
        ("uncertain_word_assignments_present", (unsure <= s.uncertain_reject) & (unsure > s.uncertain_review)),
        ("suspect_transcript_segments_present", c("suspect_segments") > 0),
        ("transcript_to_audio_duration_inconsistency", F.abs(F.col("duration") - F.col("expected_duration")) > 1.0 / CLOCK + 1e-9),
    ]
    named = lambda rules: F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules]))
    sidecar = F.coalesce("sidecar_reasons", F.array().cast("array<string>"))
    bad = F.concat(named(reject), F.array_remove(sidecar, "unexpected_alignment_speaker"))
    reasons = F.array_sort(F.array_distinct(F.concat(bad, sidecar, named(review))))
    lost = F.col("problem").isNotNull()
    status = F.when(lost | (F.size(bad) > 0), "REJECT").when(F.size(reasons) > 0, "REVIEW").otherwise("PASS")
    return clips.withColumn("status", status).withColumn("reasons", F.when(lost, F.array("problem")).otherwise(reasons))


def worse(a: str, b: str):
    rank = lambda x: F.when(F.col(x) == "REJECT", 2).when(F.col(x) == "REVIEW", 1).otherwise(0)
    top = F.greatest(rank(a), rank(b))
    return F.when(top == 2, "REJECT").when(top == 1, "REVIEW").otherwise("PASS")


def overlay(below: Column, above: Column) -> Column:
    """One map of figures over another: the upper one's entry wins wherever it has one, a null entry too; a null map is an empty one."""
    empty = F.create_map().cast("map<string,double>")
    return F.map_zip_with(F.coalesce(below, empty), F.coalesce(above, empty), lambda k, b, a: F.when(F.map_contains_key(F.coalesce(above, empty), k), a).otherwise(b))


def merge_verdicts(planned: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip_id, status, reasons [, metrics]): the worse status, and the clip's reasons with the plan's other than a wanted separation.

    Where both sides have ``metrics`` (map<string,double>) the clip's figures lie over the plan's.
    """
    figures = "metrics" in planned.columns and "metrics" in clips.columns
    left = planned.select("clip_id", F.col("status").alias("ps"), F.col("reasons").alias("pr"), *([F.col("metrics").alias("pm")] if figures else []))
    df = left.join(clips.select("clip_id", "status", "reasons", *(["metrics"] if figures else [])), "clip_id")
    merged = F.array_sort(F.array_union("reasons", F.array_remove("pr", "overlap_separation_required")))
    return df.select("clip_id", worse("ps", "status").alias("status"), merged.alias("reasons"), *([overlay(F.col("pm"), F.col("metrics")).alias("metrics")] if figures else []))


def decision_requests(requests: DataFrame, clips: DataFrame) -> DataFrame:
    """Decisions with ``refused``: approving needs an audition and no REJECT, any decision needs a known clip."""
    df = requests.join(clips.select("clip_id", "status"), "clip_id", "left")
    approve = F.col("decision") == "approve"
    refused = F.when(F.col("status").isNull(), "unknown_clip").when(approve & ~F.col("auditioned"), "not_auditioned").when(approve & (F.col("status") == "REJECT"), "rejected_by_qc")
    return df.withColumn("refused", refused)


def transcript_blockers(utterances: DataFrame, clips: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, blocker) for sources (source_id, assistant): nothing said, blank or unaligned, high-risk and unverified, among assistant utterances that touch an approved clip."""
    mine = utterances.join(sources.select("source_id", "assistant"), "source_id").where(F.col("speaker").eqNullSafe(F.col("assistant")))
    met = range_join(mine, clips.select("source_id", S, E), ["source_id"]).select(mine.columns).dropDuplicates(["source_id", "id"])
    weak = (F.trim("text") == "") | (F.col("alignment_status") != "aligned")
    risky = F.arrays_overlap("quality_flags", F.array(*[F.lit(x) for x in HIGH_RISK])) & ~F.col("human_verified")
    per = met.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(weak).alias("weak"), F.count_if(risky).alias("risky"))
    df = sources.join(per, "source_id", "left")
    blocker = (
        F.when(F.col("assistant").isNull(), F.lit("assistant_not_chosen"))
        .when(F.coalesce("n", F.lit(0)) == 0, F.lit("no_assistant_utterance"))
        .when(F.col("weak") > 0, F.format_string("unaligned_or_blank:%d", F.col("weak")))
        .when(F.col("risky") > 0, F.format_string("unverified_high_risk:%d", F.col("risky")))
    )
    return df.select("source_id", blocker.alias("blocker"))


def export_gate(sources: DataFrame) -> DataFrame:
    """``gate`` and ``gate_reason``; the first rule that fails decides.

    One row a source: stale, n_clips, n_undecided, n_pending_overlaps, n_approved, n_approved_rejected,
    transcript_blocker, rights_ok.
    """
    ladder = [
        ("skipped", "no_current_clips", F.col("stale") | (F.col("n_clips") == 0)),
        ("blocked", "undecided_clips", F.col("n_undecided") > 0),
        ("blocked", "pending_overlaps", F.col("n_pending_overlaps") > 0),
        ("blocked", "rejected_clip_approved", F.col("n_approved_rejected") > 0),
        ("skipped", "no_approved_clips", F.col("n_approved") == 0),
        ("blocked", "transcript", F.col("transcript_blocker").isNotNull()),
        ("blocked", "rights", ~F.col("rights_ok")),
    ]
    gate, why = F.when(ladder[0][2], ladder[0][0]), F.when(ladder[0][2], ladder[0][1])
    for g, r, rule in ladder[1:]:
        gate, why = gate.when(rule, g), why.when(rule, r)
    return sources.withColumn("gate", gate.otherwise("ready")).withColumn("gate_reason", why)


# fixed values: what a report says of each reason of the gate
GATE_SAYS = {
    "no_current_clips": "no current generated clips; source will be skipped",
    "undecided_clips": "every generated clip needs a review decision",
    "pending_overlaps": "every successfully recovered overlap needs an auditioned approve/reject decision",
    "rejected_clip_approved": "rejected-QC clips cannot be approved",
    "no_approved_clips": "no clips were approved; source will be skipped",
    "rights": "source rights declaration is incomplete",
}
NOTHING_READY = "No fully reviewed and approved clips are ready for export"


def gate_messages(gated: DataFrame, label: str = "source_id", project: str = "project_id") -> DataFrame:
    """(project, kind, label, message) of gated sources, a row a message: blockers, warnings of skipped sources, and a blocker of a project in which nothing is ready.

    A transcript's blocker is the source's own text (``transcript_blocker``, null if there is no such column).
    """
    says = F.create_map(*[F.lit(x) for pair in GATE_SAYS.items() for x in pair])
    own = F.col("transcript_blocker") if "transcript_blocker" in gated.columns else F.lit(None).cast("string")
    text = F.when(F.col("gate_reason") == "transcript", F.coalesce(own, F.lit("transcript"))).otherwise(says[F.col("gate_reason")])
    kind = F.when(F.col("gate") == "blocked", "blocker").otherwise("warning")
    rows = gated.where("gate <> 'ready'").select(project, kind.alias("kind"), F.col(label).alias("label"), F.concat(F.col(label).cast("string"), F.lit(": "), text).alias("message"))
    none = gated.groupBy(project).agg(F.count_if(F.col("gate") == "ready").alias("n")).where("n = 0")
    return rows.unionByName(none.select(project, F.lit("blocker").alias("kind"), F.lit(None).cast(gated.schema[label].dataType).alias("label"), F.lit(NOTHING_READY).alias("message")))


def readiness(gated: DataFrame, project: str = "project_id") -> DataFrame:
    """(project, ready_sources, blocked_sources, approved_clips, valid): valid without blocked sources and with at least one ready."""
    ready = F.col("gate") == "ready"
    df = gated.groupBy(project).agg(F.count_if(ready).alias("ready_sources"), F.count_if(F.col("gate") == "blocked").alias("blocked_sources"), F.coalesce(F.sum(F.when(ready, F.col("n_approved"))), F.lit(0)).alias("approved_clips"))
    return df.withColumn("valid", (F.col("blocked_sources") == 0) & (F.col("ready_sources") > 0))


def annotation_problems(activities: DataFrame, references: DataFrame, excluded: DataFrame, utterances: DataFrame, durations: DataFrame) -> DataFrame:
    """(source_id, problem): duplicate ids across all lists, bounds outside, overlapping regions of a speaker, too many, short or long references."""
    names = ("activity", "speaker_reference", "exclusion", "utterance")
    rows = None
    for k, (name, df) in enumerate(zip(names, (activities, references, excluded, utterances))):
        part = df.select("source_id", F.col("id").cast("string").alias("id"), F.col(S).alias(S), F.col(E).alias(E), F.lit(name).alias("kind"), F.lit(k).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy("source_id", "id").orderBy("k", S, E)
    twice = rows.withColumn("n", F.row_number().over(w)).where("n > 1").select("source_id", F.format_string("duplicate_%s_id:%s", "kind", "id").alias("problem"))
    outside = rows.join(durations, "source_id").where(F.col(E) > F.col("duration")).select("source_id", F.format_string("%s_outside_source:%s", "kind", "id").alias("problem"))
    from .intervals import union_length

    plain = activities.groupBy("source_id", "speaker").agg(F.sum(F.col(E) - F.col(S)).alias("total"))
    clash = plain.join(union_length(activities, ["source_id", "speaker"]), ["source_id", "speaker"]).where("total <> length")
    clash = clash.select("source_id", F.concat(F.lit("same_speaker_regions_overlap:"), "speaker").alias("problem"))
    many = references.groupBy("source_id", "speaker").count().where("count > 1").select("source_id", F.concat(F.lit("multiple_speaker_references:"), "speaker").alias("problem"))
    length = F.col(E) - F.col(S)
    odd = references.select("source_id", F.when(length < 36_000, F.format_string("speaker_reference_too_short:%s", F.col("id").cast("string"))).when(length > 360_000, F.format_string("speaker_reference_too_long:%s", F.col("id").cast("string"))).alias("problem")).where("problem is not null")
    return twice.unionByName(outside).unionByName(clash).unionByName(many).unionByName(odd)


def reject_empty(clips: DataFrame) -> DataFrame:
    """Clips without an aligned word (``n_alignments``) are rejected, whatever their verdict was."""
    none = F.coalesce("n_alignments", F.lit(0)) == 0
    reasons = F.when(none, F.array_sort(F.array_union("reasons", F.array(F.lit("missing_assistant_alignment"))))).otherwise(F.col("reasons"))
    return clips.withColumn("status", F.when(none, "REJECT").otherwise(F.col("status"))).withColumn("reasons", reasons)
